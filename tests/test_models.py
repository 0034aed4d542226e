"""Models against closed forms and numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from zephyrgrid.models import backtest, boosted, fourier_trend, seasonal_ar, seasonal_naive, weekly_sequence
from zephyrgrid.models.folds import FoldPlan, numbered
from zephyrgrid.models.forecaster import Forecaster
from zephyrgrid.operators import metrics, stats


@pytest.fixture(scope="module")
def waves(spark):
    """Two hourly series: a daily wave with noise, and a persistent walk around a level."""
    rng = np.random.default_rng(3)
    n, ds = 400, pd.date_range("2024-01-01", periods=400, freq="h")
    wave = 20 + 8 * np.sin(2 * np.pi * np.arange(n) / 24) + rng.normal(0, 0.3, n)
    walk = np.zeros(n)
    for i in range(1, n):
        walk[i] = 0.7 * walk[i - 1] + rng.normal()
    pdf = pd.concat([pd.DataFrame({"unique_id": u, "ds": ds, "y": y}) for u, y in (("wave", wave), ("walk", walk + 50))])
    return spark.createDataFrame(pdf).withColumn("ds", F.col("ds").cast("timestamp_ntz")).cache(), pdf


def test_gram_solve_equals_least_squares(waves):
    df, pdf = waves
    fitted = {r.unique_id: r for r in seasonal_ar.fit(df, 24, candidates=[(0, (1, 2, "m"))]).collect()}
    for uid, part in pdf.groupby("unique_id"):
        y = part.y.to_numpy()
        rows = np.arange(25, len(y))
        x = np.column_stack([np.ones(len(rows)), y[rows - 1], y[rows - 2], y[rows - 24]])
        beta, rss, *_ = np.linalg.lstsq(x, y[rows], rcond=None)
        coef = np.array(fitted[uid].coef)
        np.testing.assert_allclose(coef[[1, 2, 4]], beta[1:], rtol=1e-6)
        assert coef[0] + fitted[uid]["mean"] * (1 - coef[1:].sum()) == pytest.approx(beta[0], rel=1e-6)
        assert fitted[uid].sigma2 == pytest.approx(rss[0] / (len(rows) - 4), rel=1e-6)


def test_candidates_are_chosen_by_fit(waves):
    df, _ = waves
    forms = {r.unique_id: r.form for r in seasonal_ar.fit(df, 24).collect()}
    assert "m" in forms["wave"]
    assert "1" in forms["walk"]


def test_differenced_order_keeps_unit_root(waves):
    df, pdf = waves
    for r in seasonal_ar.fixed_order(df, (1, 2), 1).collect():
        assert sum(r.coef[1:]) == pytest.approx(1.0)
        y = pdf[pdf.unique_id == r.unique_id].y.to_numpy()
        d = np.diff(y)
        rows = np.arange(24, len(d))
        beta = np.linalg.lstsq(np.column_stack([d[rows - 1], d[rows - 2]]), d[rows], rcond=None)[0]
        np.testing.assert_allclose([r.coef[1] - 1, -r.coef[3]], beta, rtol=1e-5)


def test_roll_forward_matches_simulation():
    coef = np.array([0.5, 0.6, 0.1, 0.0, 0.2, 0.0])
    tail = np.arange(5.0, 0.0, -1.0)  # newest first, season 4
    path, spread = seasonal_ar.roll_forward(coef, tail, 4, 6)
    y = list(tail[::-1])
    for _ in range(6):
        y.append(0.5 + 0.6 * y[-1] + 0.1 * y[-2] + 0.2 * y[-4])
    np.testing.assert_allclose(path, y[5:])
    shock = np.zeros(6)
    for s in range(6):
        shock[s] = 1.0 if s == 0 else 0.6 * shock[s - 1] + (0.1 * shock[s - 2] if s > 1 else 0) + (0.2 * shock[s - 4] if s > 3 else 0)
    np.testing.assert_allclose(spread, np.cumsum(shock ** 2))


def test_forecasts_follow_the_wave(waves):
    df, pdf = waves
    hours = np.arange(400, 424)
    truth = 20 + 8 * np.sin(2 * np.pi * hours / 24)
    ar = seasonal_ar.forecast(df, 24, 3600).filter("unique_id = 'wave' and level = 80").orderBy("ds").toPandas()
    ft = fourier_trend.forecast(df, 24, 3600).filter("unique_id = 'wave'").orderBy("ds").toPandas()
    for out in (ar, ft):
        assert out.ds.tolist() == pd.date_range("2024-01-17 16:00", periods=24, freq="h").tolist()
        assert np.abs(out.yhat - truth).max() < 1.5
        assert (out.lo < out.yhat).all() and (out.yhat < out.hi).all()
    # A purely seasonal model has the same width all day; subtraction leaves rounding noise.
    assert (ar.hi - ar.lo).diff().min() > -1e-9


def test_components_add_up(waves):
    df, _ = waves
    params = fourier_trend.fit(df, "H")
    parts = fourier_trend.components(df, params, "H")
    fit = fourier_trend.predict_at(df.withColumn("fold", F.lit(0)), params, "H")
    both = parts.join(fit, ["unique_id", "ds"]).select(
        F.max(F.abs(F.col("trend") + F.col("daily") + F.col("weekly") + F.col("yearly") - F.col("yhat"))).alias("gap"))
    assert both.first().gap < 1e-9


@pytest.mark.parametrize("model", [seasonal_ar.NAME, fourier_trend.NAME])
def test_folds_equal_separate_fits(waves, model):
    df, pdf = waves
    plan = FoldPlan(h=12, step_size=12, n_windows=3)
    got = backtest.predictions(df, model, plan).toPandas()
    for fold in range(3):
        cut = 400 - 12 - (2 - fold) * 12
        train = numbered(df).filter(F.col("pos") < cut).select("unique_id", "ds", "y")
        if model == seasonal_ar.NAME:
            alone = seasonal_ar.forecast(train, 12, 3600, levels=()).toPandas()
            a = got[got.fold == fold].sort_values(["unique_id", "ds"]).yhat.to_numpy()
            b = alone.sort_values(["unique_id", "ds"]).yhat.to_numpy()
            np.testing.assert_allclose(a, b, rtol=1e-6)
        assert (got[got.fold == fold].groupby("unique_id").size() == 12).all()
    if model == fourier_trend.NAME:
        # All folds share the first one's time scale, so that one is a fit of its own and no fold feels rows after its cut.
        train = numbered(df).filter(F.col("pos") < 400 - 36).select("unique_id", "ds", "y")
        alone = fourier_trend.forecast(train, 12, 3600, levels=()).toPandas().sort_values(["unique_id", "ds"])
        first = got[got.fold == 0].sort_values(["unique_id", "ds"])
        np.testing.assert_allclose(first.yhat, alone.yhat, rtol=1e-6)
        later = numbered(df).withColumn("y", F.when(F.col("pos") >= 400 - 24, F.col("y") + 1000).otherwise(F.col("y"))).select("unique_id", "ds", "y")
        moved = backtest.predictions(later, model, plan).toPandas().sort_values(["fold", "unique_id", "ds"])
        kept = got.sort_values(["fold", "unique_id", "ds"])
        np.testing.assert_allclose(moved[moved.fold < 2].yhat, kept[kept.fold < 2].yhat, rtol=1e-9)


def test_naive_repeats_the_season(waves):
    df, pdf = waves
    out = seasonal_naive.forecast(df, 50, 3600, 24).filter("unique_id = 'wave'").orderBy("ds").toPandas()
    y = pdf[pdf.unique_id == "wave"].y.to_numpy()
    np.testing.assert_allclose(out.yhat, [y[400 - 24 + (s % 24)] for s in range(50)])


def test_weekly_sequence_bounds_stay_in_range(spark):
    rng = np.random.default_rng(1)
    n = 80
    y = 10 + 3 * np.sin(2 * np.pi * np.arange(n) / 7) + rng.normal(0, 0.2, n)
    pdf = pd.DataFrame({"unique_id": "d", "ds": pd.date_range("2024-01-01", periods=n), "y": y})
    df = spark.createDataFrame(pdf).withColumn("ds", F.col("ds").cast("timestamp_ntz"))
    out = weekly_sequence.forecast(df).toPandas()
    assert len(out) == 14 and out.ds.min() == pd.Timestamp("2024-03-21")
    assert out.lo.min() >= y.min() - 1e-9 and out.hi.max() <= y.max() + 1e-9
    truth = 10 + 3 * np.sin(2 * np.pi * np.arange(n, n + 7) / 7)
    assert np.abs(out[out.level == 80].sort_values("ds").yhat.to_numpy() - truth).max() < 1.5


def test_boosted_features_match_training(waves):
    """The features made from the tail array equal the training features of the same row."""
    df, _ = waves
    from zephyrgrid.operators.features import model_features
    trained = model_features(df, "H", include_current=False).filter(F.col("ds") == F.lit("2024-01-17 15:00:00").cast("timestamp_ntz"))
    from zephyrgrid.models.folds import FULL, tails
    ends = tails(numbered(df.filter(F.col("ds") < F.lit("2024-01-17 15:00:00").cast("timestamp_ntz"))), FULL, 168)
    made = ends.withColumns(boosted._tail_features("H"))
    names = list(boosted._tail_features("H"))
    a = trained.orderBy("unique_id").select(*names).toPandas()
    b = made.orderBy("unique_id").select(*names).toPandas()
    pd.testing.assert_frame_equal(a, b)


def test_boosted_forecast(waves):
    df, _ = waves
    model = boosted.train(df, "H", trees=3, depth=3)
    out = boosted.forecast(model, df, 8, 3600).toPandas()
    assert len(out) == 16 and (out.lo < out.hi).all()
    shares = boosted.feature_importance(model, df).toPandas()
    assert shares.importance.sum() == pytest.approx(1.0) and shares.importance.is_monotonic_decreasing


def test_boosted_folds_equal_separate_fits(waves):
    df, _ = waves
    plan, few = FoldPlan(h=4, step_size=4, n_windows=2), {"trees": 2, "depth": 2}
    got = backtest.predictions(df, boosted.NAME, plan, options=few).toPandas()
    assert (got.groupby(["unique_id", "fold"]).size() == 4).all() and len(got) == 16
    train = numbered(df).filter(F.col("pos") < 392).select("unique_id", "ds", "y")
    alone = boosted.forecast(boosted.train(train, "H", **few), train, 4, 3600).toPandas()
    keys = ["unique_id", "ds"]
    np.testing.assert_allclose(got[got.fold == 0].sort_values(keys).yhat, alone.sort_values(keys).yhat)
    scores = Forecaster(boosted.NAME, "H", **few).fit(df).evaluate(h=4, step_size=4, n_windows=1)
    assert scores.filter("metric = 'rmse'").count() == 2


def test_autoregression_with_null_targets(waves):
    df, pdf = waves
    holes = df.withColumn("y", F.when(F.col("ds") != F.lit("2024-01-17 12:00:00").cast("timestamp_ntz"), F.col("y")))
    out = seasonal_ar.forecast(holes, 24, 3600).toPandas()
    assert len(out) == 96 and out.yhat.notna().all()


def test_series_without_forecast_are_listed(waves):
    df, _ = waves
    few = df.limit(0).unionByName(df.filter("unique_id = 'wave'").orderBy("ds").limit(20).withColumn("unique_id", F.lit("few")))
    f = Forecaster(seasonal_ar.NAME, "H").fit(df.unionByName(few))
    f.forecast(4)
    assert [tuple(r) for r in f.left_out().collect()] == [("few", 20, 20, "too short")]


def test_pacf_of_autoregression():
    rho = 0.6 ** np.arange(6)
    np.testing.assert_allclose(stats.durbin_levinson(rho), [1, 0.6, 0, 0, 0, 0], atol=1e-12)


def test_adf_tells_stationary_from_walk(spark):
    rng = np.random.default_rng(8)
    e = rng.normal(size=300)
    ar = np.zeros(300)
    for i in range(1, 300):
        ar[i] = 0.3 * ar[i - 1] + e[i]
    walk = np.cumsum(rng.normal(size=300)) + 100
    ds = pd.date_range("2024-01-01", periods=300, freq="h")
    pdf = pd.concat([pd.DataFrame({"unique_id": u, "ds": ds, "y": y}) for u, y in (("ar", ar), ("walk", walk))])
    df = spark.createDataFrame(pdf).withColumn("ds", F.col("ds").cast("timestamp_ntz"))
    out = {r.unique_id: r for r in stats.adf(df, 1).collect()}
    assert out["ar"].stationary and not out["walk"].stationary
    d = np.diff(walk)
    x = np.column_stack([np.ones(298), walk[1:-1], d[:-1]])
    beta, rss, *_ = np.linalg.lstsq(x, d[1:], rcond=None)
    se = np.sqrt(rss[0] / 295 * np.linalg.inv(x.T @ x)[1, 1])
    assert out["walk"].adf_stat == pytest.approx(beta[1] / se, rel=1e-6)
    assert stats.adf_p_value(-2.86) == pytest.approx(0.05, abs=0.003)


def test_metrics_edge_cases(frame):
    df = frame([("a", "m", 0.0, 1.0), ("a", "m", -2.0, -1.0), ("a", "m", None, 5.0)], "unique_id string, model string, y double, yhat double")
    m = {r.metric: r.value for r in metrics.forecast_metrics(df).collect()}
    assert m["mae"] == 1.0 and m["mape"] == 50.0 and 0 <= m["smape"] <= 200


def test_ensemble_weights(frame):
    fc = frame([("a", "2024-01-01 00:00:00", "x", 10.0), ("a", "2024-01-01 00:00:00", "z", 20.0)],
               "unique_id string, ds timestamp_ntz, model string, yhat double")
    err = frame([("a", "x", 1.0), ("a", "z", 3.0)], "unique_id string, model string, rmse double")
    assert metrics.ensemble(fc, err).first().yhat == pytest.approx(12.5)


def test_percent_bounds_of_negative_forecasts(frame):
    row = metrics.percent_bounds(frame([(-10.0,)], "yhat double")).first()
    assert (row.lo, row.hi) == (-11.0, -9.0)


def test_forecaster_surface(waves):
    df, _ = waves
    f = Forecaster(seasonal_naive.NAME, "H").fit(df)
    assert f.forecast(clamp=True).count() == 48
    assert f.forecast_at("H").count() == 48
    assert f.forecast_at("D").count() == 14
    with pytest.raises(ValueError):
        f.forecast_at("15min")
    with pytest.raises(ValueError):
        Forecaster("nothing").fit(df)
    assert {r.n_forecast for r in f.summary().collect()} == {24}
    assert set(f.results()) == {"series", "summary", "forecast"}
    assert f.evaluate(n_windows=2).count() == 12


def test_adf_autolag_equals_separate_fits(spark):
    rng = np.random.default_rng(12)
    ar3 = np.zeros(400)
    for t in range(3, 400):
        ar3[t] = 0.3 * ar3[t - 1] + 0.2 * ar3[t - 2] + 0.35 * ar3[t - 3] + rng.normal()
    named = {"ar3": ar3, "walk": np.cumsum(rng.normal(size=300)), "white": rng.normal(size=120), "brief": rng.normal(size=11), "tiny": np.array([1.0, 3.0, 2.0])}
    df = spark.createDataFrame([(u, i, float(v)) for u, y in named.items() for i, v in enumerate(y)], "unique_id string, i int, y double").selectExpr(
        "unique_id", "cast(timestamp_seconds(i * 3600) as timestamp_ntz) as ds", "y")

    def ols(y, lags, first):
        d = np.diff(y)
        x = np.array([[1.0, y[t - 1], *[d[t - 1 - k] for k in range(1, lags + 1)]] for t in range(first, len(y))])
        target = d[first - 1:]
        beta, *_ = np.linalg.lstsq(x, target, rcond=None)
        rss = ((target - x @ beta) ** 2).sum()
        se = np.sqrt(rss / (len(x) - len(beta)) * np.linalg.inv(x.T @ x)[1, 1])
        return len(x) * np.log(rss / len(x)) + 2 * len(beta), beta[1], beta[1] / se, len(x)

    for top in (6, None):
        found = {r["unique_id"]: r for r in stats.adf_autolag(df, top).collect()}
        assert set(found) == {"ar3", "walk", "white", "brief"}
        for uid, row in found.items():
            y = named[uid]
            own = min(6 if top else stats.default_max_lag(len(y)), stats.default_max_lag(400) if top is None else 6, (len(y) - 4) // 2)
            scores = [ols(y, k, own + 1)[0] for k in range(own + 1)]
            _, gamma, stat, n = ols(y, int(np.argmin(scores)), int(np.argmin(scores)) + 1)
            assert (row["lags"], row["n_obs"]) == (int(np.argmin(scores)), n)
            assert row["gamma"] == pytest.approx(gamma, rel=1e-6) and row["adf_stat"] == pytest.approx(stat, rel=1e-6)
        assert found["ar3"]["lags"] >= 2 and not found["walk"]["stationary"] and found["white"]["stationary"]

"""ARIMA with moving-average terms: block scans against plain loops, recovery of planted models, forecasts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from zephyrgrid.models import arima
from zephyrgrid.operators.recurrence import Recurrence


@pytest.fixture
def series(spark):
    def make(named):
        import pandas as pd
        frames = [pd.DataFrame({"unique_id": uid, "k": np.arange(len(y)), "y": np.asarray(y, dtype=float)}) for uid, y in named.items()]
        rows = spark.createDataFrame(pd.concat(frames), "unique_id string, k long, y double")
        return rows.select("unique_id", F.timestamp_seconds(F.col("k") * 3600).cast("timestamp_ntz").alias("ds"), "y")
    return make


def arma(n, ar, ma, seed, noise=1.0):
    rng = np.random.default_rng(seed)
    e, y = rng.normal(scale=noise, size=n + 200), np.zeros(n + 200)
    for t in range(50, n + 200):
        y[t] = e[t] + sum(c * y[t - k] for k, c in ar.items()) + sum(c * e[t - k] for k, c in ma.items())
    return y[200:]


@pytest.mark.parametrize(("coefficients", "reach", "n"), [({1: 0.5}, 1, 1000), ({1: 0.5, 24: 0.3, 25: 0.15}, 26, 1003), ({}, 3, 50), ({2: -0.4}, 5, 7), ({1: 0.9}, 4, 0)])
def test_recurrence_against_a_loop(coefficients, reach, n):
    rng = np.random.default_rng(0)
    made = Recurrence(coefficients, reach)
    u, state = rng.normal(size=n), rng.normal(size=made.reach)
    x = list(state[::-1])
    for t in range(n):
        x.append(u[t] - sum(c * x[-k] for k, c in coefficients.items()))
    want = np.array(x[made.reach:])
    assert np.allclose(made.run(u, state), want)
    composed = made.state_after(made.run(u), np.zeros(made.reach)) + made.transition(n) @ state
    assert np.allclose(composed, made.state_after(want, state))


@pytest.mark.parametrize("block_rows", [64, 1 << 14])
def test_innovations_do_not_depend_on_blocks(series, block_rows):
    named = {"a": arma(700, {1: 0.5}, {1: 0.4, 12: 0.3, 13: 0.1}, 1), "b": arma(90, {}, {1: -0.6}, 2)}
    frame = series(named)
    rows = arima.differenced(frame, 12, 0, 0)
    params = arima.fixed(frame, {1: 0.5, 12: 0.2}, {1: 0.4, 12: 0.3, 13: 0.1})
    got = arima.innovations(rows, params, 13, block_rows).toPandas()
    for uid, y in named.items():
        w = y - y.mean()
        e = np.zeros(len(w))
        for t in range(12, len(w)):
            e[t] = w[t] - 0.5 * w[t - 1] - 0.2 * w[t - 12] - sum(c * e[t - k] for k, c in {1: 0.4, 12: 0.3, 13: 0.1}.items() if t >= k)
        assert np.allclose(got[got.unique_id == uid].sort_values("pos")["e"].to_numpy(), e)


def test_planted_models_come_back(series):
    planted = {"ma1": ({}, {1: 0.6}), "arma11": ({1: 0.7}, {1: 0.4}), "ma2": ({}, {1: -0.5, 2: 0.3}), "sma": ({}, {1: 0.5, 12: 0.4, 13: 0.2})}
    frame = series({name: 5 + arma(6000, *model, seed=i) for i, (name, model) in enumerate(planted.items())})
    # The orders are given here, so that every coefficient can be compared.
    for name, (ar, ma) in planted.items():
        only = frame.filter(F.col("unique_id") == name)
        row = arima.fit(only, 12, 0, 0, candidates=[(tuple(ar), tuple(ma), "planted")], block_rows=1000).first()
        assert np.allclose(row["ar"], list(ar.values()), atol=0.06) and np.allclose(row["ma"], list(ma.values()), atol=0.06), name
        assert abs(row["sigma2"] - 1) < 0.08 and abs(row["mean"] - 5) < 0.2


def test_search_prefers_moving_averages_where_they_are_due(series):
    frame = series({"ma1": arma(4000, {}, {1: 0.8}, 7), "ar1": arma(4000, {1: 0.8}, {}, 8), "white": arma(3000, {}, {}, 9), "short": arma(12, {}, {}, 1)})
    found = {r["unique_id"]: r for r in arima.fit(frame, 12).collect()}
    assert set(found) == {"ma1", "ar1", "white"}
    assert 1 in found["ma1"]["ma_lags"] and abs(found["ma1"]["ma"][list(found["ma1"]["ma_lags"]).index(1)] - 0.8) < 0.3
    assert 1 in found["ar1"]["ar_lags"]
    for name in ("ma1", "ar1", "white"):
        assert abs(found[name]["sigma2"] - 1) < 0.1, name


def test_steps_never_raise_the_sum_of_squares(series):
    frame = series({"x": arma(800, {1: 0.3}, {1: 0.9}, 3), "y": arma(500, {1: -0.4, 2: 0.3}, {1: -0.7}, 4)})
    rows = arima.differenced(frame, 12, 0, 0)
    picked = arima.search(rows, 12, [((1, 2), (1,), "x")])
    sums = []
    for steps in (0, 1, 3):
        sums.append({r["unique_id"]: r["sigma2"] for r in arima.refine(rows, picked, 2, steps, 128).collect()})
    assert all(b[k] <= a[k] + 1e-12 for a, b in zip(sums, sums[1:]) for k in a)


def test_forecast_of_a_differenced_seasonal_series(series):
    t = np.arange(1200)
    y = 0.01 * t + 10 * np.sin(2 * np.pi * t / 12) + arma(1200, {}, {1: 0.5}, 11, 0.3)
    frame = series({"s": y[:1176]})
    fitted = arima.fit(frame, 12)
    row = fitted.first()
    assert row["seasonal_d"] == 1
    made = arima.forecast(frame, 24, 3600, 12, (80,), params=fitted).orderBy("horizon_step").collect()
    errors = np.array([r["yhat"] for r in made]) - y[1176:]
    assert np.sqrt((errors ** 2).mean()) < 1.0 and all(r["lo"] < r["yhat"] < r["hi"] for r in made)
    again = arima.forecast(frame, 24, 3600, 12, (80,)).orderBy("horizon_step").collect()
    assert np.allclose([r["yhat"] for r in again], [r["yhat"] for r in made])


def test_path_against_a_plain_recursion():
    class Par:
        ar_lags, ar, ma_lags, ma, d, seasonal_d, mean = [1], [0.5], [1], [0.4], 1, 0, 0.0
    y = np.array([1.0, 2.0, 4.0])
    w, e = np.diff(y), np.array([0.0, 0.3])
    yhat, factors = arima.path(y, w, e, Par, 12, 3)
    w1 = 0.5 * 2 + 0.4 * 0.3
    assert np.allclose(yhat, [4 + w1, 4 + w1 + 0.5 * w1, 4 + w1 + 0.5 * w1 + 0.25 * w1])
    # psi of ARIMA(1,1,1): 1, 1 + 0.9, 1 + 0.9 + 0.45
    assert np.allclose(factors, np.cumsum(np.square([1, 1.9, 2.35])))


def test_folds_equal_separate_fits(series):
    from zephyrgrid.models.folds import FoldPlan
    y = arma(400, {1: 0.6}, {1: 0.3}, 21)
    plan, frame = FoldPlan(3, 5, 2), series({"a": y, "b": y[50:] * 2})
    folds = arima.predict_folds(frame, plan, 12, [((1,), (1,), "x")]).toPandas()
    for uid, values in (("a", y), ("b", y[50:] * 2)):
        for fold in range(2):
            cut = len(values) - 3 - (1 - fold) * 5
            alone = arima.forecast(series({uid: values[:cut]}), 3, 3600, 12, (80,), candidates=[((1,), (1,), "x")]).orderBy("horizon_step").toPandas()
            got = folds[(folds.unique_id == uid) & (folds.fold == fold)].sort_values("horizon_step")
            assert np.allclose(got["yhat"], alone["yhat"])

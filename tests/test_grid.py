"""Grid, cleaning and roll-up semantics against pandas, on hand-made frames."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from zephyrgrid.functions.weather import circular_mean
from zephyrgrid.operators import clean, grid, rollup


def stamps(df, column, *values):
    out = df.orderBy(column).toPandas()
    return out


def test_interpolation_ends(frame):
    rows = [("a", f"2024-01-01 0{h}:00:00", v) for h, v in enumerate([None, 1.0, None, 4.0, None])]
    out = grid.regrid(frame(rows, "id string, time timestamp_ntz, v double"), ["id"], "time", ["v"], step=1800)
    got = out.orderBy("time").toPandas().v
    want = pd.Series([np.nan, np.nan, 1, 1.75, 2.5, 3.25, 4, 4, 4])
    pd.testing.assert_series_equal(got, want, check_names=False)


def test_off_grid_rows_are_dropped(frame):
    rows = [("a", "2024-01-01 00:00:00", 1.0), ("a", "2024-01-01 00:20:00", 2.0), ("a", "2024-01-01 01:00:00", 4.0)]
    out = grid.regrid(frame(rows, "id string, time timestamp_ntz, v double"), ["id"], "time", ["v"], step=1800)
    assert [r.v for r in out.orderBy("time").collect()] == [1.0, 2.5, 4.0]


def test_regrid_against_pandas(frame):
    rng = np.random.default_rng(0)
    times = pd.date_range("2024-01-01", periods=400, freq="h")
    keep = np.sort(rng.choice(400, 200, replace=False))
    values = np.where(rng.random(200) < 0.3, np.nan, rng.integers(0, 50, 200).astype(float))
    pdf = pd.DataFrame({"time": times[keep], "v": values})
    rows = [("a", str(t), None if np.isnan(v) else float(v)) for t, v in zip(pdf.time, pdf.v)]
    got = grid.regrid(frame(rows, "id string, time timestamp_ntz, v double"), ["id"], "time", ["v"]).orderBy("time").toPandas()
    want = pdf.set_index("time").resample("15min").interpolate("linear")
    assert (got.time.to_numpy() == want.index.to_numpy()).all()
    np.testing.assert_allclose(got.v.to_numpy(), want.v.to_numpy())


def test_interpolate_rows_ignores_time(frame):
    rows = [("a", "2024-01-01 00:00:00", None), ("a", "2024-01-01 01:00:00", 1.0), ("a", "2024-01-05 00:00:00", None),
            ("a", "2024-01-05 01:00:00", 4.0), ("a", "2024-02-01 00:00:00", None)]
    out = grid.interpolate_rows(frame(rows, "id string, time timestamp_ntz, v double"), ["id"], "time", ["v"])
    assert [r.v for r in out.orderBy("time").collect()] == [None, 1.0, 2.5, 4.0, 4.0]


def test_frequency_tie_picks_the_smallest_and_series_stay_apart(frame):
    minutes = [0, 60, 120, 135, 150]
    rows = [("tie", str(dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m))) for m in minutes]
    rows += [("day", f"2024-01-0{d} 00:00:00") for d in range(1, 6)]
    out = {r.unique_id: r for r in grid.detect_frequency(frame(rows, "unique_id string, ds timestamp_ntz")).collect()}
    assert (out["tie"].step_seconds, out["tie"].freq, out["tie"].season) == (900, "15min", 96)
    assert (out["day"].freq, out["day"].season) == ("D", 7)


def test_bridge_adds_even_points(frame):
    series = frame([("a", "2024-01-01 00:00:00", 9.0), ("a", "2024-01-01 01:00:00", 10.0)], "unique_id string, ds timestamp_ntz, y double")
    fc = frame([("a", "2024-01-01 06:00:00", 20.0, 15.0, 30.0)], "unique_id string, ds timestamp_ntz, yhat double, lo double, hi double")
    out = grid.bridge(series, fc, 3600).orderBy("ds").toPandas()
    assert out.part.tolist() == ["bridge"] + ["gap"] * 4 + ["forecast"]
    np.testing.assert_allclose(out.yhat, [10, 12, 14, 16, 18, 20])
    np.testing.assert_allclose(out.hi, [10, 14, 18, 22, 26, 30])
    # Three points at least, at uneven times, for a short gap.
    near = frame([("a", "2024-01-01 03:30:00", 20.0, 20.0, 20.0)], "unique_id string, ds timestamp_ntz, yhat double, lo double, hi double")
    short = grid.bridge(series, near, 3600).filter("part = 'gap'").orderBy("ds").toPandas()
    want = pd.date_range("2024-01-01 02:00", "2024-01-01 02:30", periods=3)
    assert short.ds.tolist() == want.tolist()


def test_fold_cutoffs_skip_short_series(frame):
    rows = [("long", str(t), 1.0) for t in pd.date_range("2024-01-01", periods=30, freq="h")]
    rows += [("short", str(t), 1.0) for t in pd.date_range("2024-01-01", periods=9, freq="h")]
    out = grid.fold_cutoffs(frame(rows, "unique_id string, ds timestamp_ntz, y double"), 4, 3, 3)
    got = {(r.unique_id, r.fold): r.n_train for r in out.collect()}
    assert got == {("long", i): 30 - 4 - (2 - i) * 3 for i in range(3)} | {("short", 1): 2, ("short", 2): 5}


def test_decomposition_of_odd_period(frame):
    y = [float((i % 3) * 2 + i) for i in range(30)]
    rows = [("a", str(t), v) for t, v in zip(pd.date_range("2024-01-01", periods=30, freq="h"), y)]
    out = grid.seasonal_decompose(frame(rows, "unique_id string, ds timestamp_ntz, y double"), 3).orderBy("ds").toPandas()
    want = pd.Series(y).rolling(3, center=True).mean()
    pd.testing.assert_series_equal(out.trend, want, check_names=False)
    assert out.resid.abs().max() < 1e-9


def test_empty_and_all_null_days(frame):
    rows = [("a", "2024-01-01 00:00:00", 1.0, None), ("a", "2024-01-01 05:00:00", None, None), ("a", "2024-01-03 00:00:00", None, None)]
    out = rollup.daily_rollup(frame(rows, "id string, time timestamp_ntz, temp double, prcp double"), ["id"], "time").orderBy("day").collect()
    assert [r.tavg for r in out] == [1.0, None, None]
    assert [r.prcp for r in out] == [0.0, 0.0, 0.0]
    assert [r.tmax for r in out] == [1.0, None, None]


def test_weeks_end_on_sunday(frame):
    times = pd.date_range("2024-01-04", periods=12 * 24, freq="h")
    df = frame([("a", str(t), 1.0) for t in times], "id string, time timestamp_ntz, prcp double")
    out = rollup.weekly_rollup(df, ["id"], "time").orderBy("week").collect()
    assert [(r.week.day, r.prcp) for r in out] == [(7, 96.0), (14, 168.0), (21, 24.0)]


def test_only_present_measures_are_rolled_up(frame):
    df = frame([("a", "2024-01-01 00:00:00", 1.0)], "id string, time timestamp_ntz, pres double")
    assert rollup.daily_rollup(df, ["id"], "time").columns == ["id", "day", "pres"]


@pytest.mark.parametrize("degrees, want", [([350.0, 10.0], 0.0), ([90.0, 180.0, None], 135.0), ([None, None], None)])
def test_circular_mean(frame, degrees, want):
    got = frame([(d,) for d in degrees], "wdir double").agg(circular_mean("wdir").alias("m")).first().m
    if want is None:
        assert got is None
    else:
        assert 0 <= got < 360 + 1e-9 and min(abs(got - want), 360 - abs(got - want)) < 1e-9


def test_fill_directions(frame):
    rows = [("a", f"2024-01-0{i + 1} 00:00:00", v, s) for i, (v, s) in enumerate([(None, None), (1.0, "x"), (None, None)])]
    df = frame(rows, "id string, time timestamp_ntz, v double, s string")
    assert [r.v for r in clean.fill(df, ["id"], "time", ["v"]).orderBy("time").collect()] == [None, 1.0, 1.0]
    both = clean.fill(df, ["id"], "time", ["v", "s"], True, True).orderBy("time").collect()
    assert [(r.v, r.s) for r in both] == [(1.0, "x")] * 3


def test_guards(frame):
    one = frame([("a", "2024-01-01 00:00:00", 5.0), ("b", "2024-01-01 00:00:00", 5.0), ("b", "2024-01-02 00:00:00", 5.0)],
                "id string, time timestamp_ntz, v double")
    assert {r.id for r in clean.min_rows(one, ["id"]).collect()} == {"b"}
    z = clean.zscore(one, ["id"], ["v"], ["time"]).collect()
    assert all(r.v_z is None for r in z)
    assert all(r.v_std == 0.0 for r in clean.standard_scale(one, ["id"], ["v"], ["time"]).collect())
    assert all(r.scaled == 0.0 for r in clean.minmax_scale(one, ["id"], "v", ["time"]).collect())
    with pytest.raises(ValueError):
        clean.require_columns(one)


def test_validation_counts(frame):
    rows = [("a", "2024-01-01 00:00:00", 1.0), ("a", "2024-01-01 00:00:00", None), ("a", "2024-01-02 00:00:00", float("inf"))]
    out = clean.validate_series(frame(rows, "unique_id string, ds timestamp_ntz, y double")).first()
    assert (out.n_rows, out.n_null, out.n_not_finite, out.n_duplicate_ds) == (3, 1, 1, 1)


def test_log_of_non_positive_is_missing(frame):
    out = clean.log_transform(frame([(1.0,), (0.0,), (-3.0,)], "y double"), "y").collect()
    assert sorted((r.y, r.log_y) for r in out) == [(-3.0, None), (0.0, None), (1.0, 0.0)]

"""Block helpers with tiny blocks against whole-series pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from zephyrgrid.operators import blocks

SIZES = [7, 60, 3600, 10 ** 7]


@pytest.fixture(scope="module")
def uneven(spark):
    """Three series, one with two thirds of the rows, irregular steps and gaps."""
    rng = np.random.default_rng(5)
    parts = []
    for uid, n in (("hot", 400), ("b", 90), ("one", 1)):
        at = np.cumsum(rng.integers(1, 200, n))
        y = np.where(rng.random(n) < 0.4, np.nan, rng.integers(0, 30, n).astype(float))
        parts.append(pd.DataFrame({"id": uid, "sec": at, "y": y}))
    pdf = pd.concat(parts, ignore_index=True)
    df = spark.createDataFrame(pdf.sample(frac=1, random_state=1)).select(
        "id", F.timestamp_seconds("sec").cast("timestamp_ntz").alias("ds"), "sec",
        F.when(~F.isnan("y"), F.col("y")).alias("y"))
    return df.cache(), pdf.sort_values(["id", "sec"]).reset_index(drop=True)


def collect(df):
    return df.toPandas().sort_values(["id", "sec"]).reset_index(drop=True)


@pytest.mark.parametrize("size", SIZES)
def test_position(uneven, size):
    df, pdf = uneven
    got = collect(blocks.with_position(df, ["id"], ["ds"], "pos", "n", block_seconds=size))
    assert (got.pos == pdf.groupby("id").cumcount()).all()
    assert (got.n == pdf.groupby("id")["sec"].transform("size")).all()


@pytest.mark.parametrize("rows", [1, 5, 64, 10 ** 6])
def test_row_blocks(uneven, rows):
    df, pdf = uneven
    placed = blocks.with_position(df, ["id"], ["ds"])
    got = collect(blocks.row_blocks(
        placed, ["id"],
        lambda w: {"before": F.lag("y", 4).over(w), "after": F.lead("y", 2).over(w),
                   "total": F.sum("y").over(w.rowsBetween(-3, 2))},
        back=4, ahead=2, block_rows=rows))
    g = pdf.groupby("id")["y"]
    pd.testing.assert_series_equal(got.before, g.shift(4), check_names=False)
    pd.testing.assert_series_equal(got.after, g.shift(-2), check_names=False)
    # Six rows from three behind to two ahead.
    want = pd.Series(np.nan, index=pdf.index)
    for _, part in pdf.groupby("id"):
        y = part.y.to_numpy()
        for i, idx in enumerate(part.index):
            frame = y[max(0, i - 3):i + 3]
            want[idx] = np.nan if np.isnan(frame).all() else np.nansum(frame)
    pd.testing.assert_series_equal(got.total, want, check_names=False)


@pytest.mark.parametrize("size", SIZES)
def test_known_around(uneven, size):
    df, pdf = uneven
    got = collect(blocks.known_around(df, ["id"], "ds", ["y"], block_seconds=size).select(
        "id", "sec", F.col("y_prev").alias("p"), F.col("y_next").alias("n")))
    g = pdf.groupby("id")["y"]
    pd.testing.assert_series_equal(got.p, g.ffill(), check_names=False)
    pd.testing.assert_series_equal(got.n, g.bfill(), check_names=False)
    strict = collect(blocks.known_around(df, ["id"], "ds", ["y"], "before", "after", size).select(
        "id", "sec", F.col("y_prev").alias("p"), F.col("y_next").alias("n")))
    pd.testing.assert_series_equal(strict.p, g.transform(lambda s: s.ffill().shift(1)), check_names=False)
    pd.testing.assert_series_equal(strict.n, g.transform(lambda s: s.bfill().shift(-1)), check_names=False)


@pytest.mark.parametrize("size", SIZES)
def test_previous_row_keeps_nulls(uneven, size):
    df, pdf = uneven
    got = collect(blocks.previous_row(df, ["id"], "ds", ["y"], block_seconds=size))
    pd.testing.assert_series_equal(got.prev_y, pdf.groupby("id")["y"].shift(1), check_names=False)


@pytest.mark.parametrize("size", [100, 500, 10 ** 6])
def test_time_blocks(uneven, size):
    df, pdf = uneven
    got = collect(blocks.time_blocks(
        df, ["id"], "ds", lambda w: {"n": F.count("sec").over(w.rangeBetween(-499, 0))}, 500, size))
    want = [((pdf.id == r.id) & (pdf.sec > r.sec - 500) & (pdf.sec <= r.sec)).sum() for r in pdf.itertuples()]
    assert got.n.tolist() == want


def test_attach(uneven, spark):
    df, pdf = uneven
    dims = spark.createDataFrame([("hot", 1), ("b", 2)], "id string, v int")
    got = collect(blocks.attach(df, dims, ["id"], ["sec"]))
    assert len(got) == len(pdf)
    assert got.v.fillna(0).astype(int).tolist() == pdf.id.map({"hot": 1, "b": 2}).fillna(0).astype(int).tolist()
    assert blocks.attach(df, dims, ["id"], ["sec"], "inner").count() == 490


@pytest.mark.parametrize("buckets", [2, 8, 256])
def test_exact_quantiles(uneven, buckets):
    df, pdf = uneven
    probs = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.925, "e": 1.0}
    got = blocks.exact_quantiles(df, ["id"], "y", probs, buckets).toPandas().set_index("id")
    for uid, part in pdf.groupby("id"):
        y = part.y.dropna()
        if len(y):
            for name, p in probs.items():
                assert got.loc[uid, name] == pytest.approx(np.quantile(y, p))


def test_quantiles_of_skewed_values(spark):
    values = [0.0] * 500 + [float(2 ** i) for i in range(40)] + [-1.0]
    df = spark.createDataFrame([("x", v) for v in values], "id string, y double")
    got = blocks.exact_quantiles(df, ["id"], "y", {"lo": 0.001, "mid": 0.5, "hi": 0.99}, 16).first()
    assert [got.lo, got.mid, got.hi] == pytest.approx(np.quantile(values, [0.001, 0.5, 0.99]).tolist())

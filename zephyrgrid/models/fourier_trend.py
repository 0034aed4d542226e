"""Piecewise-linear trend plus Fourier seasons by ridge regression, for every series and fold at once.

The features depend on the time only, so prediction is a closed-form column expression. Sums of products
are formed per Arrow batch with numpy and added up by Spark; the solve sees one small matrix per series.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timeaxis import DAY, epoch, shift
from ..operators.blocks import attach
from .common import FORECAST_COLUMNS, ridge, with_levels
from .folds import FULL, FoldPlan, numbered, test_rows

NAME = "FourierTrend"
CHANGEPOINTS = 5
HINGE_PENALTY, SEASON_PENALTY = 10.0, 0.01


def seasons(freq: str) -> dict[str, tuple[float, int]]:
    """Period in days and Fourier order of each season, by frequency."""
    out = {"weekly": (7.0, 3), "yearly": (365.25, 10)}
    if freq in ("15min", "H"):
        out["daily"] = (1.0, 4)
    if freq == "15min":
        out["intraday"] = (1.0, 5)  # a second daily term: its period is 24 / 24 of a day
    return out


def _blocks(freq: str) -> dict[str, int]:
    """Number of coefficients per component, in design order."""
    return {"trend": 2 + CHANGEPOINTS} | {name: 2 * order for name, (_, order) in seasons(freq).items()}


def design(ds, freq: str) -> Column:
    """Feature array at a time, given the series' ``t0`` and ``span`` in seconds."""
    t = (epoch(ds) - F.col("t0")) / F.col("span")
    cells = [F.lit(1.0), t]
    # Change points cover the first 80 % of the history.
    cells += [F.greatest(F.lit(0.0), t - 0.8 * (j + 1) / (CHANGEPOINTS + 1)) for j in range(CHANGEPOINTS)]
    days = epoch(ds) / F.lit(float(DAY))
    for period, order in seasons(freq).values():
        for k in range(1, order + 1):
            angle = days * F.lit(2 * math.pi * k / period)
            cells += [F.sin(angle), F.cos(angle)]
    return F.array(*[c.cast("double") for c in cells])


def _penalty(freq: str) -> list[float]:
    rest = sum(_blocks(freq).values()) - 2 - CHANGEPOINTS
    return [0.0, 0.0] + [HINGE_PENALTY] * CHANGEPOINTS + [SEASON_PENALTY] * rest


def _scales(rows: DataFrame) -> DataFrame:
    """Time origin, span and mean of each series, over the first fold's training rows: no fold sees rows after its cut."""
    return rows.filter(F.col("segment") == 0).groupBy("unique_id").agg(
        epoch(F.min("ds")).alias("t0"), (epoch(F.max("ds")) - epoch(F.min("ds"))).alias("_s"),
        F.avg("y").alias("mean"),
    ).select("unique_id", "t0", F.greatest("_s", F.lit(1)).alias("span"), "mean")


def _partial_sums(keys: Sequence[str]):
    def run(batches):
        for pdf in batches:
            out = []
            for key, part in pdf.groupby(list(keys), sort=False):
                x = np.column_stack([np.stack(part["x"].to_numpy()), part["y"].to_numpy()])
                gram = x.T @ x
                out.append((*key, len(part), gram[np.triu_indices(x.shape[1])].tolist()))
            yield pd.DataFrame(out, columns=[*keys, "n_obs", "gram"])
    return run


def fit(series: DataFrame, freq: str = "H", plan: FoldPlan = FULL) -> DataFrame:
    """One row per series and fold: coefficients, variance and the time scale they refer to."""
    if plan == FULL:
        rows = series.withColumn("segment", F.lit(0))
    else:
        rows = numbered(series).withColumn("segment", plan.segment()).filter(F.col("segment") < plan.n_windows)
    scales = _scales(rows)
    scaled = attach(rows.filter(F.col("y").isNotNull()), scales, ["unique_id"], ["ds"], "inner")
    features = scaled.select("unique_id", "segment", design("ds", freq).alias("x"), (F.col("y") - F.col("mean")).alias("y"))
    partial = features.mapInPandas(
        _partial_sums(["unique_id", "segment"]), "unique_id string, segment int, n_obs bigint, gram array<double>")
    cells = partial.select("unique_id", "segment", "n_obs", F.posexplode("gram").alias("i", "g")).groupBy(
        "unique_id", "segment", "i").agg(F.sum("g").alias("g"), F.sum("n_obs").alias("n_obs"))
    sums = cells.groupBy("unique_id", "segment").agg(
        F.max("n_obs").alias("n_obs"),
        F.transform(F.array_sort(F.collect_list(F.struct("i", "g"))), lambda s: s["g"]).alias("gram"))
    packed = sums.groupBy("unique_id").agg(
        F.array_sort(F.collect_list(F.struct("segment", "n_obs", "gram"))).alias("parts"))
    size, penalty = sum(_blocks(freq).values()) + 1, _penalty(freq)

    def solve(batches):
        for pdf in batches:
            out = []
            for uid, parts in zip(pdf.unique_id, pdf.parts):
                by_segment = {p["segment"]: p for p in parts}
                total, n = np.zeros(size * (size + 1) // 2), 0
                for fold in range(plan.n_windows):
                    if fold in by_segment:
                        total = total + np.array(by_segment[fold]["gram"], dtype=float)
                        n += by_segment[fold]["n_obs"]
                    if n >= 2:
                        beta, sigma2 = ridge(total, n, size, penalty)
                        out.append((uid, fold, int(n), beta.tolist(), float(sigma2)))
            yield pd.DataFrame(out, columns=["unique_id", "fold", "n_obs", "coef", "sigma2"])

    solved = packed.mapInPandas(
        solve, "unique_id string, fold int, n_obs bigint, coef array<double>, sigma2 double")
    return solved.join(scales, "unique_id")


def _dot(coef, features) -> Column:
    return F.aggregate(F.zip_with(coef, features, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)


def predict_at(times: DataFrame, params: DataFrame, freq: str, keys: Sequence[str] = ("unique_id", "fold")) -> DataFrame:
    """Predictions at any times; bounds are a constant deviation wide."""
    joined = attach(times, params, list(keys), ["ds"], "inner")
    return joined.withColumns({
        "yhat": F.col("mean") + _dot(F.col("coef"), design("ds", freq)), "sd": F.sqrt("sigma2"),
    }).select(*times.columns, "yhat", "sd")


def forecast(series: DataFrame, h: int, step: int, freq: str = "H", levels: Sequence[int] = (80,),
             params: DataFrame | None = None) -> DataFrame:
    fitted = fit(series, freq) if params is None else params
    ends = series.groupBy("unique_id").agg(F.max("ds").alias("last_ds"))
    times = ends.withColumn("horizon_step", F.explode(F.sequence(F.lit(1), F.lit(h)))).select(
        "unique_id", shift("last_ds", F.col("horizon_step") * step).alias("ds"), "horizon_step",
        F.lit(0).alias("fold"), F.lit(NAME).alias("model"))
    return with_levels(predict_at(times, fitted, freq), F.col("sd"), levels).select(*FORECAST_COLUMNS)


def predict_folds(series: DataFrame, params: DataFrame, plan: FoldPlan, freq: str) -> DataFrame:
    return predict_at(test_rows(numbered(series), plan), params, freq)


def components(times: DataFrame, params: DataFrame, freq: str = "H") -> DataFrame:
    """Trend and seasonal parts of the fit at the given times."""
    joined = attach(times, params.filter(F.col("fold") == 0), ["unique_id"], ["ds"], "inner").withColumn(
        "_x", design("ds", freq))
    parts, start = {}, 1
    for name, count in _blocks(freq).items():
        part = _dot(F.slice("coef", start, count), F.slice("_x", start, count))
        parts[name] = part + F.col("mean") if name == "trend" else part
        start += count
    return joined.withColumns(parts).select("unique_id", "ds", *parts)


def trend_line(series: DataFrame) -> DataFrame:
    """Straight line through each series over days since its first row, in closed form."""
    scales = series.groupBy("unique_id").agg(F.min("ds").alias("_first"))
    days = (epoch("ds") - epoch("_first")) / F.lit(float(DAY))
    rows = attach(series, scales, ["unique_id"], ["ds"]).withColumn("day", days)
    return rows.groupBy("unique_id").agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope("y", "day").alias("slope"),
        F.regr_intercept("y", "day").alias("intercept"), F.regr_r2("y", "day").alias("r2"))

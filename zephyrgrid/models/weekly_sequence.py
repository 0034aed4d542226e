"""Week-ahead model on daily means: linear in the last seven scaled values, seven recursive steps."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timeaxis import DAY, shift
from ..operators.blocks import attach, exact_quantiles, row_blocks
from ..operators.clean import minmax_scale
from ..operators.stats import gram_columns
from ..session import stage
from .common import FORECAST_COLUMNS, ridge
from .folds import FULL, FoldPlan, numbered, tails

NAME = "WeeklySequence"
LENGTH = 7
_X = [f"x{k}" for k in range(1, LENGTH + 1)]


def scale(daily: DataFrame) -> DataFrame:
    """Daily values in [0, 1] per series, as a staged table: every later step starts from it."""
    scaled = minmax_scale(daily.filter(F.col("y").isNotNull()), ["unique_id"], "y", ["ds"])
    return stage(scaled.select("unique_id", "ds", "y", "scaled", "lo", "span"), "scaled-days")


def _rows(scaled: DataFrame, plan: FoldPlan) -> DataFrame:
    lagged = row_blocks(
        numbered(scaled), ["unique_id"],
        lambda w: {name: F.lag("scaled", k).over(w) for k, name in enumerate(_X, 1)}, LENGTH)
    return lagged.withColumn("one", F.lit(1.0)).withColumn("segment", plan.segment()).na.drop("any", subset=_X)


def fit(scaled: DataFrame, plan: FoldPlan = FULL, penalty: float = 1e-3) -> DataFrame:
    """Coefficients (constant, then lags 1..7) per series and fold, with the scale they refer to."""
    rows = _rows(scaled, plan)
    names = ["one", *_X, "scaled"]
    sums = rows.filter(F.col("segment") < plan.n_windows).groupBy("unique_id", "segment").agg(
        *gram_columns(names), F.min("lo").alias("lo"), F.min("span").alias("span"))
    packed = sums.groupBy("unique_id").agg(
        F.array_sort(F.collect_list(F.struct("segment", "n_obs", "gram"))).alias("parts"),
        F.min("lo").alias("lo"), F.min("span").alias("span"))
    weights = [0.0] + [penalty] * LENGTH

    def solve(batches):
        size = len(names)
        for pdf in batches:
            out = []
            for uid, parts, lo, span in zip(pdf.unique_id, pdf.parts, pdf.lo, pdf.span):
                by_segment = {p["segment"]: p for p in parts}
                total, n = np.zeros(size * (size + 1) // 2), 0
                for fold in range(plan.n_windows):
                    if fold in by_segment:
                        total = total + np.array(by_segment[fold]["gram"], dtype=float)
                        n += by_segment[fold]["n_obs"]
                    if n >= 2:
                        beta, sigma2 = ridge(total, n, size, weights)
                        out.append((uid, fold, int(n), beta.tolist(), float(sigma2), float(lo), float(span)))
            yield pd.DataFrame(out, columns=["unique_id", "fold", "n_obs", "coef", "sigma2", "lo", "span"])

    return packed.mapInPandas(
        solve, "unique_id string, fold int, n_obs bigint, coef array<double>, sigma2 double, lo double, span double")


def predict(params: DataFrame, scaled: DataFrame, h: int = 7, plan: FoldPlan = FULL) -> DataFrame:
    """Recursive path in the scaled space (``scaled``) and undone (``yhat``)."""
    ends = tails(numbered(scaled), plan, LENGTH, "scaled")
    ready = params.join(ends, ["unique_id", "fold"])

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                window = list(r.tail)
                if len(window) < LENGTH:
                    continue
                coef = np.array(r.coef)
                for s in range(1, h + 1):
                    value = float(coef[0] + coef[1:] @ np.array(window[:LENGTH]))
                    window.insert(0, value)
                    out.append((r.unique_id, r.fold, r.cutoff, s, value, value * r.span + r.lo, r.lo, r.span))
            yield pd.DataFrame(out, columns=[
                "unique_id", "fold", "cutoff", "horizon_step", "scaled", "yhat", "lo_y", "span"])

    return ready.mapInPandas(
        run, "unique_id string, fold int, cutoff timestamp_ntz, horizon_step int, scaled double, yhat double,"
             " lo_y double, span double")


def fitted_errors(scaled: DataFrame, params: DataFrame) -> DataFrame:
    """One-step errors on the training rows, scaled, row by row."""
    rows = _rows(scaled, FULL).drop("lo", "span")
    joined = attach(rows, params.filter(F.col("fold") == 0).select("unique_id", "coef"), ["unique_id"], ["pos"], "inner")
    guess = sum((F.col("coef")[k] * F.col(x) for k, x in enumerate(_X, 1)), F.col("coef")[0])
    return joined.select("unique_id", (F.col("scaled") - guess).alias("e"))


def forecast(daily: DataFrame, h: int = 7, levels: Sequence[int] = (80, 95),
             params: DataFrame | None = None) -> DataFrame:
    """Bounds are error percentiles around each step, clamped to the scale's range before undoing it."""
    scaled = scale(daily)
    params = stage(fit(scaled) if params is None else params, "weekly-params")
    path = predict(params, scaled, h)
    probs = {f"{side}_{lv}": (100 + sign * lv) / 200 for lv in levels for side, sign in (("lo", -1), ("hi", 1))}
    bounds = exact_quantiles(fitted_errors(scaled, params), ["unique_id"], "e", probs)

    def bound(name: str):
        clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("scaled") + F.col(name)))
        return clamped * F.col("span") + F.col("lo_y")

    bands = F.explode(F.array(*[
        F.struct(F.lit(lv).alias("level"), bound(f"lo_{lv}").alias("lo"), bound(f"hi_{lv}").alias("hi"))
        for lv in levels]))
    return path.join(bounds, "unique_id").withColumn("_b", bands).select(
        "unique_id", shift("cutoff", F.col("horizon_step") * DAY).alias("ds"), F.lit(NAME).alias("model"),
        "horizon_step", "yhat", "_b.level", "_b.lo", "_b.hi")

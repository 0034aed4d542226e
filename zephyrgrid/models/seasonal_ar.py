"""Seasonal autoregression chosen by AICc, for every series and fold at once.

Level and differenced models over lags 1, 2 and the season are all linear in the same six regressors
(constant and lags 1, 2, 3, m, m + 1), so one set of 28 product sums per series fits every candidate.
There are no moving-average terms.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timeaxis import shift
from ..operators.blocks import attach, row_blocks
from ..operators.stats import gram_columns, unpack_gram
from .common import FORECAST_COLUMNS, with_levels
from .folds import FULL, FoldPlan, numbered, tails

NAME = "SeasonalAR"
REGRESSORS = ["one", "l1", "l2", "l3", "lm", "lm1"]
# (differences, lags) with "m" for the seasonal lag; differenced models have no constant.
CANDIDATES = [
    (0, (1,)), (0, (1, 2)), (0, ("m",)), (0, (1, "m")), (0, (1, 2, "m")),
    (1, ()), (1, (1,)), (1, (1, 2)), (1, ("m",)), (1, (1, "m")), (1, (1, 2, "m")),
]
_AT = {1: (1, 2), 2: (2, 3), "m": (4, 5)}


def _transform(d: int, lags: Sequence) -> tuple[np.ndarray, np.ndarray]:
    """Rows: the candidate's regressors in terms of REGRESSORS; and the offset its target subtracts."""
    rows, base = [], np.zeros(len(REGRESSORS))
    if d == 0:
        rows.append(np.eye(len(REGRESSORS))[0])
    else:
        base[1] = 1.0
    for lag in lags:
        row = np.zeros(len(REGRESSORS))
        row[_AT[lag][0]] = 1.0
        if d:
            row[_AT[lag][1]] = -1.0
        rows.append(row)
    return np.array(rows).reshape(-1, len(REGRESSORS)), base


def fit_gram(gram: np.ndarray, n: int, candidates=CANDIDATES):
    """Best candidate as level-form coefficients, residual variance, AICc and name."""
    best = None
    for d, lags in candidates:
        rows, base = _transform(d, lags)
        k = len(rows)
        if n <= k + 2:
            continue
        lift = np.zeros((k + 1, len(REGRESSORS) + 1))
        lift[:k, :-1] = rows
        lift[k, :-1], lift[k, -1] = -base, 1.0
        small = lift @ gram @ lift.T
        beta = np.linalg.pinv(small[:k, :k], hermitian=True) @ small[:k, k] if k else np.zeros(0)
        rss = max(small[k, k] - beta @ small[:k, k], 1e-12)
        params = k + 1
        aicc = n * np.log(rss / n) + 2 * params + 2 * params * (params + 1) / max(n - params - 1, 1)
        if best is None or aicc < best[2] - 1e-9:
            name = f"d{d}:" + ",".join(str(x) for x in lags)
            best = (beta @ rows + base, rss / max(n - k, 1), aicc, name)
    return best


def fit(series: DataFrame, season: int = 24, plan: FoldPlan = FULL, candidates=CANDIDATES) -> DataFrame:
    """One row per series and fold: coefficients over REGRESSORS, variance, AICc, chosen model, mean.

    Rows without a target are left out before they are numbered, here and in ``predict``.
    """
    series = series.filter(F.col("y").isNotNull())
    means = series.groupBy("unique_id").agg(F.avg("y").alias("mean"))
    rows = numbered(attach(series, means, ["unique_id"], ["ds"]).withColumn("y", F.col("y") - F.col("mean")))
    reach = season + 1

    def lagged(w):
        return {"l1": F.lag("y", 1).over(w), "l2": F.lag("y", 2).over(w), "l3": F.lag("y", 3).over(w),
                "lm": F.lag("y", season).over(w), "lm1": F.lag("y", season + 1).over(w)}

    names = [*REGRESSORS, "y"]
    design = row_blocks(rows, ["unique_id"], lagged, reach).withColumn("one", F.lit(1.0)).withColumn(
        "segment", plan.segment())
    used = design.na.drop("any", subset=names).filter(F.col("segment") < plan.n_windows)
    sums = used.groupBy("unique_id", "segment").agg(*gram_columns(names), F.first("mean").alias("mean"))
    # At most n_windows short arrays per series.
    packed = sums.groupBy("unique_id").agg(
        F.array_sort(F.collect_list(F.struct("segment", "n_obs", "gram"))).alias("parts"),
        F.first("mean").alias("mean"))

    def solve(batches):
        size = len(names)
        for pdf in batches:
            out = []
            for uid, parts, mean in zip(pdf.unique_id, pdf.parts, pdf["mean"]):
                by_segment = {p["segment"]: p for p in parts}
                total, n = np.zeros(size * (size + 1) // 2), 0
                for fold in range(plan.n_windows):
                    if fold in by_segment:
                        total = total + np.array(by_segment[fold]["gram"], dtype=float)
                        n += by_segment[fold]["n_obs"]
                    best = fit_gram(unpack_gram(total, size), n, candidates)
                    if best is not None:
                        out.append((uid, fold, int(n), float(mean), best[0].tolist(), best[1], best[2], best[3]))
            yield pd.DataFrame(out, columns=[
                "unique_id", "fold", "n_obs", "mean", "coef", "sigma2", "aicc", "form"])

    return packed.mapInPandas(
        solve, "unique_id string, fold int, n_obs bigint, mean double, coef array<double>,"
               " sigma2 double, aicc double, form string")


def roll_forward(coef: np.ndarray, tail: np.ndarray, season: int, h: int) -> tuple[np.ndarray, np.ndarray]:
    """Forecasts and the cumulated variance factors of h steps; ``tail`` is newest first."""
    lags = [1, 2, 3, season, season + 1]
    past = list(tail[::-1])
    psi = np.zeros(h)
    psi[0] = 1.0
    for s in range(h):
        past.append(coef[0] + sum(
            c * past[-lag] for c, lag in zip(coef[1:], lags) if c != 0.0))
        if s:
            psi[s] = sum(c * psi[s - lag] for c, lag in zip(coef[1:], lags) if lag <= s)
    return np.array(past[-h:]), np.cumsum(psi ** 2)


def predict(params: DataFrame, series: DataFrame, season: int, h: int, plan: FoldPlan = FULL) -> DataFrame:
    """unique_id, fold, cutoff, horizon_step, yhat and sd: one bounded fold over the tail per series."""
    ends = tails(numbered(series.filter(F.col("y").isNotNull())), plan, season + 1)
    ready = params.join(ends, ["unique_id", "fold"])

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                tail = np.array(r.tail, dtype=float) - r.mean
                if len(tail) < season + 1:
                    continue
                path, spread = roll_forward(np.array(r.coef), tail, season, h)
                for s in range(h):
                    out.append((r.unique_id, r.fold, r.cutoff, s + 1, float(path[s] + r.mean),
                                float(np.sqrt(r.sigma2 * spread[s]))))
            yield pd.DataFrame(out, columns=["unique_id", "fold", "cutoff", "horizon_step", "yhat", "sd"])

    return ready.mapInPandas(
        run, "unique_id string, fold int, cutoff timestamp_ntz, horizon_step int, yhat double, sd double")


def forecast(series: DataFrame, h: int, step: int, season: int = 24, levels: Sequence[int] = (80, 95),
             candidates=CANDIDATES, params: DataFrame | None = None) -> DataFrame:
    fitted = fit(series, season, candidates=candidates) if params is None else params
    path = predict(fitted, series, season, h)
    dated = path.withColumn("ds", shift("cutoff", F.col("horizon_step") * step)).withColumn("model", F.lit(NAME))
    return with_levels(dated, F.col("sd"), levels).select(*FORECAST_COLUMNS)


def fixed_order(series: DataFrame, lags: Sequence[int] = (1, 2), d: int = 1, season: int = 24) -> DataFrame:
    """A fixed (p, d, 0) model instead of a search."""
    return fit(series, season, candidates=[(d, tuple(lags))])


def ar1(series: DataFrame) -> DataFrame:
    """First-order autoregression in closed form with AIC and BIC."""
    from ..operators.blocks import previous_row
    rows = previous_row(series, ["unique_id"], "ds", ["y"]).filter(F.col("prev_y").isNotNull())
    n, k = F.col("n"), 2
    rss = F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx")
    return rows.groupBy("unique_id").agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope("y", "prev_y").alias("phi"),
        F.regr_intercept("y", "prev_y").alias("intercept"), F.regr_sxx("y", "prev_y").alias("sxx"),
        F.regr_syy("y", "prev_y").alias("syy"), F.regr_sxy("y", "prev_y").alias("sxy"),
    ).select(
        "unique_id", "n", "phi", "intercept", rss.alias("rss"),
        (n * F.ln(rss / n) + 2 * k).alias("aic"), (n * F.ln(rss / n) + F.ln(n) * k).alias("bic"))

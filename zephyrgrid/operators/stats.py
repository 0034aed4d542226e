"""Series statistics: sums of products, autocorrelation, partial autocorrelation, unit-root tests."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import attach, row_blocks, with_position

ID = ["unique_id"]


def gram_columns(names: Sequence[str], where: Column | None = None) -> list[Column]:
    """Sums of all pairwise products as one flat array (upper triangle by rows) and a row count.

    These are plain sums: they combine map-side, so a series of any length needs no single task.
    """
    def total(expr: Column) -> Column:
        return F.sum(expr if where is None else F.when(where, expr))

    pairs = [total(F.col(a) * F.col(b)) for i, a in enumerate(names) for b in names[i:]]
    n = F.count(F.lit(1)) if where is None else F.count_if(where)
    return [F.array(*pairs).alias("gram"), n.alias("n_obs")]


def unpack_gram(flat: np.ndarray, size: int) -> np.ndarray:
    full = np.zeros((size, size))
    full[np.triu_indices(size)] = flat
    return full + np.triu(full, 1).T


def autocorrelation(series: DataFrame, lags: int = 40, value: str = "y", keys: Sequence[str] = ID) -> DataFrame:
    """Biased autocorrelation for lags 0..``lags``, one array per series, with its row count."""
    keys = list(keys)
    means = series.groupBy(*keys).agg(F.avg(value).alias("_mean"))
    centred = attach(series.select(*keys, "ds", value), means, keys, ["ds"]).select(
        *keys, "ds", (F.col(value) - F.col("_mean")).alias("z"))
    numbered = with_position(centred, keys, ["ds"], "pos")
    lagged = row_blocks(
        numbered, keys, lambda w: {f"z{k}": F.lag("z", k).over(w) for k in range(1, lags + 1)}, lags)
    products = lagged.groupBy(*keys).agg(
        F.count("z").alias("n_obs"), F.sum(F.col("z") * F.col("z")).alias("_v"),
        *[F.sum(F.col("z") * F.col(f"z{k}")).alias(f"_c{k}") for k in range(1, lags + 1)],
    )
    shares = [F.lit(1.0)] + [
        F.coalesce(F.col(f"_c{k}"), F.lit(0.0)) / F.nullif(F.col("_v"), F.lit(0.0)) for k in range(1, lags + 1)
    ]
    return products.select(*keys, "n_obs", F.array(*shares).alias("acf"))


def acf(series: DataFrame, lags: int = 40, value: str = "y") -> DataFrame:
    """Long form: one row per series and lag."""
    return autocorrelation(series, lags, value).select("unique_id", F.posexplode("acf").alias("lag", "acf"))


def durbin_levinson(rho: np.ndarray) -> np.ndarray:
    """Partial autocorrelations from autocorrelations ``rho[0..k]``."""
    top = len(rho) - 1
    out, phi = np.ones(top + 1), np.zeros(0)
    for k in range(1, top + 1):
        num = rho[k] - phi @ rho[k - 1:0:-1] if k > 1 else rho[1]
        den = 1.0 - phi @ rho[1:k] if k > 1 else 1.0
        last = num / den if den != 0 else np.nan
        phi = np.append(phi - last * phi[::-1], last)
        out[k] = last
    return out


def pacf(series: DataFrame, lags: int = 40, value: str = "y") -> DataFrame:
    """Yule-Walker partial autocorrelation: the recursion runs on one short array per series."""
    def solve(acfs: pd.Series) -> pd.Series:
        return acfs.map(lambda a: durbin_levinson(np.array(a, dtype=float)))

    table = autocorrelation(series, lags, value).withColumn("pacf", F.pandas_udf(solve, "array<double>")("acf"))
    return table.select("unique_id", F.posexplode("pacf").alias("lag", "pacf"))


def pacf_two_lags(series: DataFrame) -> DataFrame:
    """Lags 1 and 2 in closed form."""
    r1, r2 = F.col("acf")[1], F.col("acf")[2]
    return autocorrelation(series, 2).select(
        "unique_id", r1.alias("pacf_1"), ((r2 - r1 * r1) / (1 - r1 * r1)).alias("pacf_2"))


def adf_lag0(series: DataFrame) -> DataFrame:
    """Dickey-Fuller statistic with a constant and no lagged differences, in closed form."""
    from .blocks import previous_row
    stepped = previous_row(series, ID, "ds", ["y"]).filter(F.col("prev_y").isNotNull())
    sums = stepped.select("unique_id", (F.col("y") - F.col("prev_y")).alias("d"), F.col("prev_y").alias("x")).groupBy(
        "unique_id").agg(F.count(F.lit(1)).alias("n"), F.regr_slope("d", "x").alias("gamma"),
                         F.regr_sxx("d", "x").alias("sxx"), F.regr_syy("d", "x").alias("syy"),
                         F.regr_sxy("d", "x").alias("sxy"))
    rss = F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx")
    return sums.select("unique_id", "n", "gamma",
                       (F.col("gamma") / F.sqrt(rss / (F.col("n") - 2) / F.col("sxx"))).alias("adf_stat"))


# MacKinnon (2010) critical values with a constant, b0 + b1/n + b2/n^2 + b3/n^3.
CRITICAL = {
    "1%": (-3.43035, -6.5393, -16.786, -79.433),
    "5%": (-2.86154, -2.8903, -4.234, -40.040),
    "10%": (-2.56677, -1.5384, -2.809, 0.0),
}
# MacKinnon (1994) p-value surface with a constant, one regressor.
P_SMALL, P_LARGE = (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368)
P_STAR, P_MIN, P_MAX = -1.61, -18.83, 2.74


def _normal_cdf(x: float) -> float:
    from math import erf, sqrt
    return 0.5 * (1 + erf(x / sqrt(2)))


def adf_p_value(stat: float) -> float:
    if stat > P_MAX:
        return 1.0
    if stat < P_MIN:
        return 0.0
    terms = P_SMALL if stat <= P_STAR else P_LARGE
    return _normal_cdf(sum(c * stat ** i for i, c in enumerate(terms)))


def _adf_solve(flat, n: int, size: int):
    """OLS from sums of products; the columns are const, lagged level, differences..., target."""
    gram = unpack_gram(np.array(flat, dtype=float), size)
    xtx, xty, yty = gram[:-1, :-1], gram[:-1, -1], gram[-1, -1]
    beta, *_ = np.linalg.lstsq(xtx, xty, rcond=None)
    rss = max(yty - beta @ xty, 0.0)
    free = n - len(beta)
    inv = np.linalg.pinv(xtx)
    error = np.sqrt(rss / free * inv[1, 1]) if free > 0 and rss > 0 else np.nan
    return float(beta[1]), float(beta[1] / error)


def adf(series: DataFrame, lags: int = 1) -> DataFrame:
    """Augmented Dickey-Fuller test with a constant: statistic, p-value, critical values, verdict."""
    means = series.groupBy("unique_id").agg(F.avg("y").alias("_m"))
    level = attach(series, means, ID, ["ds"]).withColumn("y", F.col("y") - F.col("_m")).drop("_m")
    numbered = with_position(level, ID, ["ds"], "pos")

    def make(w):
        lag = [F.col("y")] + [F.lag("y", k).over(w) for k in range(1, lags + 2)]
        steps = {f"d{k}": lag[k] - lag[k + 1] for k in range(1, lags + 1)}
        return {"level": lag[1], "target": lag[0] - lag[1]} | steps

    names = ["one", "level", *[f"d{k}" for k in range(1, lags + 1)], "target"]
    rows = row_blocks(numbered, ID, make, lags + 1).withColumn("one", F.lit(1.0)).na.drop("any", subset=names)
    sums = rows.groupBy("unique_id").agg(*gram_columns(names))

    def solve(batches):
        for pdf in batches:
            out = []
            for uid, flat, n in zip(pdf.unique_id, pdf.gram, pdf.n_obs):
                gamma, stat = _adf_solve(flat, n, len(names))
                crit = {k: sum(b / n ** i for i, b in enumerate(c)) for k, c in CRITICAL.items()}
                p = adf_p_value(stat) if np.isfinite(stat) else np.nan
                out.append((uid, int(n), gamma, stat, p, crit["1%"], crit["5%"], crit["10%"], bool(p < 0.05)))
            yield pd.DataFrame(out, columns=[
                "unique_id", "n_obs", "gamma", "adf_stat", "p_value", "crit_1", "crit_5", "crit_10", "stationary"])

    return sums.mapInPandas(
        solve, "unique_id string, n_obs bigint, gamma double, adf_stat double, p_value double,"
               " crit_1 double, crit_5 double, crit_10 double, stationary boolean")


def default_max_lag(n: int) -> int:
    """Schwert's rule, kept below half of the rows."""
    return max(0, min(int(np.ceil(12 * (n / 100) ** 0.25)), n // 2 - 2))


def _adf_rows(values: np.ndarray, lags: int, first: int) -> np.ndarray:
    """Rows const, lagged level, lagged differences, target of the positions from ``first`` on."""
    d = np.diff(values)
    return np.array([[1.0, values[t - 1], *[d[t - 1 - k] for k in range(1, lags + 1)], d[t - 1]] for t in range(first, len(values))]).reshape(-1, lags + 3)


def nested_rss(gram: np.ndarray) -> np.ndarray:
    """Residual sums of squares of the models on the first 1, 2, ... columns before the last, the target, in one sweep:
    in a Cholesky factor each column takes its square from what is left."""
    size = len(gram)
    scale = np.sqrt(np.maximum(np.diag(gram), 1e-300))
    scaled = gram / np.outer(scale, scale)
    factor = np.zeros((size, size))
    for j in range(size):
        left = scaled[j, j] - factor[j, :j] @ factor[j, :j]
        factor[j, j] = np.sqrt(max(left, 0.0))
        if factor[j, j] > 1e-9 or j == size - 1:
            factor[j + 1:, j] = (scaled[j + 1:, j] - factor[j + 1:, :j] @ factor[j, :j]) / max(factor[j, j], 1e-300)
    return scale[-1] ** 2 * np.maximum(1.0 - np.cumsum(factor[-1, :-1] ** 2), 0.0)


def adf_autolag(series: DataFrame, max_lag: int | None = None) -> DataFrame:
    """Augmented Dickey-Fuller test whose number of lagged differences has the least AIC: unique_id, lags, n_obs, gamma, adf_stat,
    p_value, crit_1, crit_5, crit_10, stationary.

    All numbers of lags up to ``max_lag`` (by the length of the longest series if not given; each series stops at its own
    rule) are compared on the same rows, from one matrix of sums; the chosen one is fitted to all rows it can use: the few
    rows more lie at the start of a series, whose first values travel with the sums. Series that are too short get no row.
    """
    means = series.filter(F.col("y").isNotNull()).groupBy("unique_id").agg(F.avg("y").alias("_m"), F.count(F.lit(1)).alias("_n"))
    if max_lag is None:
        longest = means.agg(F.max("_n")).first()[0] or 0
        top = default_max_lag(longest)
    else:
        top = max_lag
    level = attach(series.filter(F.col("y").isNotNull()), means, ID, ["ds"]).withColumn("y", F.col("y") - F.col("_m"))
    rows = with_position(level, ID, ["ds"], "pos")
    head = rows.filter(F.col("pos") <= top).groupBy("unique_id", "_n").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "y"))), lambda p: p["y"]).alias("head"))

    def make(w):
        lag = [F.col("y")] + [F.lag("y", k).over(w) for k in range(1, top + 2)]
        return {"values": F.array(*lag)}

    blocks = row_blocks(rows.select("unique_id", "pos", "y"), ID, make, top + 1).filter(F.col("pos") > top)
    width = top + 3

    def partial(batches):
        for pdf in batches:
            out = []
            for uid, part in pdf.groupby("unique_id", sort=False):
                v = np.stack(part["values"].to_numpy()).astype(float)
                d = v[:, :-1] - v[:, 1:]
                x = np.column_stack([np.ones(len(v)), v[:, 1], d[:, 1:], d[:, 0]])
                out.append((uid, [float(len(x)), *(x.T @ x)[np.triu_indices(width)]]))
            yield pd.DataFrame(out, columns=["unique_id", "part"])

    cells = blocks.select("unique_id", "values").mapInPandas(partial, "unique_id string, part array<double>").select(
        "unique_id", F.posexplode("part").alias("i", "v")).groupBy("unique_id", "i").agg(F.sum("v").alias("v"))
    sums = cells.groupBy("unique_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("sums"))

    def solve(batches):
        for pdf in batches:
            out = []
            for uid, rows_of, first, total in zip(pdf["unique_id"], pdf["_n"], pdf["head"], pdf["sums"]):
                made = _adf_choice(np.array(first, dtype=float), int(rows_of), None if total is None else np.array(total, dtype=float), top, max_lag)
                if made is None:
                    continue
                lags, n, gamma, stat = made
                crit = {k: sum(b / n ** i for i, b in enumerate(c)) for k, c in CRITICAL.items()}
                p = adf_p_value(stat) if np.isfinite(stat) else np.nan
                out.append((uid, lags, n, gamma, stat, p, crit["1%"], crit["5%"], crit["10%"], bool(p < 0.05)))
            yield pd.DataFrame(out, columns=["unique_id", "lags", "n_obs", "gamma", "adf_stat", "p_value", "crit_1", "crit_5", "crit_10", "stationary"])

    return head.join(sums, "unique_id", "left").mapInPandas(
        solve, "unique_id string, lags int, n_obs bigint, gamma double, adf_stat double, p_value double,"
               " crit_1 double, crit_5 double, crit_10 double, stationary boolean")


def _adf_choice(head: np.ndarray, rows: int, sums: np.ndarray | None, top: int, max_lag: int | None) -> tuple[int, int, float, float] | None:
    """Lags of least AIC and their fit: lags, rows used, coefficient of the level, statistic. Positions beyond ``top`` are in
    ``sums``; those up to it come from the first values, and so does a whole series that is no longer than they are."""
    own = min(top, max_lag if max_lag is not None else default_max_lag(rows), (rows - 4) // 2)
    if own < 0:
        return None

    def gram_of(lags: int, first: int) -> tuple[np.ndarray, int]:
        """Sums over positions from ``first`` on for a model of ``lags``."""
        keep = [*range(lags + 2), top + 2]
        total, n = np.zeros((lags + 3, lags + 3)), 0
        if sums is not None:
            total, n = unpack_gram(sums[1:], top + 3)[np.ix_(keep, keep)], int(sums[0])
        early = _adf_rows(head[:top + 1], lags, first)
        return total + early.T @ early, n + len(early)

    gram, n = gram_of(own, own + 1)
    rss = nested_rss(gram)[1:]
    scores = n * np.log(np.maximum(rss, 1e-300) / n) + 2 * (np.arange(own + 1) + 2)
    lags = int(np.argmin(scores))
    gram, n = gram_of(lags, lags + 1)
    gamma, stat = _adf_solve(gram[np.triu_indices(lags + 3)], n, lags + 3)
    return lags, n, gamma, stat

"""Seasonal ARIMA with moving-average terms, searched by AICc, for every series at once.

Work is done in blocks of rows of a series, never on a whole one; what crosses blocks is one summary row per block.

1. A row is differenced as its series asks for (see ``differences``) and centred.
2. A long autoregression, from sums of products, gives first estimates of the innovations.
3. Hannan and Rissanen's regression of a value on lagged values and lagged innovations: one matrix of sums serves every
   order (p, q)(P, Q), and AICc picks the order.
4. The innovations of the picked model are a linear recurrence and are computed exactly (``innovations``); regressing
   them on the filtered values and innovations gives a Gauss-Newton step for the coefficients, kept while it lowers the
   sum of squares.

Seasonal terms have free coefficients (lags m to m + p), not products of two polynomials. Innovations before the first
row with all its lags are zero.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timeaxis import floor_to, shift
from ..operators.blocks import BLOCK_ROWS, attach, row_blocks
from ..operators.recurrence import Recurrence
from ..operators.stats import unpack_gram
from ..session import stage
from .common import FORECAST_COLUMNS, with_levels
from .folds import FoldPlan, numbered

NAME = "ARIMA"
MAX_P, MAX_Q, MAX_SEASONAL = 2, 2, 1
LONG_LAGS = 12
# A difference is taken where it leaves less than this share of the variance.
KEEP_SHARE = 0.2
STEPS = 3
MIN_ROWS = 20
BLOCK, PART = "unique_id string, block long", "unique_id string, part array<double>"
PARAMS = ("unique_id string, n_obs long, d int, seasonal_d int, mean double, ar_lags array<int>, ar array<double>,"
          " ma_lags array<int>, ma array<double>, sigma2 double, aicc double, form string")


def orders(season: int) -> list[tuple[tuple[int, ...], tuple[int, ...], str]]:
    """Lags of values and of innovations, and a name, of every candidate."""
    def lags(short: int, seasonal: int) -> tuple[int, ...]:
        return tuple(range(1, short + 1)) + tuple(season + i for i in range(short + 1) if seasonal)

    seasons = range(MAX_SEASONAL + 1) if season > max(MAX_P, MAX_Q) else (0,)
    return [(lags(p, sp), lags(q, sq), f"({p},{q})({sp},{sq})")
            for p, q, sp, sq in product(range(MAX_P + 1), range(MAX_Q + 1), seasons, seasons)]


def aicc(rss: float, n: int, terms: int) -> float:
    k = terms + 1
    return n * np.log(max(rss, 1e-300) / n) + 2 * k + 2 * k * (k + 1) / max(n - k - 1, 1)


def differenced(series: DataFrame, season: int, d: int | None = None, seasonal_d: int | None = None, chosen: DataFrame | None = None) -> DataFrame:
    """Rows of the differenced, centred series: unique_id, pos, ds, y, w, d, seasonal_d, mean; staged.

    ``chosen`` (unique_id, d, seasonal_d, mean) says what is done to each series. Without it and without given orders a seasonal difference is taken where it leaves less than ``KEEP_SHARE`` of the variance, then a
    first one likewise. Only an undifferenced series is centred. ``pos`` counts from 0 after the rows lost.
    """
    reach = season + 1

    def make(w):
        one, m, m1 = F.lag("y", 1).over(w), F.lag("y", season).over(w), F.lag("y", season + 1).over(w)
        return {"w00": F.col("y"), "w10": F.col("y") - one, "w01": F.col("y") - m, "w11": F.col("y") - one - m + m1}

    rows = row_blocks(numbered(series.filter(F.col("y").isNotNull())), ["unique_id"], make, reach)
    if chosen is None:
        chosen = _differences(rows, d, seasonal_d)
    joined = attach(rows, chosen, ["unique_id"], ["pos"], "inner")
    value = F.when(F.col("seasonal_d") == 1, F.when(F.col("d") == 1, F.col("w11")).otherwise(F.col("w01"))).otherwise(
        F.when(F.col("d") == 1, F.col("w10")).otherwise(F.col("w00"))) - F.col("mean")
    lost = F.col("d") + F.col("seasonal_d") * season
    return stage(joined.select("unique_id", (F.col("pos") - lost).alias("pos"), "ds", "y", value.alias("w"), "d", "seasonal_d", "mean").filter(
        F.col("pos") >= 0), "arima-rows")


def _differences(rows: DataFrame, d: int | None, seasonal_d: int | None) -> DataFrame:
    spread = rows.groupBy("unique_id").agg(*[F.var_pop(c).alias(c) for c in ("w00", "w10", "w01", "w11")], F.avg("y").alias("level"))
    by = F.lit(seasonal_d) if seasonal_d is not None else F.when(F.col("w01") < KEEP_SHARE * F.col("w00"), 1).otherwise(0)
    first = F.when(F.col("seasonal_d") == 1, F.col("w11") < KEEP_SHARE * F.col("w01")).otherwise(F.col("w10") < KEEP_SHARE * F.col("w00"))
    chosen = spread.withColumn("seasonal_d", by.cast("int")).withColumn(
        "d", (F.lit(d) if d is not None else F.when(first, 1).otherwise(0)).cast("int"))
    return chosen.select("unique_id", "d", "seasonal_d", F.when(F.col("d") + F.col("seasonal_d") == 0, F.col("level")).otherwise(0.0).alias("mean"))


def _blocks(rows: DataFrame, back: int, block_rows: int) -> DataFrame:
    """Rows of each block, with the ``back`` rows before it as well; ``own`` tells them apart."""
    size = max(block_rows, back)
    home = floor_to(F.col("pos"), size)
    copies = F.array_compact(F.array(home, F.when(F.col("pos") - home >= size - back, home + size)))
    return rows.select("unique_id", "pos", "w", F.explode(copies).alias("at"), home.alias("home")).select(
        "unique_id", (F.col("at") / size).cast("long").alias("block"), "pos", "w", (F.col("home") == F.col("at")).alias("own"))


def _lagged(values: np.ndarray, lags: Iterable[int]) -> np.ndarray:
    """Columns of earlier values, NaN where there is none."""
    lags = list(lags)
    out = np.full((len(values), len(lags)), np.nan)
    for j, k in enumerate(lags):
        out[k:, j] = values[:-k]
    return out


def _gram(columns: np.ndarray) -> list[float]:
    used = columns[~np.isnan(columns).any(axis=1)]
    return [float(len(used)), *(used.T @ used)[np.triu_indices(columns.shape[1])]]


def _summed(parts: DataFrame) -> DataFrame:
    """Sums over a series' blocks of arrays of one length: unique_id, sums."""
    cells = parts.select("unique_id", F.posexplode("part").alias("i", "v")).groupBy("unique_id", "i").agg(F.sum("v").alias("v"))
    return cells.groupBy("unique_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("sums"))


def _solve(gram: np.ndarray, columns: Sequence[int]) -> tuple[np.ndarray, float]:
    """Least squares of the last column on the given ones, from sums of products."""
    columns = list(columns)
    xtx, xty = gram[np.ix_(columns, columns)], gram[columns, -1]
    beta = np.linalg.pinv(xtx, hermitian=True) @ xty if columns else np.zeros(0)
    return beta, float(max(gram[-1, -1] - beta @ xty, 0.0))


def _long_lags(season: int) -> list[int]:
    seasonal = [season, season + 1, season + 2, 2 * season, 2 * season + 1] if season > 1 else []
    return sorted({*range(1, LONG_LAGS + 1), *seasonal})


def search(rows: DataFrame, season: int, candidates: Sequence | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The order of least AICc for every series with its Hannan-Rissanen coefficients (columns of ``PARAMS``)."""
    candidates = list(candidates or orders(season))
    long = _long_lags(season)
    lags = sorted({k for ar, ma, _ in candidates for k in (*ar, *ma)})
    back = max(long) + max(lags, default=0)
    width = len(long) + 1
    blocks = stage(_blocks(rows, back, block_rows), "arima-blocks")

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        w = pdf["w"].to_numpy()
        used = np.column_stack([_lagged(w, long), w])[pdf["own"].to_numpy()]
        return pd.DataFrame([(pdf["unique_id"].iloc[0], _gram(used))], columns=["unique_id", "part"])

    def long_fit(sums: pd.Series) -> pd.Series:
        return sums.map(lambda s: _solve(unpack_gram(np.array(s[1:]), width), range(len(long)))[0])

    first_fit = _summed(blocks.groupBy("unique_id", "block").applyInPandas(first, PART)).select(
        "unique_id", F.pandas_udf(long_fit, "array<double>")("sums").alias("long"))
    per_block = blocks.select("unique_id", "block").distinct().join(first_fit, "unique_id")

    def second(pdf: pd.DataFrame, params: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        w = pdf["w"].to_numpy()
        e = w - _lagged(w, long) @ np.array(params["long"].iloc[0])
        used = np.column_stack([_lagged(w, lags), _lagged(e, lags), w])[pdf["own"].to_numpy()]
        return pd.DataFrame([(pdf["unique_id"].iloc[0], _gram(used))], columns=["unique_id", "part"])

    grams = _summed(blocks.groupBy("unique_id", "block").cogroup(_fresh(per_block).groupBy("unique_id", "block")).applyInPandas(
        _where_both(second, PART), PART))
    facts = rows.groupBy("unique_id").agg(F.first("d").alias("d"), F.first("seasonal_d").alias("seasonal_d"), F.first("mean").alias("mean"))
    place = {k: i for i, k in enumerate(lags)}

    def pick(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                n = int(r.sums[0])
                if n < MIN_ROWS:
                    continue
                gram, best = unpack_gram(np.array(r.sums[1:]), 2 * len(lags) + 1), None
                for ar, ma, name in candidates:
                    if n <= len(ar) + len(ma) + 2:
                        continue
                    beta, rss = _solve(gram, [*(place[k] for k in ar), *(len(lags) + place[k] for k in ma)])
                    score = aicc(rss, n, len(ar) + len(ma) + (r.d + r.seasonal_d == 0))
                    if best is None or score < best[0] - 1e-9:
                        best = (score, ar, beta[:len(ar)], ma, _invertible(ma, beta[len(ar):]), rss / n, name)
                score, ar, phi, ma, theta, sigma2, name = best
                out.append((r.unique_id, n, r.d, r.seasonal_d, r.mean, list(ar), list(phi), list(ma), list(theta), sigma2, score, name))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in PARAMS.split(", ")])

    return grams.join(facts, "unique_id").mapInPandas(pick, PARAMS)


def _invertible(lags: Sequence[int], theta: np.ndarray) -> np.ndarray:
    """Coefficients shrunk until the recurrence of the innovations dies out."""
    theta = np.array(theta, dtype=float)
    for _ in range(60):
        if not len(theta):
            break
        reach = max(lags)
        roots = np.zeros(reach + 1)
        roots[0] = 1.0
        roots[list(lags)] = theta
        if np.abs(np.roots(roots)).max(initial=0.0) < 0.995:
            break
        theta *= 0.95
    return theta


def _fresh(df: DataFrame) -> DataFrame:
    """The same columns under new identities, so that both sides of a cogroup can stem from one table."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def _where_both(task, columns: str):
    """A cogrouped task that has nothing to say where one side is empty, as for series without parameters, or where a block
    holds only the past of rows that a series does not have."""
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty or not left.get("own", pd.Series([True])).any():
            return pd.DataFrame(columns=[c.split()[0] for c in columns.split(", ")])
        return task(left, right)
    return run


def _pass(blocks: DataFrame, params: DataFrame, back: int, finish, schema: str) -> DataFrame:
    """Call ``finish(key, own rows, w with its past, e, a, b, params)`` on every block, each with its past of ``back`` values.

    e are the innovations, a and b the values and innovations filtered by the moving-average polynomial. Blocks first run
    from a zero past; one scan over their summaries gives the past each starts from. Rows before the first that has all
    its lags of values have a zero innovation.
    """
    key = ["unique_id", "block"]
    mine = blocks.select(*key).distinct().join(params, "unique_id")

    def start(pdf: pd.DataFrame, par: pd.DataFrame):
        pdf, par = pdf.sort_values("pos"), par.iloc[0]
        own = pdf["own"].to_numpy()
        recurrence = Recurrence(dict(zip(par["ma_lags"], par["ma"])), back)
        w = pdf["w"].to_numpy()
        u = w - _lagged(w, par["ar_lags"]) @ np.array(par["ar"], dtype=float) if len(par["ar_lags"]) else w
        return pdf, par, own, recurrence, w, np.where(np.isnan(u), 0.0, u)[own]

    def summary(pdf: pd.DataFrame, par: pd.DataFrame) -> pd.DataFrame:
        pdf, par, own, recurrence, w, u = start(pdf, par)
        zero = np.zeros(back)
        e = recurrence.run(u)
        ends = [recurrence.state_after(x, zero) for x in (e, recurrence.run(w[own]), recurrence.run(e))]
        return pd.DataFrame([(pdf["unique_id"].iloc[0], pdf["block"].iloc[0], len(u), np.concatenate(ends).tolist())],
                            columns=["unique_id", "block", "size", "ends"])

    def scan(pdf: pd.DataFrame, par: pd.DataFrame) -> pd.DataFrame:
        """States before each block; b's also takes what e's state adds to e in the block before."""
        pdf, par = pdf.sort_values("block"), par.iloc[0]
        recurrence = Recurrence(dict(zip(par["ma_lags"], par["ma"])), back)
        e = a = b = np.zeros(back)
        made, cached = [], {}
        for size, ends in zip(pdf["size"], pdf["ends"]):
            made.append(np.concatenate([e, a, b]).tolist())
            if size not in cached:
                # (e, b) together: b's input is e, so its one-step map is [[T, 0], [T's first row, T]].
                step = np.zeros((back, back))
                step[1:, :-1] = np.eye(back - 1)
                for k, c in recurrence.coefficients.items():
                    step[0, k - 1] = -c
                top = np.zeros((back, back))
                top[0] = step[0]
                joint = np.linalg.matrix_power(np.block([[step, np.zeros((back, back))], [top, step]]), int(size))
                cached[size] = joint
            joint, parts = cached[size], np.split(np.array(ends), 3)
            both = joint @ np.concatenate([e, b])
            e, a, b = parts[0] + both[:back], parts[1] + joint[:back, :back] @ a, parts[2] + both[back:]
        return pd.DataFrame({"unique_id": pdf["unique_id"], "block": pdf["block"], "states": made})

    def last(pdf: pd.DataFrame, par: pd.DataFrame) -> pd.DataFrame:
        pdf, par, own, recurrence, w, u = start(pdf, par)
        e0, a0, b0 = np.split(np.array(par["states"]), 3)
        e, a = recurrence.run(u, e0), recurrence.run(w[own], a0)
        past = lambda state, x: np.concatenate([state[::-1], x])
        return finish(pdf[own], w, past(e0, e), past(a0, a), past(b0, recurrence.run(e, b0)), par)

    ends, starts = f"{BLOCK}, size int, ends array<double>", f"{BLOCK}, states array<double>"
    summaries = blocks.groupBy(*key).cogroup(_fresh(mine).groupBy(*key)).applyInPandas(_where_both(summary, ends), ends)
    states = summaries.groupBy("unique_id").cogroup(_fresh(params).groupBy("unique_id")).applyInPandas(_where_both(scan, starts), starts)
    return blocks.groupBy(*key).cogroup(_fresh(mine.join(states, key)).groupBy(*key)).applyInPandas(_where_both(last, schema), schema)


def innovations(rows: DataFrame, params: DataFrame, back: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Exact innovations of every row: unique_id, pos, w, e. ``back`` is the longest lag of any model."""
    def finish(own, w, e, a, b, par):
        return pd.DataFrame({"unique_id": own["unique_id"], "pos": own["pos"], "w": own["w"], "e": e[back:]})

    return _pass(_blocks(rows, back, block_rows), params, back, finish, "unique_id string, pos long, w double, e double")


def refine(rows: DataFrame, params: DataFrame, back: int, steps: int = STEPS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Gauss-Newton steps on the sum of squared innovations; a step that does not lower a series' sum is taken back."""
    blocks = stage(_blocks(rows, back, block_rows), "arima-blocks")

    def finish(own, w, e, a, b, par):
        """Sums of e e', and of e with the filtered past values and innovations, over the block's own rows."""
        ok = (own["pos"] >= max(par["ar_lags"], default=0)).to_numpy()
        sides = [_lagged(x, lags)[back:] for x, lags in ((a, par["ar_lags"]), (b, par["ma_lags"]))]
        x = np.nan_to_num(np.column_stack([*sides, e[back:]]))[ok]
        size = x.shape[1]
        return pd.DataFrame([(own["unique_id"].iloc[0], [float(len(x)), *(x.T @ x)[np.triu_indices(size)]])], columns=["unique_id", "part"])

    fields = [c.split()[0] for c in PARAMS.split(", ")]
    held = params.withColumns({"ar_best": F.col("ar"), "ma_best": F.col("ma"), "rss_best": F.lit(float("inf"))})
    schema = PARAMS + ", ar_best array<double>, ma_best array<double>, rss_best double"

    def step(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                row = r._asdict()
                size = len(r.ar_lags) + len(r.ma_lags) + 1
                gram, n = unpack_gram(np.array(r.sums[1:]), size), int(r.sums[0])
                beta = np.concatenate([r.ar, r.ma])
                if gram[-1, -1] < r.rss_best:
                    rss, best = float(gram[-1, -1]), beta
                    move, _ = _solve(gram, range(size - 1))
                    beta = beta + move
                else:
                    rss, best = r.rss_best, np.concatenate([r.ar_best, r.ma_best])
                    beta = (beta + best) / 2
                cut = len(r.ar_lags)
                row |= {"n_obs": n, "ar": beta[:cut].tolist(), "ma": _invertible(r.ma_lags, beta[cut:]).tolist(), "ar_best": best[:cut].tolist(),
                        "ma_best": best[cut:].tolist(), "rss_best": rss, "sigma2": rss / max(n - size + 1, 1),
                        "aicc": aicc(rss, n, size - 1 + (r.d + r.seasonal_d == 0))}
                out.append([row[c] for c in (*fields, "ar_best", "ma_best", "rss_best")])
            yield pd.DataFrame(out, columns=[*fields, "ar_best", "ma_best", "rss_best"])

    for _ in range(steps + 1):
        sums = _summed(_pass(blocks, held.select(*fields), back, finish, PART))
        held = stage(held.join(sums, "unique_id").mapInPandas(step, schema), "arima-step")
    return held.select(*[F.col({"ar": "ar_best", "ma": "ma_best"}.get(c, c)).alias(c) for c in fields])


def fit(series: DataFrame, season: int = 24, d: int | None = None, seasonal_d: int | None = None, candidates: Sequence | None = None,
        steps: int = STEPS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per series: orders, coefficients by lag, variance and AICc. Rows without a target are left out; series of
    fewer than ``MIN_ROWS`` usable rows get no row."""
    rows = differenced(series, season, d, seasonal_d)
    return fit_rows(rows, season, candidates, steps, block_rows)


def fit_rows(rows: DataFrame, season: int, candidates: Sequence | None = None, steps: int = STEPS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    picked = stage(search(rows, season, candidates, block_rows), "arima-orders")
    return refine(rows, picked, longest(season, candidates), steps, block_rows)


def longest(season: int, candidates: Sequence | None = None) -> int:
    return max((k for ar, ma, _ in candidates or orders(season) for k in (*ar, *ma)), default=1)


def fixed(series_ids: DataFrame, ar: dict[int, float] | None = None, ma: dict[int, float] | None = None) -> DataFrame:
    """The same coefficients for every id, for ``innovations``."""
    ar, ma = ar or {}, ma or {}
    values = lambda x, kind: F.array(*[F.lit(v) for v in x]).cast(f"array<{kind}>")
    return series_ids.select("unique_id").distinct().select(
        "unique_id", values(ar, "int").alias("ar_lags"), values(ar.values(), "double").alias("ar"),
        values(ma, "int").alias("ma_lags"), values(ma.values(), "double").alias("ma"))


def polynomial(d: int, seasonal_d: int, season: int) -> np.ndarray:
    """Coefficients of (1 - B)^d (1 - B^m)^D by power of B."""
    out = np.ones(1)
    for power, times in ((1, d), (season, seasonal_d)):
        factor = np.zeros(power + 1)
        factor[0], factor[-1] = 1.0, -1.0
        for _ in range(times):
            out = np.convolve(out, factor)
    return out


def path(y: np.ndarray, w: np.ndarray, e: np.ndarray, par, season: int, h: int) -> tuple[np.ndarray, np.ndarray]:
    """Forecasts of h steps and their cumulated variance factors from the newest values (oldest first)."""
    phi, theta = dict(zip(par.ar_lags, par.ar)), dict(zip(par.ma_lags, par.ma))
    poly = polynomial(par.d, par.seasonal_d, season)
    past_w, past_e, past_y = list(w), list(e), list(y)
    full = np.zeros(max([0, *phi]) + 1)
    full[0] = 1.0
    for k, c in phi.items():
        full[k] -= c
    full = np.convolve(full, poly)
    psi = np.zeros(h)
    for s in range(h):
        value = sum(c * past_w[-k] for k, c in phi.items()) + sum(c * past_e[-k] for k, c in theta.items())
        past_w.append(value)
        past_e.append(0.0)
        past_y.append(value + par.mean - sum(c * past_y[-k] for k, c in enumerate(poly) if k and c))
        psi[s] = (1.0 if s == 0 else theta.get(s, 0.0)) - sum(full[k] * psi[s - k] for k in range(1, min(s, len(full) - 1) + 1))
    return np.array(past_y[-h:]), np.cumsum(psi ** 2)


def predict(params: DataFrame, rows: DataFrame, season: int, h: int, back: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """unique_id, cutoff, horizon_step, yhat, sd for h steps: one bounded recursion over the tail of every series."""
    ends = rows.groupBy("unique_id").agg(F.max("pos").alias("end"), F.max("ds").alias("cutoff"))
    tail = attach(rows.select("unique_id", "pos", "y"), ends, ["unique_id"], ["pos"]).filter(F.col("pos") >= F.col("end") - 2 * season - 2)
    noise = attach(innovations(rows, params, back, block_rows), ends.select("unique_id", "end"), ["unique_id"], ["pos"]).filter(F.col("pos") > F.col("end") - back)
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("pos", c))), lambda s: s[c])
    tails = tail.groupBy("unique_id").agg(ordered("y").alias("y_tail"), F.first("cutoff").alias("cutoff")).join(
        noise.groupBy("unique_id").agg(ordered("w").alias("w_tail"), ordered("e").alias("e_tail")), "unique_id")

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                if len(r.w_tail) < max([0, *r.ar_lags, *r.ma_lags]) or len(r.y_tail) < r.d + r.seasonal_d * season:
                    continue
                yhat, factors = path(r.y_tail, r.w_tail, r.e_tail, r, season, h)
                out += [(r.unique_id, r.cutoff, s + 1, float(yhat[s]), float(np.sqrt(r.sigma2 * factors[s]))) for s in range(h)]
            yield pd.DataFrame(out, columns=["unique_id", "cutoff", "horizon_step", "yhat", "sd"])

    return params.join(tails, "unique_id").mapInPandas(run, "unique_id string, cutoff timestamp_ntz, horizon_step int, yhat double, sd double")


def forecast(series: DataFrame, h: int, step: int, season: int = 24, levels: Sequence[int] = (80, 95), params: DataFrame | None = None,
             candidates: Sequence | None = None) -> DataFrame:
    rows = differenced(series, season, chosen=None if params is None else params.select("unique_id", "d", "seasonal_d", "mean"))
    fitted = fit_rows(rows, season, candidates) if params is None else params
    made = predict(fitted, rows, season, h, longest(season, candidates))
    dated = made.withColumn("ds", shift("cutoff", F.col("horizon_step") * step)).withColumn("model", F.lit(NAME))
    return with_levels(dated, F.col("sd"), levels).select(*FORECAST_COLUMNS)


def predict_folds(series: DataFrame, plan: FoldPlan, season: int, candidates: Sequence | None = None) -> DataFrame:
    """A fit per series and fold on the rows before its cut, all in one job: unique_id, fold, horizon_step, yhat.

    Innovations depend on the fold's coefficients, so rows are copied once a fold.
    """
    rows = numbered(series.filter(F.col("y").isNotNull())).withColumn("fold", plan.folds())
    train = rows.filter(F.col("pos") < plan.cut(F.col("fold"))).select(
        F.concat_ws("#", F.col("fold").cast("string"), "unique_id").alias("unique_id"), "ds", "y")
    ready = differenced(train, season)
    made = predict(fit_rows(ready, season, candidates), ready, season, plan.h, longest(season, candidates))
    fold = F.substring_index("unique_id", "#", 1)
    return made.select(F.expr("substr(unique_id, instr(unique_id, '#') + 1)").alias("unique_id"), fold.cast("int").alias("fold"), "horizon_step", "yhat")

"""Order-dependent work on series of any length, without one task per series.

A plain ``Window.partitionBy(series)`` sorts a whole series in one task, so a series holding a third
of the rows makes that task the job. The helpers here split every series into blocks:

* ``with_position`` numbers the rows of a series from per-block counts;
* ``row_blocks`` cuts a numbered series into blocks of a fixed row count and copies the few rows a
  bounded frame needs into the neighbouring block;
* ``time_blocks`` does the same for frames bounded in time;
* ``known_around`` finds the nearest known value on either side with one summary row per block;
* ``attach`` joins one row per series to all its rows with the series spread over salts;
* ``exact_quantiles`` ranks values within equal-depth buckets.

Only block summaries are ever ordered per series: one row per block, not one per reading.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timeaxis import WEEK, epoch, floor_to
from ..session import stage

BLOCK_ROWS = 16384
SALTS = 16


def _block(time: str, seconds: int) -> Column:
    return floor_to(epoch(time), seconds)


def with_position(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], pos: str = "pos",
    total: str | None = None, block_seconds: int = WEEK,
) -> DataFrame:
    """Number the rows of each series from 0 by ``order`` (its first column is a time)."""
    keys = list(keys)
    cut = df.withColumn("_blk", _block(order[0], block_seconds))
    series = Window.partitionBy(*keys)
    before = series.orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    counts = cut.groupBy(*keys, "_blk").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        *keys, "_blk",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"),
        F.sum("_n").over(series).alias("_total"),
    )
    local = Window.partitionBy(*keys, "_blk").orderBy(*order)
    out = cut.join(offsets, [*keys, "_blk"]).withColumn(
        pos, F.row_number().over(local) - 1 + F.col("_off")
    )
    if total:
        out = out.withColumn(total, F.col("_total"))
    return out.drop("_blk", "_off", "_total")


def row_blocks(
    df: DataFrame, keys: Sequence[str], exprs: Callable[[Window], dict[str, Column]],
    back: int = 0, ahead: int = 0, pos: str = "pos", block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Evaluate window expressions that look at most ``back`` rows behind and ``ahead`` rows on.

    Each block gets a copy of the rows its first and last frames reach, and drops them afterwards.
    """
    size = max(block_rows, back, ahead)
    home = floor_to(F.col(pos), size)
    within = F.col(pos) - home
    copies = F.array_compact(F.array(
        home,
        F.when(within >= size - back, home + size),
        F.when((within < ahead) & (home > 0), home - size),
    ))
    spread = df.withColumn("_home", home).withColumn("_blk", F.explode(copies))
    window = Window.partitionBy(*keys, "_blk").orderBy(pos)
    kept = [F.col(c) for c in df.columns]
    made = [expr.alias(name) for name, expr in exprs(window).items()]
    return (
        spread.select(*kept, "_home", "_blk", *made)
        .filter(F.col("_home") == F.col("_blk"))
        .drop("_home", "_blk")
    )


def time_blocks(
    df: DataFrame, keys: Sequence[str], time: str, exprs: Callable[[Window], dict[str, Column]],
    back_seconds: int, block_seconds: int = WEEK,
) -> DataFrame:
    """Evaluate trailing windows over the last ``back_seconds``; order is epoch seconds."""
    size = max(block_seconds, back_seconds)
    home = floor_to(F.col("_sec"), size)
    late = F.col("_sec") - home >= size - back_seconds
    spread = (
        df.withColumn("_sec", epoch(time))
        .withColumn("_home", home)
        .withColumn("_blk", F.explode(F.array_compact(F.array(home, F.when(late, home + size)))))
    )
    window = Window.partitionBy(*keys, "_blk").orderBy("_sec")
    made = [expr.alias(name) for name, expr in exprs(window).items()]
    return (
        spread.select(*df.columns, "_home", "_blk", *made)
        .filter(F.col("_home") == F.col("_blk"))
        .drop("_home", "_blk")
    )


def known_around(
    df: DataFrame, keys: Sequence[str], time: str, columns: Sequence[str],
    previous: str | None = "at", following: str | None = "at", block_seconds: int = WEEK,
) -> DataFrame:
    """Add ``<c>_prev``, ``<c>_prev_at``, ``<c>_next``, ``<c>_next_at``: nearest known values and their times.

    ``previous`` is ``"at"`` (current row included), ``"before"`` or None; ``following`` is ``"at"``,
    ``"after"`` or None. Inside a block the last (first) known row is a running value; across blocks
    the same running value over one summary row per block is carried in. Columns that the caller does
    not use are pruned together with their windows.
    """
    keys = list(keys)
    cut = df.withColumn("_blk", _block(time, block_seconds))
    series, block = Window.partitionBy(*keys), Window.partitionBy(*keys, "_blk")
    so_far = (Window.unboundedPreceding, -1)
    sides = {}
    if previous:
        run = block.orderBy(time).rowsBetween(Window.unboundedPreceding, 0 if previous == "at" else -1)
        sides["prev"] = (F.max, F.max_by, run, series.orderBy("_blk").rowsBetween(*so_far))
    if following:
        run = block.orderBy(F.desc(time)).rowsBetween(Window.unboundedPreceding, 0 if following == "at" else -1)
        sides["next"] = (F.min, F.min_by, run, series.orderBy(F.desc("_blk")).rowsBetween(*so_far))
    sums, carried, local = [], [], []
    for side, (extreme, extreme_by, run, blocks_before) in sides.items():
        for c in columns:
            at = F.when(F.col(c).isNotNull(), F.col(time))
            # Times and values apart: fixed-width buffers keep the aggregation hash-based.
            sums += [extreme_by(c, at).alias(f"_v_{side}_{c}"), extreme(at).alias(f"_t_{side}_{c}")]
            for what, local_value, out in (("v", F.col(c), f"{c}_{side}"), ("t", at, f"{c}_{side}_at")):
                name = f"_{what}_{side}_{c}"
                carried.append(F.last(name, True).over(blocks_before).alias(f"_in{name}"))
                local.append(F.coalesce(F.last(local_value, True).over(run), F.col(f"_in{name}")).alias(out))
    summary = cut.groupBy(*keys, "_blk").agg(*sums).select(*keys, "_blk", *carried)
    return cut.join(summary, [*keys, "_blk"]).select(*df.columns, *local)


def previous_row(
    df: DataFrame, keys: Sequence[str], time: str, columns: Sequence[str], prefix: str = "prev_",
    block_seconds: int = WEEK,
) -> DataFrame:
    """Add the columns of the row before, in time order, whether or not they are NULL there.

    Only the first row of a block needs another block: the last row of the one before, from the summary.
    """
    keys = list(keys)
    cut = df.withColumn("_blk", _block(time, block_seconds))
    over_blocks = Window.partitionBy(*keys).orderBy("_blk")
    in_block = Window.partitionBy(*keys, "_blk").orderBy(time)
    ends = cut.groupBy(*keys, "_blk").agg(*[F.max_by(c, time).alias(f"_end_{c}") for c in columns]).select(
        *keys, "_blk", *[F.lag(f"_end_{c}").over(over_blocks).alias(f"_in_{c}") for c in columns])
    opens = F.row_number().over(in_block) == 1
    return cut.join(ends, [*keys, "_blk"]).select(*df.columns, *[
        F.when(opens, F.col(f"_in_{c}")).otherwise(F.lag(c).over(in_block)).alias(f"{prefix}{c}") for c in columns])


def attach(
    rows: DataFrame, per_key: DataFrame, keys: Sequence[str], spread_by: Sequence[str],
    how: str = "left", salts: int = SALTS,
) -> DataFrame:
    """Join at most one row per key onto many rows per key, a hot key being spread over salts.

    ``per_key`` is repeated once per salt. Where it is small Spark broadcasts it by its own size check.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int"))
    copies = per_key.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], buckets: int = 256,
) -> DataFrame:
    """Exact linearly interpolated quantiles per key, one output column per entry of ``probs``.

    Equal values are counted first, into a staged table because three steps read it. A sketch of bounded
    size cuts them into buckets of about equal depth, bucket counts give each bucket's starting rank, and
    ranks are taken inside a bucket only.
    """
    keys = list(keys)
    counted = stage(
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n")), "value-counts"
    )
    steps = [i / buckets for i in range(1, buckets)]
    cuts = counted.groupBy(*keys).agg(F.percentile_approx("_v", steps, 10000).alias("_cuts"))
    placed = attach(counted, cuts, keys, [*keys, "_v"]).select(
        *keys, "_v", "_n",
        F.size(F.filter("_cuts", lambda b: b < F.col("_v"))).alias("_b"),
    )
    depth = placed.groupBy(*keys, "_b").agg(F.sum("_n").alias("_depth"))
    series = Window.partitionBy(*keys)
    ranks = depth.select(
        *keys, "_b",
        F.coalesce(F.sum("_depth").over(
            series.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_from"),
        F.sum("_depth").over(series).alias("_total"),
    )
    inner = Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = placed.join(ranks, [*keys, "_b"]).withColumn("_to", F.col("_from") + F.sum("_n").over(inner))

    def holds(rank: Column) -> Column:
        return (F.col("_to") - F.col("_n") <= rank) & (rank < F.col("_to"))

    aggs, outs = [], []
    for name, p in probs.items():
        target = (F.col("_total") - 1) * F.lit(float(p))
        low, high = F.floor(target), F.ceil(target)
        aggs += [
            F.max(F.when(holds(low), F.col("_v"))).alias(f"_{name}_lo"),
            F.max(F.when(holds(high), F.col("_v"))).alias(f"_{name}_hi"),
            F.max(target - low).alias(f"_{name}_w"),
        ]
        outs.append((F.col(f"_{name}_lo") + F.col(f"_{name}_w")
                     * (F.col(f"_{name}_hi") - F.col(f"_{name}_lo"))).alias(name))
    return ranked.groupBy(*keys).agg(*aggs).select(*keys, *outs)

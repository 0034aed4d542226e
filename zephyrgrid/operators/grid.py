"""Time-grid operators: regridding, gaps, frequency, future dates, folds and sequences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timeaxis import DAY, HOUR, QUARTER, WEEK, bucket, epoch, from_epoch, shift
from ..schema import CLAMPED_HORIZON, DEFAULT_HORIZON, SEASON, STEP_SECONDS
from .blocks import attach, known_around, previous_row, row_blocks, with_position

ID = ["unique_id"]


def time_spine(bounds: DataFrame, keys: Sequence[str], lo: str, hi: str, out: str, step: int = HOUR,
               block_seconds: int = WEEK) -> DataFrame:
    """Every grid time from ``lo`` to ``hi`` per key, expanded block by block, not as one long array."""
    first, last = epoch(lo), epoch(hi)
    blocks = bounds.select(
        *keys, first.alias("_lo"), last.alias("_hi"),
        F.explode(F.sequence(F.floor(first / block_seconds), F.floor(last / block_seconds))).alias("_blk"),
    )
    start = F.greatest(F.col("_lo"), F.ceil(F.col("_blk") * block_seconds / step) * step)
    stop = F.least(F.col("_hi"), (F.col("_blk") + 1) * block_seconds - 1)
    return (
        blocks.filter(start <= stop)
        .select(*keys, F.explode(F.sequence(start, stop, F.lit(step).cast("bigint"))).alias("_t"))
        .select(*keys, from_epoch("_t").alias(out))
    )


def complete_grid(df: DataFrame, keys: Sequence[str], time: str, step: int = HOUR) -> DataFrame:
    """Every step between a series' first and last row; absent rows have NULL measures."""
    bounds = df.groupBy(*keys).agg(F.min(time).alias("_from"), F.max(time).alias("_to"))
    return time_spine(bounds, keys, "_from", "_to", time, step).join(df, [*keys, time], "left").select(*df.columns)


def _lerp(c: str, at: Column) -> Column:
    """Straight line between the known values around a time; held after the last one."""
    prev, prev_at, nxt, next_at = (F.col(f"{c}_{part}") for part in ("prev", "prev_at", "next", "next_at"))
    share = (epoch(at) - epoch(prev_at)) / (epoch(next_at) - epoch(prev_at)).cast("double")
    return F.when(nxt.isNull(), prev).otherwise(prev + (nxt - prev) * share)


def regrid(df: DataFrame, keys: Sequence[str], time: str, columns: Sequence[str],
           text_columns: Sequence[str] = (), step: int = QUARTER) -> DataFrame:
    """Move each series to a finer regular grid by linear interpolation.

    Readings off the grid are dropped, leading gaps stay NULL and trailing gaps hold the last value.
    Text columns are filled forward, then backward. Every row expands itself up to the row after it,
    so no grid table is built and no join on time is needed.
    """
    on_grid = epoch(time) % step == 0
    every = [*columns, *text_columns]
    snapped = df.select(
        *keys, bucket(time, step).alias(time), *[F.when(on_grid, F.col(c)).alias(c) for c in every]
    ).groupBy(*keys, time).agg(*[F.max(c).alias(c) for c in every])
    marked = snapped.withColumn("_here", F.col(time))
    around = known_around(marked, keys, time, [*every, "_here"], "at", "after")
    until = F.coalesce(shift(F.col("_here_next"), -step), F.col(time))
    points = around.withColumn(
        "_t", F.explode(F.sequence(epoch(time), epoch(until), F.lit(step).cast("bigint")))
    ).withColumn("_at", from_epoch("_t"))

    def value(c: str) -> Column:
        exact = (F.col("_at") == F.col(time)) & F.col(c).isNotNull()
        return F.when(exact, F.col(c).cast("double")).otherwise(_lerp(c, F.col("_at")))

    return points.select(
        *keys, F.col("_at").alias(time), *[value(c).alias(c) for c in columns],
        *[F.coalesce(F.col(f"{c}_prev"), F.col(f"{c}_next")).alias(c) for c in text_columns],
    )


def interpolate_rows(df: DataFrame, keys: Sequence[str], time: str, columns: Sequence[str]) -> DataFrame:
    """Fill gaps in place by row position, whatever the time between rows; the end holds its value."""
    numbered = with_position(df, keys, [time])
    packed = numbered.withColumns({
        f"_{c}": F.when(F.col(c).isNotNull(), F.struct(F.col("pos").alias("p"), F.col(c).alias("x")))
        for c in columns
    })
    around = known_around(packed, keys, time, [f"_{c}" for c in columns])

    def value(c: str) -> Column:
        a, b = F.col(f"_{c}_prev"), F.col(f"_{c}_next")
        share = (F.col("pos") - a["p"]) / (b["p"] - a["p"]).cast("double")
        return (F.when(F.col(c).isNotNull(), F.col(c)).when(b.isNull(), a["x"])
                .otherwise(a["x"] + (b["x"] - a["x"]) * share))

    return around.select(*[value(c).alias(c) if c in columns else F.col(c) for c in df.columns])


def _by_frequency(freq: Column, table: dict, default=None) -> Column:
    out = F.lit(default)
    for name, value in table.items():
        out = F.when(freq == name, F.lit(value)).otherwise(out)
    return out


def detect_frequency(series: DataFrame) -> DataFrame:
    """Commonest step per series (smallest on ties), its frequency class and seasonal period."""
    steps = (
        previous_row(series.select("unique_id", "ds"), ID, "ds", ["ds"])
        .select("unique_id", (epoch("ds") - epoch("prev_ds")).alias("step"))
        .filter(F.col("step").isNotNull())
        .groupBy("unique_id", "step").agg(F.count(F.lit(1)).alias("n"))
    )
    modal = steps.groupBy("unique_id").agg(
        F.max_by("step", F.struct(F.col("n"), -F.col("step"))).alias("step_seconds"))
    freq = F.when(F.col("step_seconds") <= 900, "15min").when(F.col("step_seconds") <= 3600, "H").otherwise("D")
    return modal.withColumn("freq", freq).withColumn("season", _by_frequency(F.col("freq"), SEASON))


def future_grid(series: DataFrame, h: int = DEFAULT_HORIZON, clamp: bool = True,
                frequency: DataFrame | None = None) -> DataFrame:
    """The next ``h`` times of every series; ``clamp`` limits hourly to 24 and daily to 1."""
    freq = detect_frequency(series) if frequency is None else frequency
    ends = series.groupBy("unique_id").agg(F.max("ds").alias("last_ds"))
    horizon = F.lit(h)
    if clamp:
        for name, limit in CLAMPED_HORIZON.items():
            horizon = F.when(F.col("freq") == name, F.lit(limit)).otherwise(horizon)
    return (
        ends.join(freq.select("unique_id", "freq"), "unique_id")
        .withColumn("horizon_step", F.explode(F.sequence(F.lit(1), horizon)))
        .withColumn("ds", shift("last_ds", F.col("horizon_step") * _by_frequency(F.col("freq"), STEP_SECONDS)))
        .select("unique_id", "ds", "horizon_step")
    )


def realign_dates(forecast: DataFrame, series: DataFrame, step: int, tolerance: int = HOUR) -> DataFrame:
    """Put a forecast whose first date is off by more than an hour back on the grid, by rank."""
    keys = ["unique_id", "model"]
    ends = series.groupBy("unique_id").agg(F.max("ds").alias("_last"))
    firsts = forecast.groupBy(*keys).agg(F.min("ds").alias("_first"))
    offsets = firsts.join(ends, "unique_id").select(
        *keys, shift("_last", step).alias("_expected"),
        (F.abs(epoch("_first") - epoch("_last") - step) > tolerance).alias("_off"),
    )
    numbered = with_position(forecast, keys, ["ds"], "_rank")
    moved = shift("_expected", F.col("_rank") * step)
    return (
        attach(numbered, offsets, keys, ["_rank"])
        .withColumn("ds", F.when(F.col("_off"), moved).otherwise(F.col("ds")))
        .select(*forecast.columns)
    )


def bridge(series: DataFrame, forecast: DataFrame, step: int) -> DataFrame:
    """Join the last actual to the first forecast: a bridge row, and even points over a gap > 2 steps.

    ``forecast`` has ``unique_id, ds, yhat, lo, hi``; bounds widen from the last actual to the first
    forecast's bounds. A ``part`` column tells bridge, gap and forecast rows apart.
    """
    last = series.groupBy("unique_id").agg(F.max_by(F.struct("ds", "y"), "ds").alias("a"))
    first = forecast.groupBy("unique_id").agg(F.min_by(F.struct("ds", "yhat", "lo", "hi"), "ds").alias("b"))
    ends = last.join(first, "unique_id")
    gap = epoch("b.ds") - epoch("a.ds")
    points = F.greatest(F.lit(3), F.floor(gap / step) - 1)
    inner = (
        ends.filter(gap > 2 * step)
        .withColumn("n", points)
        .withColumn("i", F.explode(F.sequence(F.lit(1).cast("bigint"), "n")))
    )
    share = F.col("i") / (F.col("n") + 1)
    seconds = F.lit(step) + (gap - 2 * step) * (F.col("i") - 1) / (F.col("n") - 1)

    def line(c: str) -> Column:
        return (F.col("a.y") + (F.col(f"b.{c}") - F.col("a.y")) * share).alias(c)

    filled = inner.select("unique_id", shift("a.ds", seconds).alias("ds"), line("yhat"), line("lo"), line("hi"),
                          F.lit("gap").alias("part"))
    start = ends.select("unique_id", F.col("a.ds").alias("ds"), *[F.col("a.y").alias(c) for c in ("yhat", "lo", "hi")],
                        F.lit("bridge").alias("part"))
    tail = forecast.select("unique_id", "ds", "yhat", "lo", "hi", F.lit("forecast").alias("part"))
    return start.unionByName(filled).unionByName(tail)


def split_by_fraction(series: DataFrame, fraction: float = 0.8) -> DataFrame:
    numbered = with_position(series, ID, ["ds"], "pos", "_n")
    return numbered.withColumn(
        "part", F.when(F.col("pos") < F.floor(F.col("_n") * fraction), "train").otherwise("test")
    ).drop("pos", "_n")


def split_last_rows(series: DataFrame, rows: int = 90) -> DataFrame:
    numbered = with_position(series, ID, ["ds"], "pos", "_n")
    return numbered.withColumn(
        "part", F.when(F.col("pos") < F.col("_n") - rows, "train").otherwise("test")).drop("pos", "_n")


def split_by_cutoff(series: DataFrame, cutoff) -> DataFrame:
    return series.withColumn("part", F.when(F.col("ds") <= F.lit(cutoff), "train").otherwise("test"))


def difference(series: DataFrame, order: int = 1) -> DataFrame:
    """The d-th difference by rows, NULL for the first ``order`` rows, as ``dy``."""
    out = series.withColumn("dy", F.col("y"))
    for _ in range(order):
        out = previous_row(out, ID, "ds", ["dy"]).withColumn("dy", F.col("dy") - F.col("prev_dy")).drop("prev_dy")
    return out


def fold_cutoffs(series: DataFrame, h: int, step_size: int, n_windows: int) -> DataFrame:
    """Last training row of each rolling-origin fold; folds without training rows are skipped.

    The fold is computed from a row's distance to the end, so rows are filtered and never copied.
    """
    numbered = with_position(series, ID, ["ds"], "pos", "n")
    behind = F.col("n") - h - 1 - F.col("pos")
    back = F.floor(behind / step_size)
    return (
        numbered.filter((behind >= 0) & (behind % step_size == 0) & (back < n_windows))
        .select("unique_id", (F.lit(n_windows - 1) - back).cast("int").alias("fold"),
                F.col("ds").alias("cutoff"), (F.col("pos") + 1).alias("n_train"))
    )


def fold_test_rows(series: DataFrame, h: int, step_size: int, n_windows: int) -> DataFrame:
    """The ``h`` test rows of each fold with their horizon step; at most h * n_windows per series."""
    numbered = with_position(series, ID, ["ds"], "pos", "n")
    reach = h + (n_windows - 1) * step_size
    cut = F.col("n") - h - (F.lit(n_windows - 1) - F.col("fold")) * step_size
    return (
        numbered.filter(F.col("pos") >= F.col("n") - reach)
        .withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_windows - 1))))
        .withColumn("cut", cut)
        .filter((F.col("cut") > 0) & (F.col("pos") >= F.col("cut")) & (F.col("pos") < F.col("cut") + h))
        .withColumn("horizon_step", (F.col("pos") - F.col("cut") + 1).cast("int"))
    )


def incremental_start(regions: DataFrame, stored: DataFrame, key: str, time: str, now,
                      default_days: int = 365) -> DataFrame:
    """Where each region's next fetch begins: its last stored time, else ``now`` less the default span."""
    latest = stored.groupBy(key).agg(F.max(time).alias("_max"))
    fallback = shift(F.lit(now).cast("timestamp_ntz"), -default_days * DAY)
    return regions.join(latest, key, "left").select(
        key, F.coalesce("_max", fallback).alias("start"))


def incremental_fetch(source: DataFrame, starts: DataFrame, key: str, time: str) -> DataFrame:
    """Source rows after their region's start."""
    joined = attach(source, starts, [key], [time], "inner")
    return joined.filter(F.col(time) > F.col("start")).drop("start")


def seasonal_decompose(series: DataFrame, period: int = 12) -> DataFrame:
    """Additive decomposition: centred moving average, mean per phase, remainder."""
    half = period // 2
    numbered = with_position(series, ID, ["ds"], "pos")

    def centred(w: Window) -> dict[str, Column]:
        inner = w.rowsBetween(-half + 1, half - 1) if period % 2 == 0 else w.rowsBetween(-half, half)
        edges = (F.lag("y", half).over(w) + F.lead("y", half).over(w))
        body = F.sum("y").over(inner)
        full = F.count("y").over(w.rowsBetween(-half, half)) == 2 * half + 1
        total = body + edges * 0.5 if period % 2 == 0 else body
        return {"trend": F.when(full, total / period)}

    trended = row_blocks(numbered, ID, centred, half, half).withColumn("phase", F.col("pos") % period)
    phases = trended.groupBy("unique_id", "phase").agg(F.avg(F.col("y") - F.col("trend")).alias("_raw"))
    centre = Window.partitionBy("unique_id")
    seasonal = phases.select("unique_id", "phase", (F.col("_raw") - F.avg("_raw").over(centre)).alias("seasonal"))
    return (
        attach(trended, seasonal, ["unique_id", "phase"], ["pos"])
        .withColumn("resid", F.col("y") - F.col("trend") - F.col("seasonal"))
        .select("unique_id", "ds", "y", "trend", "seasonal", "resid")
    )


def make_sequences(series: DataFrame, length: int = 7, value: str = "y") -> DataFrame:
    """Sliding windows: ``x`` holds the ``length`` values before ``target``."""
    numbered = with_position(series, ID, ["ds"], "pos")
    made = row_blocks(
        numbered, ID, lambda w: {"x": F.collect_list(value).over(w.rowsBetween(-length, -1))}, length)
    return made.filter(F.size("x") == length).select("unique_id", "ds", "x", F.col(value).alias("target"))

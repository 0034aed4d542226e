"""Roll-ups of observations to days, weeks and months, normals and coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timeaxis import DAY, WEEK, day_of, month_of, shift, week_ending_sunday
from ..functions.weather import circular_mean
from ..schema import MEASURES
from ..session import stage
from .blocks import attach
from .grid import time_spine

# How each measure is summarised; sums over nothing are 0, everything else is NULL.
RULES = {
    "temp": F.avg, "dwpt": F.avg, "rhum": F.avg, "prcp": F.sum, "snow": F.max, "wdir": circular_mean,
    "wspd": F.avg, "wpgt": F.max, "pres": F.avg, "tsun": F.sum, "coco": F.max,
}
SUMMED = {"prcp", "tsun"}


def _summaries(columns: Sequence[str]) -> list[Column]:
    out = []
    for m in MEASURES:
        if m in columns:
            value = RULES[m](m)
            out.append((F.coalesce(value, F.lit(0.0)) if m in SUMMED else value).alias(m))
    return out


def _full_calendar(rolled: DataFrame, keys: Sequence[str], bucket: str, step: int) -> DataFrame:
    """Add the empty buckets between a series' first and last: sums 0, the rest NULL.

    The calendar's bounds and its join both read the roll-up, so it is staged: raw rows are scanned once.
    """
    rolled = stage(rolled, "rolled")
    bounds = rolled.groupBy(*keys).agg(F.min(bucket).alias("_from"), F.max(bucket).alias("_to"))
    carried = bounds.withColumn("_first", F.col("_from"))
    anchored = time_spine(carried, [*keys, "_first"], "_from", "_to", bucket, DAY)
    if step != DAY:
        anchored = anchored.filter(F.datediff(bucket, "_first") % (step // DAY) == 0)
    zero = {c: 0.0 for c in SUMMED if c in rolled.columns}
    joined = anchored.join(rolled, [*keys, bucket], "left").select(*rolled.columns)
    return joined.na.fill(zero) if zero else joined


def daily_rollup(obs: DataFrame, keys: Sequence[str], time: str, full_calendar: bool = True) -> DataFrame:
    """One row per series and day with ``tmin, tmax, tavg`` in place of the temperature."""
    aggs = _summaries([c for c in obs.columns if c != "temp"])
    if "temp" in obs.columns:
        aggs += [F.min("temp").alias("tmin"), F.max("temp").alias("tmax"), F.avg("temp").alias("tavg")]
    rolled = obs.groupBy(*keys, day_of(time).alias("day")).agg(*aggs)
    return _full_calendar(rolled, keys, "day", DAY) if full_calendar else rolled


def weekly_rollup(obs: DataFrame, keys: Sequence[str], time: str, full_calendar: bool = True) -> DataFrame:
    """Monday to Sunday weeks labelled by their Sunday."""
    rolled = obs.groupBy(*keys, week_ending_sunday(time).alias("week")).agg(*_summaries(obs.columns))
    return _full_calendar(rolled, keys, "week", WEEK) if full_calendar else rolled


def monthly_rollup(daily: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Months from days: mean of daily means, extremes of extremes; labelled by the first day."""
    rules = {"tavg": F.avg, "tmin": F.min, "tmax": F.max, "prcp": F.sum, "wspd": F.avg, "pres": F.avg, "tsun": F.sum}
    aggs = [fn(c).alias(c) for c, fn in rules.items() if c in daily.columns]
    return daily.groupBy(*keys, month_of("day").alias("month")).agg(*aggs)


def direction_rollup(obs: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    return obs.groupBy(*keys, day_of(time).alias("day")).agg(circular_mean("wdir").alias("wdir"))


def daily_mean(series: DataFrame) -> DataFrame:
    return series.groupBy("unique_id", day_of("ds").alias("ds")).agg(F.avg("y").alias("y"))


def coverage(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Non-missing count and share per column, long."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[F.count(c).alias(c) for c in columns])
    return counted.unpivot([*keys, "_n"], list(columns), "measure", "n_present").select(
        *keys, "measure", "n_present", (F.col("n_present") / F.col("_n")).alias("coverage"))


def climate_normals(obs: DataFrame, keys: Sequence[str], time: str, column: str) -> DataFrame:
    """Long-run mean per calendar month and hour."""
    return obs.groupBy(*keys, F.month(time).alias("month"), F.hour(time).alias("hour")).agg(
        F.avg(column).alias("normal"), F.count(column).alias("n"))


def anomaly(obs: DataFrame, keys: Sequence[str], time: str, column: str) -> DataFrame:
    """Each reading against its normal."""
    normals = climate_normals(obs, keys, time, column).drop("n")
    dated = obs.withColumns({"month": F.month(time), "hour": F.hour(time)})
    return (
        attach(dated, normals, [*keys, "month", "hour"], [time])
        .withColumn("anomaly", F.col(column) - F.col("normal"))
        .drop("month", "hour")
    )


def trailing_trend(obs: DataFrame, time: str, column: str, bucket: Column, hours: int = 24) -> DataFrame:
    """Mean over all regions per bucket for the last ``hours`` before the latest reading."""
    latest = obs.agg(F.max(time)).scalar()
    recent = obs.filter(F.col(time) > shift(latest, -hours * 3600))
    return recent.groupBy(bucket.alias("hour")).agg(F.avg(column).alias(column), F.count(column).alias("n"))

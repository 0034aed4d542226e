"""Merges of new rows into stored tables.

Each merge is a plan that returns the table's new state; ``tables`` writes it. Duplicates of a key are
resolved by an aggregation, which combines map-side: a key with very many copies stays cheap.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timeaxis import DAY, day_of, shift
from ..operators.clean import nan_to_null


def pick_row(df: DataFrame, keys: Sequence[str], rank: str, last: bool = True) -> DataFrame:
    """One row per key: the last (first) by the whole number ``rank``, different for all copies of a key.

    Each column is picked by itself at the same rank, which keeps the aggregation hash-based.
    """
    choose = F.max_by if last else F.min_by
    rest = [c for c in df.columns if c not in (*keys, rank)]
    return df.groupBy(*keys).agg(*[choose(c, rank).alias(c) for c in rest])


def upsert(stored: DataFrame, incoming: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """Last write wins on every non-key column; ``seq`` orders the incoming rows of a key."""
    columns = [c for c in stored.columns if c != seq]
    old = stored.select(*columns).withColumn("_rank", F.lit(-(1 << 63)).cast("bigint"))
    new = nan_to_null(incoming).select(*columns, F.col(seq).cast("bigint").alias("_rank"))
    return pick_row(old.unionByName(new), keys, "_rank").select(*columns)


def insert_if_absent(stored: DataFrame, incoming: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """First write wins: stored rows stay, new keys are added once (their first incoming row)."""
    first = pick_row(incoming, keys, seq, last=False)
    fresh = first.join(stored.select(*keys), list(keys), "left_anti")
    return stored.unionByName(fresh.select(*stored.columns))


def append_deduplicated(stored: DataFrame, fetched: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Append a fetch that starts at the last stored time without repeating that row.

    Of fetched copies of a key that differ, the one whose values hash lowest stays, whatever the order of arrival.
    """
    ranked = fetched.withColumn("_rank", F.xxhash64(*[c for c in fetched.columns if c not in keys]))
    fresh = pick_row(ranked, keys, "_rank", last=False).join(stored.select(*keys), list(keys), "left_anti")
    return stored.unionByName(fresh.select(*stored.columns))


def replace_groups(stored: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Delete the stored rows of every group that arrives, then add the arrivals."""
    arriving = incoming.select(*keys).distinct()
    kept = stored.join(arriving, list(keys), "left_anti")
    return kept.unionByName(incoming.select(*stored.columns))


def forecast_rows(forecast: DataFrame) -> DataFrame:
    """Model output (long) as rows of the forecast table; bounds come by name from every model alike."""
    return forecast.select(
        F.col("unique_id").alias("region_id"), F.col("model").alias("model_type"),
        F.col("ds").alias("timestamp"), F.col("yhat").alias("predicted_value"),
        F.col("lo").alias("confidence_low"), F.col("hi").alias("confidence_high"),
        F.col("level").cast("int").alias("confidence_level"))


def metric_rows(metrics: DataFrame) -> DataFrame:
    return metrics.select(
        F.col("unique_id").alias("region_id"), F.col("model").alias("model_type"),
        F.col("metric").alias("metric_name"), F.col("value").alias("metric_value"))


def touched_days(new_rows: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    return new_rows.select(*keys, day_of(time).alias("day")).distinct()


def incremental_rollup(stored_daily: DataFrame, all_rows: DataFrame, new_rows: DataFrame,
                       keys: Sequence[str], time: str, rollup) -> DataFrame:
    """Recompute only the days the new rows touch; other days are taken from the stored roll-up.

    With rows stored by date (an ``obs_date`` column) only the partitions of touched days are read.
    """
    days = touched_days(new_rows, keys, time)
    if "obs_date" in all_rows.columns:
        dates = days.select(F.col("day").cast("date").alias("obs_date")).distinct()
        all_rows = all_rows.join(dates, "obs_date", "left_semi").drop("obs_date")
    redo = all_rows.withColumn("day", day_of(time)).join(days, [*keys, "day"], "left_semi").drop("day")
    kept = stored_daily.join(days, [*keys, "day"], "left_anti")
    return kept.unionByName(rollup(redo).select(*stored_daily.columns))


def retain(df: DataFrame, time: str, days: int) -> DataFrame:
    """Rows no older than ``days`` before the newest row."""
    newest = df.agg(F.max(time)).scalar()
    return df.filter(F.col(time) >= shift(newest, -days * DAY))

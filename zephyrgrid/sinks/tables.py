"""Table layout and files: date partitions, dynamic overwrite, CSV export."""

from __future__ import annotations

import uuid

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stage

PARTITION = "obs_date"


def write_history(df: DataFrame, path: str, region: str, time: str, mode: str = "overwrite",
                  salts: int = 1) -> None:
    """Date partitions, rows ordered by region and latest time first.

    Only the dates present in ``df`` are replaced. ``salts`` spreads each date over several files, for
    dates too large for one writer.
    """
    dated = df.withColumn(PARTITION, F.col(time).cast("date"))
    spread = F.pmod(F.xxhash64(region, time), F.lit(salts))
    (
        dated.repartition(F.col(PARTITION), spread)
        .sortWithinPartitions(PARTITION, region, F.desc(time))
        .write.mode(mode).option("partitionOverwriteMode", "dynamic")
        .partitionBy(PARTITION).parquet(path)
    )


def read_history(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    full = T.StructType(schema.fields + [T.StructField(PARTITION, T.DateType())])
    return spark.read.schema(full).parquet(path)


def create_history(spark: SparkSession, path: str, schema: T.StructType) -> None:
    """An empty dated table, unless there is one."""
    full = T.StructType(schema.fields + [T.StructField(PARTITION, T.DateType())])
    spark.createDataFrame([], full).write.mode("append").partitionBy(PARTITION).parquet(path)


def merge_history(spark: SparkSession, path: str, schema: T.StructType, incoming: DataFrame, region: str, time: str,
                  merge: Callable[[DataFrame, DataFrame], DataFrame], salts: int = 1) -> None:
    """Merge rows into a dated table: only the dates they touch are read and rewritten.

    The merged dates are staged first, so nothing is overwritten while it is read; merges that can be
    repeated make the whole step repeatable after a failure.
    """
    dates = incoming.select(F.col(time).cast("date").alias(PARTITION)).distinct()
    current = read_history(spark, path, schema).join(dates, PARTITION, "left_semi").drop(PARTITION)
    merged = merge(current, incoming).select(*schema.names)
    write_history(stage(merged, "merged-dates"), path, region, time, salts=salts)


def replace_partitions(incoming: DataFrame, path: str, keys: Sequence[str], salts: int = 1) -> None:
    """Replace whole groups, such as the forecasts of a (region, model): other groups are not touched.

    Deletes and inserts in one write; a group that is too large for one writer is spread by ``salts``.
    """
    spread = F.pmod(F.xxhash64(*[c for c in incoming.columns if c not in keys]), F.lit(salts))
    (
        incoming.repartition(*keys, spread).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)
    )


def select_dates(history: DataFrame, time: str, start, end) -> DataFrame:
    """Inclusive time range that also prunes date partitions."""
    lo, hi = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    return history.filter(
        F.col(PARTITION).between(lo.cast("date"), hi.cast("date")) & F.col(time).between(lo, hi)
    ).drop(PARTITION)


def export_csv(tables: dict[str, DataFrame], path: str) -> dict[str, str]:
    """Each table as a folder of CSV files with a header."""
    out = {}
    for name, df in tables.items():
        out[name] = f"{path}/{name}"
        df.write.mode("overwrite").option("header", True).csv(out[name])
    return out


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def drop_old_dates(history: DataFrame, oldest: str) -> DataFrame:
    """Retention by partition: a metadata filter, no row is read to decide."""
    return history.filter(F.col(PARTITION) >= F.lit(oldest).cast("date"))


def columns_only(df: DataFrame, schema: T.StructType, renames: dict[str, str]) -> DataFrame:
    """Project known columns to a table's schema; absent ones are NULL."""
    named = df.withColumnsRenamed(renames)
    cols = [
        (F.col(f.name) if f.name in named.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema.fields
    ]
    return named.select(*cols)


def write_lookup(df: DataFrame, path: str, key: str, order: str, buckets: int = 16) -> DataFrame:
    """A table for lookups and joins by ``key``: hash buckets of it, sorted by key and ``order`` inside, registered under a
    name of its own; returns the table.

    A filter on keys reads their buckets only, row groups of other keys and times are skipped by the sort, and tables of
    the same number of buckets join on ``key`` without an exchange. A key with most rows has all of them in one bucket,
    in one file per writing task: joins read a bucket in one task, scans and filters read its files apart.
    """
    name = f"lookup_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, key).sortBy(key, order).option("path", path).format("parquet").saveAsTable(name)
    return df.sparkSession.table(name)

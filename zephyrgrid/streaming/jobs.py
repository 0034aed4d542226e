"""Streaming roll-ups and ingest over landed files.

Every job reads new files since its checkpoint (available-now trigger), writes files to the shared folder
and can be started again after a failure.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from ..session import scratch_path

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Keys of which a task holds the newest reading before it passes them on.
TASK_KEYS = 100_000


def landed_stream(spark: SparkSession, folder: str, schema: T.StructType, fmt: str = "parquet",
                  name_filter: str | None = None, files_per_trigger: int = 1000) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if name_filter:
        reader = reader.option("pathGlobFilter", name_filter)
    return reader.load(folder)


def tumbling(readings: DataFrame, keys: Sequence[str], time: str, aggs: Sequence, length: str = "1 hour",
             delay: str = "10 minutes") -> DataFrame:
    """Closed windows only: a window is emitted once the watermark has passed its end."""
    return (
        readings.withWatermark(time, delay).groupBy(*keys, F.window(time, length)).agg(*aggs)
        .withColumn("window_start", F.col("window.start").cast("timestamp_ntz")).drop("window")
    )


def sliding(readings: DataFrame, keys: Sequence[str], time: str, aggs: Sequence, length: str = "24 hours",
            every: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    return (
        readings.withWatermark(time, delay).groupBy(*keys, F.window(time, length, every)).agg(*aggs)
        .withColumn("window_end", F.col("window.end").cast("timestamp_ntz")).drop("window")
    )


def deduplicated(readings: DataFrame, keys: Sequence[str], time: str, delay: str = "1 hour") -> DataFrame:
    """Drop repeats of a key that arrive within the watermark."""
    return readings.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def run_append(stream: DataFrame, label: str, checkpoint: str | None = None, output: str | None = None) -> DataFrame:
    """Run to the end of the available files and return the sink as a table."""
    spark = stream.sparkSession
    output = output or scratch_path(spark, f"{label}-out")
    checkpoint = checkpoint or scratch_path(spark, f"{label}-state")
    query = (
        stream.writeStream.format("parquet").outputMode("append")
        .option("path", output).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(output)


def run_batches(stream: DataFrame, write: Callable[[DataFrame, int], None], label: str, mode: str = "update",
                checkpoint: str | None = None) -> None:
    query = (
        stream.writeStream.foreachBatch(write).outputMode(mode)
        .option("checkpointLocation", checkpoint or scratch_path(stream.sparkSession, f"{label}-state"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


class VersionedTable:
    """A small table of current rows: every batch writes the merged state to a folder of its own.

    The folder is named by the batch, so a batch that is run again replaces its own output only. The current version
    is the newest one on storage whose write was completed, so a restarted job goes on from it.
    """

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType):
        self.spark, self.root, self.schema = spark, root, schema

    @property
    def version(self) -> int | None:
        jvm = self.spark.sparkContext._jvm
        done = jvm.org.apache.hadoop.fs.Path(f"{self.root}/v=*/_SUCCESS")
        found = done.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(done)
        return max((int(s.getPath().getParent().getName().removeprefix("v=")) for s in found or []), default=None)

    def read(self, version: int | None = None) -> DataFrame:
        version = self.version if version is None else version
        if version is None or version < 0:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.root}/v={version}")

    def merge(self, batch: DataFrame, batch_id: int, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        merged = merge(self.read(batch_id - 1), batch)
        merged.select(*[f.name for f in self.schema.fields]).write.mode("overwrite").parquet(f"{self.root}/v={batch_id}")


def latest_state(readings: DataFrame, key: str, time: str, columns: Sequence[str]) -> DataFrame:
    """Newest reading per key; one row of state per key."""
    newest = F.max_by(F.struct(time, *columns), F.struct(time, *columns)).alias("_r")
    return readings.groupBy(key).agg(newest).select(key, "_r.*")


def _later(row: tuple, than: tuple | None) -> bool:
    """By (time, tie); a row without a tie comes before one of the same time."""
    return than is None or (row[0], row[1] is not None, row[1] or 0) > (than[0], than[1] is not None, than[1] or 0)


class _Newest(StatefulProcessor):
    """Keeps the newest row of a key and passes on keys that got a newer one.

    A key has one timer, which drops the row once the watermark is ``keep_ms`` past it; a timer that finds a newer row is set
    again for that one. So a change costs a read and a write of the state, as each call is a round trip to the JVM.
    """

    def __init__(self, names: list[str], state: T.StructType, keep_ms: int | None):
        self.names, self.state, self.keep_ms = names, state, keep_ms

    def init(self, handle) -> None:
        self.handle, self.newest = handle, handle.getValueState("newest", self.state)

    def _due(self, row: tuple) -> int:
        return row[0] // 1000 + self.keep_ms

    def handleInputRows(self, key, rows, timerValues):
        before = self.newest.get()
        best = before
        for row in rows:
            found = tuple(row[n] for n in self.names)
            if _later(found, best):
                best = found
        if best is not before:
            self.newest.update(best)
            if self.keep_ms is not None and before is None:
                self.handle.registerTimer(self._due(best))
            yield Row("state_key", *self.names)(*key, *best)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        row = self.newest.get()
        if row is not None and self._due(row) >= timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(self._due(row))
        else:
            self.newest.clear()
        return iter([])

    def close(self) -> None:
        pass


def _newest_in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that are the newest ones of their keys among those around them; ``state_key``, ``state_time`` and the tie come first."""
    def reduced(held: list[pa.RecordBatch]) -> pa.Table:
        rows = pa.Table.from_batches(held).combine_chunks()
        key = pc.dictionary_encode(rows.column(0)).combine_chunks().indices.to_numpy(zero_copy_only=False)
        known = pc.is_valid(rows.column(2)).to_numpy()
        tie = pc.fill_null(rows.column(2), 0).to_numpy()
        order = np.lexsort((tie, known, rows.column(1).to_numpy(), key))
        last = np.append(key[order][1:] != key[order][:-1], True)
        return rows.take(pa.array(order[last]))

    held, fresh = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            fresh += batch.num_rows
        if fresh >= 4 * TASK_KEYS:
            table = reduced(held)
            held, fresh = table.to_batches(), 0
            if table.num_rows > TASK_KEYS:
                yield from held
                held = []
    if held:
        yield from reduced(held).to_batches()


def newest_by_key(readings: DataFrame, key: str, time: str, tie: str, columns: Sequence[str], keep: str | None = None, delay: str = "1 day") -> DataFrame:
    """Keys whose newest reading changed, in update mode: key, time, tie, columns.

    One row of state per key; a batch touches only the keys it brings. Readings may come late or twice: the order is
    (time, tie), ``tie`` a whole number. With ``keep`` (an interval such as ``30 days``) a timer drops the state of a key once the
    watermark, ``delay`` behind the newest reading of all, is that far past it, and readings behind the watermark are
    dropped; without it the state keeps every key. Null keys and times are left out.

    Each task first drops readings that another one of the key outdates, so that fewer rows move to the state; the newest
    reading of all is never among them, and what is late by its newest reading is late in whole.
    """
    kinds = dict(readings.dtypes)
    state = T.StructType.fromDDL(", ".join(["state_time bigint", f"{tie} bigint", *[f"{c} {kinds[c]}" for c in columns]]))
    known = readings.where(F.col(key).isNotNull() & F.col(time).isNotNull())
    rows = known.select(F.col(key).alias("state_key"), F.unix_micros(F.col(time).cast("timestamp")).alias("state_time"), F.col(tie).cast("long").alias(tie), *columns)
    rows = rows.mapInArrow(_newest_in_task, rows.schema)
    if keep is not None:
        rows = rows.withColumn("state_mark", F.timestamp_micros("state_time")).withWatermark("state_mark", delay)
    keep_ms = None if keep is None else int(pd.Timedelta(keep).total_seconds() * 1000)
    readings.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    changed = rows.groupBy("state_key").transformWithState(
        _Newest(state.names, state, keep_ms), T.StructType([T.StructField("state_key", rows.schema["state_key"].dataType), *state.fields]),
        "Update", "None" if keep is None else "EventTime")
    return changed.select(F.col("state_key").alias(key), F.timestamp_micros("state_time").cast("timestamp_ntz").alias(time), tie, *columns)


class NewestTable:
    """Newest row per key as files: every batch adds the changed keys in hash buckets, a base is written now and then.

    A batch that is run again replaces its own folder. Reading merges the newest base and the batches after it; one key's
    bucket can be read alone. ``compact_every`` bounds how many batches a reader merges.
    """

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, key: str, time: str, tie: str, buckets: int = 16, compact_every: int = 20):
        self.spark, self.root, self.schema, self.key, self.time, self.tie = spark, root, schema, key, time, tie
        self.buckets, self.compact_every = buckets, compact_every

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int").alias("_bucket")

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.select(*self.schema.names, self._bucket())

    def _done(self, kind: str) -> list[int]:
        """Numbers of the completed batches or bases."""
        done = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{kind}/n=*/_SUCCESS")
        found = done.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(done)
        return sorted(int(s.getPath().getParent().getName().removeprefix("n=")) for s in found or [])

    def _parts(self) -> tuple[int, list[str]]:
        base = max(self._done("base"), default=-1)
        return base, [f"{self.root}/base/n={base}"] * (base >= 0) + [f"{self.root}/batch/n={n}" for n in self._done("batch") if n > base]

    def read(self, keys: Sequence | None = None) -> DataFrame:
        """Current rows, of some keys only where they are given: then only those keys' buckets are read."""
        schema = T.StructType([*self.schema.fields, T.StructField("_bucket", T.IntegerType())])
        _, parts = self._parts()
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        rows = None
        for part in parts:
            one = self.spark.read.schema(schema).parquet(part)
            rows = one if rows is None else rows.unionByName(one)
        if keys is not None:
            wanted = self.spark.createDataFrame([(k,) for k in keys], T.StructType([self.schema[self.key]]))
            buckets = [r[0] for r in wanted.select(self._bucket()).distinct().collect()]
            rows = rows.where(F.col("_bucket").isin(buckets) & F.col(self.key).isin(list(keys)))
        # One number orders a key's rows: values of fixed width keep the aggregation hash-based.
        rank = F.unix_micros(F.col(self.time).cast("timestamp")).cast("decimal(38,0)") * F.lit(10 ** 10).cast("decimal(11,0)") * F.lit(10 ** 10).cast("decimal(11,0)")
        rank = (rank + F.col(self.tie)).cast("decimal(38,0)")
        newest = rows.withColumn("_rank", rank).groupBy(self.key).agg(*[F.max_by(c, "_rank").alias(c) for c in self.schema.names if c != self.key])
        return newest.select(*self.schema.names)

    def write(self, changed: DataFrame, batch_id: int) -> None:
        self._bucketed(changed).repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.root}/batch/n={batch_id}")
        if len(self._parts()[1]) > self.compact_every:
            self._bucketed(self.read()).repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.root}/base/n={batch_id}")


def mean_beside(readings: DataFrame, others: DataFrame, key: str, time: str, value: str, other_key: str, other_time: str, back: str,
                length: str = "24 hours", every: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Sliding means of one stream beside the rows of another in [window end - ``back``, window end): key, window_end, ``value``,
    then the other stream's columns, NULL for a window without any.

    A window joins once its stream's watermark has closed it; state of both sides is dropped, and a window without a partner
    comes out, when the slower watermark has passed. Later rows are dropped. The streams have different column names.

    A reading is dealt to the ends of its windows, one for each ``every`` in ``back``, and both sides meet by key and end: state is
    looked up by both, so the work follows the rows that meet, and a key's rows spread over its windows.
    """
    windows = readings.withWatermark(time, delay).groupBy(key, F.window(time, length, every)).agg(F.avg(value).alias(value))
    # The window's own time, a microsecond before its end, keeps the watermark that the join needs.
    windows = windows.withColumn("window_at", F.window_time("window")).withColumn("_end", F.unix_micros("window.end"))
    step, size, reach = (int(pd.Timedelta(x).total_seconds() * 1_000_000) for x in (every, length, back))
    # The ends that a reading belongs to: those of the windows' grid after it and not later than ``back``.
    at = F.unix_micros(F.col(other_time).cast("timestamp"))
    first = at - F.pmod(at - F.lit(size % step), F.lit(step)) + F.lit(step)
    ends = F.when(first <= at + F.lit(reach), F.sequence(first, at + F.lit(reach), F.lit(step)))
    dealt = others.withWatermark(other_time, delay).select("*", F.explode(ends).alias("_other_end"))
    within = F.expr(f"{other_time} > window_at - interval {back} and {other_time} <= window_at")
    joined = windows.join(dealt, (F.col(key) == F.col(other_key)) & (F.col("_end") == F.col("_other_end")) & within, "leftOuter")
    return joined.select(key, F.col("window.end").cast("timestamp_ntz").alias("window_end"), value, *others.columns)

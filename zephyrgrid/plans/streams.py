"""Streaming jobs run to the end of the given files (survey section 2.11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.timeaxis import hour_of
from ..session import scratch_path
from ..sinks import tables
from ..sinks.merge import upsert
from ..sources.driver_tables import Tables
from ..streaming import jobs
from .catalog import query


def _readings(t: Tables):
    schema = t.spark.read.parquet(f"{t.folder}/events.parquet").schema
    stream = jobs.landed_stream(t.spark, t.folder, schema, name_filter="events.parquet")
    return stream.select(F.col("event_type").alias("id"), F.col("ts").cast("timestamp").alias("time"), "event_id",
                         "user_id", (F.round(F.col("value") * 4) / 4).alias("temp"), (F.floor("value") / 8).alias("prcp"))


@query("stream_hourly", """select id, date_trunc('hour', "time") as window_start, avg(temp) as temp, sum(prcp) as prcp,
    count(*) as n from obs where date_trunc('hour', "time") + interval 1 hour <= (select max("time") from obs) - interval 10 minute
  group by 1, 2""", "temp")
def stream_hourly(t: Tables):
    """Windows the watermark has closed."""
    rolled = jobs.tumbling(_readings(t), ["id"], "time", [
        F.avg("temp").alias("temp"), F.sum("prcp").alias("prcp"), F.count(F.lit(1)).alias("n")])
    return jobs.run_append(rolled, "hourly")


@query("stream_sliding", """
with ends as (select id, date_trunc('hour', "time") + to_hours(cast(h as int)) as window_end, temp from obs, range(1, 25) r(h))
---
  select id, window_end, avg(temp) as temp from ends where window_end <= (select max("time") from obs) - interval 10 minute
  group by 1, 2""", "temp")
def stream_sliding(t: Tables):
    rolled = jobs.sliding(_readings(t), ["id"], "time", [F.avg("temp").alias("temp")])
    return jobs.run_append(rolled, "sliding")


@query("stream_upsert", """select id, date_trunc('hour', "time") as "time", arg_max(temp, event_id) as temp from obs group by 1, 2""")
def stream_upsert(t: Tables):
    """Repeated deliveries are dropped, then each batch is merged by (id, hour)."""
    twice = _readings(t)
    once = jobs.deduplicated(twice.unionByName(twice), ["event_id"], "time", "30 days")
    schema, path = _schema("id string, time timestamp_ntz, temp double"), scratch_path(t.spark, "upsert")
    tables.create_history(t.spark, path, schema)

    def write(batch, batch_id):
        rows = batch.select("id", hour_of("time").alias("time"), "temp", "event_id")
        tables.merge_history(t.spark, path, schema, rows, "id", "time",
                             lambda old, new: upsert(old, new, ["id", "time"], "event_id"))

    jobs.run_batches(once, write, "upsert", "append")
    return tables.read_history(t.spark, path, schema).drop(tables.PARTITION)


@query("stream_latest", """select id, max("time") as "time", arg_max(temp, "time") as temp, arg_max(event_id, "time") as event_id
    from obs_user group by 1""")
def stream_latest(t: Tables):
    """Keyed state over two runs: the second one goes on from the first one's checkpoint with files that came since."""
    landing, state = scratch_path(t.spark, "landing"), scratch_path(t.spark, "latest-state")
    events = t.spark.read.parquet(f"{t.folder}/events.parquet").withColumn("half", (F.col("event_id") % 2).cast("int"))
    schema = _schema("id string, time timestamp_ntz, event_id bigint, temp double")
    table = jobs.NewestTable(t.spark, scratch_path(t.spark, "latest"), schema, "id", "time", "event_id")
    for half in range(2):
        events.where(F.col("half") == half).drop("half").write.mode("append").parquet(landing)
        stream = jobs.landed_stream(t.spark, landing, events.drop("half").schema)
        readings = stream.select(F.col("user_id").cast("string").alias("id"), F.col("ts").cast("timestamp").alias("time"), "event_id",
                                 (F.round(F.col("value") * 4) / 4).alias("temp"))
        newest = jobs.newest_by_key(readings, "id", "time", "event_id", ["temp"], keep="3650 days", delay="3650 days")
        jobs.run_batches(newest, table.write, "latest", "update", state)
    return table.read().select("id", "time", "temp", "event_id")


@query("stream_temp_load", """
with marks as (select least(max("time") filter (event_id % 2 = 0), max("time") filter (event_id % 2 = 1)) - interval 10 minute as mark from obs),
ends as (select id, date_trunc('hour', "time") + to_hours(cast(h as int)) as window_end, temp from obs, range(1, 25) r(h) where event_id % 2 = 0),
means as (select id, window_end, avg(temp) as temp from ends where window_end <= (select mark from marks) group by 1, 2)
---
  select m.id, window_end, m.temp, o."time" as load_time, o.temp as load from means m left join obs o
    on o.id = m.id and o.event_id % 2 = 1 and o."time" >= window_end - interval 1 hour and o."time" < window_end""", "temp")
def stream_temp_load(t: Tables):
    """Sliding mean temperature of a day beside the load readings of its last hour; windows without one come out as well."""
    readings = _readings(t)
    warm = readings.where("event_id % 2 = 0").select("id", "time", "temp")
    load = readings.where("event_id % 2 = 1").select(F.col("id").alias("load_id"), F.col("time").alias("load_time"), F.col("temp").alias("load"))
    joined = jobs.mean_beside(warm, load, "id", "time", "temp", "load_id", "load_time", "1 hour")
    return jobs.run_append(joined, "temp-load").select("id", "window_end", "temp", F.col("load_time").cast("timestamp_ntz").alias("load_time"), "load")


def _schema(ddl: str):
    from pyspark.sql.types import StructType
    return StructType.fromDDL(ddl)

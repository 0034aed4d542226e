"""Keyed state and stream joins over several deliveries, late rows and restarts."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from zephyrgrid.session import scratch_path
from zephyrgrid.streaming import jobs

READING = "id string, time string, event_id long, temp double"


@pytest.fixture
def landing(spark):
    """A landing folder, how to deliver rows to it, and its stream."""
    folder = scratch_path(spark, "landing")

    def deliver(rows):
        frame = spark.createDataFrame(rows, READING).withColumn("time", F.col("time").cast("timestamp"))
        frame.coalesce(1).write.mode("append").parquet(folder)
        return jobs.landed_stream(spark, folder, frame.schema)
    return deliver


def test_newest_over_restarts(spark, landing):
    state, schema = scratch_path(spark, "state"), StructType.fromDDL("id string, time timestamp_ntz, event_id bigint, temp double")
    table = jobs.NewestTable(spark, scratch_path(spark, "newest"), schema, "id", "time", "event_id", buckets=4, compact_every=2)

    def run(rows):
        stream = landing(rows)
        jobs.run_batches(jobs.newest_by_key(stream, "id", "time", "event_id", ["temp"]), table.write, "newest", "update", state)
        return {r["id"]: (str(r["time"]), r["event_id"], r["temp"]) for r in table.read().collect()}

    keys = [f"k{i}" for i in range(12)]
    first = run([(k, "2024-01-01 10:00:00.25", 1, 1.0) for k in keys] + [("k0", "2024-01-01 11:00:00", 2, 2.0), (None, "2024-01-01 10:00:00", 3, 9.0)])
    assert len(first) == 12 and first["k0"] == ("2024-01-01 11:00:00", 2, 2.0) and first["k1"][0] == "2024-01-01 10:00:00.250000"
    # Late and repeated rows change nothing, equal times go by number, only changed keys are written.
    second = run([("k0", "2024-01-01 09:00:00", 9, 9.0), ("k1", "2024-01-01 10:00:00.25", 7, 3.0), ("k2", "2024-01-01 10:00:00.25", 1, 1.0), ("new", "2023-01-01 00:00:00", 4, 4.0)])
    assert second == first | {"k1": ("2024-01-01 10:00:00.250000", 7, 3.0), "new": ("2023-01-01 00:00:00", 4, 4.0)}
    written = spark.read.parquet(f"{table.root}/batch/n={max(table._done('batch'))}")
    assert {r["id"] for r in written.collect()} == {"k1", "new"} and len(written.inputFiles()) <= 2
    third = run([("k5", "2024-02-01 00:00:00", 5, 5.0)])
    fourth = run([("k6", "2024-02-01 00:00:00", 6, 6.0)])
    assert table._done("base") and third["k5"][2] == 5.0 and fourth == third | {"k6": ("2024-02-01 00:00:00", 6, 6.0)}
    some = table.read(["k5", "none"])
    assert [r["temp"] for r in some.collect()] == [5.0]
    assert "PartitionFilters: [_bucket" in some._jdf.queryExecution().executedPlan().toString()


def test_silent_keys_leave_the_state(spark, landing):
    state, rows = scratch_path(spark, "state"), []

    def write(batch, batch_id):
        rows.extend((batch_id, r["id"], r["temp"]) for r in batch.collect())

    kept = []
    for delivery in ([("a", "2024-01-01 00:00:00", 1, 1.0), ("b", "2024-01-01 00:00:00", 2, 2.0)], [("b", "2024-03-01 00:00:00", 3, 3.0)], [("b", "2024-03-02 00:00:00", 4, 4.0)]):
        stream = landing(delivery)
        newest = jobs.newest_by_key(stream, "id", "time", "event_id", ["temp"], keep="10 days", delay="1 hour")
        query = newest.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination()
        kept.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    assert [r[1:] for r in rows] == [("a", 1.0), ("b", 2.0), ("b", 3.0), ("b", 4.0)] or sorted(r[1:] for r in rows[:2]) == [("a", 1.0), ("b", 2.0)]
    assert kept[-1] < kept[0]


def test_windows_beside_readings(spark, landing):
    out, state = scratch_path(spark, "out"), scratch_path(spark, "state")

    def run(rows):
        stream = landing(rows)
        warm = stream.where("event_id % 2 = 0").select("id", "time", "temp")
        load = stream.where("event_id % 2 = 1").select(F.col("id").alias("load_id"), F.col("time").alias("load_time"), F.col("temp").alias("load"))
        joined = jobs.mean_beside(warm, load, "id", "time", "temp", "load_id", "load_time", "1 hour", "2 hours", "1 hour")
        made = jobs.run_append(joined, "beside", state, out).where("id <> 'z'")
        return sorted((r["id"], str(r["window_end"])[11:16], r["temp"], r["load"]) for r in made.collect())

    first = run([("a", "2024-01-01 00:10:00", 0, 1.0), ("a", "2024-01-01 00:50:00", 2, 3.0), ("a", "2024-01-01 00:00:00", 1, 9.0),
                 ("a", "2024-01-01 01:00:00", 3, 8.0), ("z", "2024-01-01 03:00:00", 4, 0.0), ("z", "2024-01-01 03:00:00", 5, 0.0)])
    # The reading at 01:00 is in the hour before 02:00, not in the one before 01:00.
    assert first == [("a", "01:00", 2.0, 9.0), ("a", "02:00", 2.0, 8.0)]
    # A late reading is dropped; a window without a load reading comes out alone once both watermarks have passed.
    late = [("a", "2024-01-01 00:20:00", 6, 100.0), ("a", "2024-01-01 04:10:00", 8, 5.0)]
    run([*late, ("z", "2024-01-02 00:00:00", 10, 0.0), ("z", "2024-01-02 00:00:00", 11, 0.0)])
    last = run([("z", "2024-01-03 00:00:00", 12, 0.0), ("z", "2024-01-03 00:00:00", 13, 0.0)])
    assert last == [*first, ("a", "05:00", 5.0, None), ("a", "06:00", 5.0, None)]


def test_tasks_pass_on_the_newest_reading_of_a_key(monkeypatch):
    rng = random.Random(4)
    rows = [(f"k{rng.randrange(60)}", rng.randrange(5), rng.choice([None, *range(4)]), i) for i in range(1000)]
    batch = lambda part: pa.RecordBatch.from_arrays([pa.array([r[c] for r in part], k) for c, k in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int64()))], ["state_key", "state_time", "tie", "x"])
    order = lambda r: (r["state_time"], r["tie"] is not None, r["tie"] or 0)
    want = {}
    for r in batch(rows).to_pylist():
        want[r["state_key"]] = max(want.get(r["state_key"], r), r, key=order)
    for held, most in ((1000, 60), (20, 999)):
        monkeypatch.setattr(jobs, "TASK_KEYS", held)
        out = [r for b in jobs._newest_in_task(iter([batch(rows[i:i + 30]) for i in range(0, 1000, 30)] + [batch([])])) for r in b.to_pylist()]
        got = {}
        for r in out:
            got[r["state_key"]] = max(got.get(r["state_key"], r), r, key=order)
        assert {k: order(r) for k, r in got.items()} == {k: order(r) for k, r in want.items()} and len(out) <= most
    assert list(jobs._newest_in_task(iter([batch([])]))) == []


def test_a_timer_waits_for_the_newest_reading(spark, landing):
    """The state of a goes by its second reading: still held when the first one is due, gone when the second one is."""
    state, rows, kept = scratch_path(spark, "state"), [], []
    for delivery in ([("a", "2024-01-01 00:00:00", 1, 1.0)], [("a", "2024-01-08 00:00:00", 2, 2.0)], [("z", "2024-01-13 00:00:00", 3, 3.0)],
                     [("a", "2024-01-13 00:00:00", None, 4.0), ("z", "2024-02-13 00:00:00", 5, 5.0)], [("z", "2024-02-14 00:00:00", 6, 6.0)]):
        newest = jobs.newest_by_key(landing(delivery), "id", "time", "event_id", ["temp"], keep="10 days", delay="1 hour")
        query = newest.writeStream.foreachBatch(lambda b, n: rows.extend(r["temp"] for r in b.collect())).outputMode("update").option(
            "checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination()
        kept.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    assert sorted(rows) == [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]
    assert kept[0] == kept[1] == kept[-1] and kept[2] == 2 * kept[0]


def test_readings_meet_all_their_windows_by_key_and_end(spark, landing):
    rng = random.Random(6)
    rows = [(rng.choice("ab"), f"2024-01-01 {h:02d}:{m:02d}:00", 2 * i + k, float(rng.randrange(8)))
            for i, (h, m) in enumerate((rng.randrange(8), rng.choice([0, 15, 30, 59])) for _ in range(40)) for k in (0, 1)]
    stream = landing([*rows, *[("z", "2024-01-03 00:00:00", 1000 + k, 0.0) for k in (0, 1)]])
    minutes = lambda r: int(r[1][11:13]) * 60 + int(r[1][14:16])
    for back, reach in (("150 minutes", 150), ("20 minutes", 20)):
        load = stream.where("event_id % 2 = 1").select(F.col("id").alias("load_id"), F.col("time").alias("load_time"), "event_id")
        joined = jobs.mean_beside(stream.where("event_id % 2 = 0").select("id", "time", "temp"), load, "id", "time", "temp", "load_id", "load_time", back, "90 minutes", "1 hour")
        plan = joined._jdf.queryExecution().analyzed().toString()
        assert any("Join LeftOuter" in line and "_end#" in line and "_other_end#" in line for line in plan.splitlines())
        got = sorted(((r["id"], (r["window_end"].day - 1) * 1440 + r["window_end"].hour * 60 + r["window_end"].minute, r["temp"], r["event_id"])
                      for r in jobs.run_append(joined, "meet").where("id <> 'z'").collect()), key=str)
        want = []
        for key in "ab":
            for end in range(30, 1440, 60):
                warm = [r[3] for r in rows if r[0] == key and r[2] % 2 == 0 and end - 90 <= minutes(r) < end]
                met = [r[2] for r in rows if r[0] == key and r[2] % 2 == 1 and end - reach <= minutes(r) < end]
                want += [(key, end, sum(warm) / len(warm), m) for m in met or [None]] if warm else []
        assert got == sorted(want, key=str) and len({g[3] for g in got}) > 1

"""Merges, table layout, readers and streams on small files."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zephyrgrid import schema
from zephyrgrid.operators import energy
from zephyrgrid.session import scratch_path, shared_dir
from zephyrgrid.sinks import merge, tables
from zephyrgrid.sources import readers
from zephyrgrid.streaming import jobs

OBS = "id string, time timestamp_ntz, temp double, seq bigint"


def test_upsert_last_write_wins(frame):
    stored = frame([("a", "2024-01-01 00:00:00", 1.0, 0), ("b", "2024-01-01 00:00:00", 2.0, 0)], OBS).drop("seq")
    new = frame([("a", "2024-01-01 00:00:00", 5.0, 1), ("a", "2024-01-01 00:00:00", None, 2),
                 ("c", "2024-01-01 00:00:00", float("nan"), 1), ("b", "2024-01-01 01:00:00", 7.0, 1)], OBS)
    out = {(r.id, r.time.hour): r.temp for r in merge.upsert(stored, new, ["id", "time"], "seq").collect()}
    assert out == {("a", 0): None, ("b", 0): 2.0, ("b", 1): 7.0, ("c", 0): None}


def test_upsert_twice_changes_nothing(frame):
    stored = frame([("a", "2024-01-01 00:00:00", 1.0, 0)], OBS).drop("seq")
    new = frame([("a", "2024-01-01 00:00:00", 5.0, 1)], OBS)
    once = merge.upsert(stored, new, ["id", "time"], "seq")
    assert merge.upsert(once, new, ["id", "time"], "seq").collect() == once.collect()


def test_insert_if_absent_keeps_the_first(frame):
    stored = frame([("a", 1.0, 0)], "id string, lat double, seq bigint").drop("seq")
    new = frame([("a", 9.0, 1), ("b", 3.0, 2), ("b", 2.0, 1)], "id string, lat double, seq bigint")
    assert {(r.id, r.lat) for r in merge.insert_if_absent(stored, new, ["id"], "seq").collect()} == {("a", 1.0), ("b", 2.0)}


def test_boundary_row_is_not_repeated(frame):
    stored = frame([("a", "2024-01-01 00:00:00", 1.0, 0)], OBS)
    fetched = frame([("a", "2024-01-01 00:00:00", 1.0, 0), ("a", "2024-01-01 01:00:00", 2.0, 0)], OBS)
    assert merge.append_deduplicated(stored, fetched, ["id", "time"]).count() == 2


def test_forecast_rows_keep_bounds_of_every_model(frame):
    fc = frame([("a", "AutoThing", "2024-01-01 00:00:00", 1.0, 0.5, 1.5, 80)],
               "unique_id string, model string, ds timestamp_ntz, yhat double, lo double, hi double, level int")
    row = merge.forecast_rows(fc).first()
    assert (row.confidence_low, row.confidence_high, row.confidence_level) == (0.5, 1.5, 80)
    assert merge.forecast_rows(fc).schema.names == schema.FORECAST.names


def test_layout_prunes_and_overwrites_touched_dates_only(spark, frame):
    path = scratch_path(spark, "layout")
    first = frame([("a", f"2024-01-0{d} 05:00:00", float(d), 0) for d in range(1, 6)], OBS)
    tables.write_history(first, path, "id", "time")
    tables.write_history(frame([("a", "2024-01-02 06:00:00", 20.0, 0)], OBS), path, "id", "time", salts=4)
    back = tables.read_history(spark, path, first.schema)
    part = tables.select_dates(back, "time", "2024-01-02 00:00:00", "2024-01-03 05:00:00")
    assert sorted(r.temp for r in part.collect()) == [3.0, 20.0]
    assert back.count() == 5
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(obs_date" in plan and "PushedFilters: [IsNotNull(time)" in plan
    assert tables.drop_old_dates(back, "2024-01-04").count() == 2


def test_csv_round_trip(spark, frame):
    df = frame([("a", "2024-01-01 00:00:00", 1.5, 1), ("b", "2024-01-01 00:00:00", None, 2)], OBS)
    paths = tables.export_csv({"obs": df}, scratch_path(spark, "csv"))
    back = tables.read_csv(spark, paths["obs"], df.schema)
    assert sorted(back.collect(), key=lambda r: r.id) == sorted(df.collect(), key=lambda r: r.id)


def test_columns_only(frame):
    df = frame([("2024-01-01 00:00:00", 1.0, "x")], "timestamp string, temp double, extra string")
    out = tables.columns_only(df, schema.HOURLY, {"timestamp": "time"})
    assert out.columns == schema.HOURLY.names and out.first().time == dt.datetime(2024, 1, 1)


@pytest.mark.parametrize("fmt", ["csv", "parquet", "json"])
def test_read_hourly_formats(spark, frame, fmt):
    path = scratch_path(spark, "hourly")
    df = tables.columns_only(frame([("2024-01-01 00:00:00", "z", 1.0), ("2024-01-02 00:00:00", "z", float("nan"))],
                                   "time timestamp_ntz, region_name string, temp double"), schema.HOURLY, {})
    df.write.format(fmt).option("header", True).save(path)
    out = readers.read_hourly(spark, path, fmt, start="2024-01-01 00:00:00", end="2024-01-02 00:00:00").orderBy("time").collect()
    assert [r.temp for r in out] == [1.0, None]


def test_envelopes(spark, frame):
    docs = [json.dumps({"response": {"data": [{"period": "p1", "value": 1.5}, {"period": "p2", "value": None}]}}), "{}", "not json"]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "doc int, payload string")
    out = readers.parse_envelope(df, "payload", "struct<period: string, value: double>").orderBy("period").collect()
    assert [(r.doc, r.period, r.value) for r in out] == [(0, "p1", 1.5), (0, "p2", None)]


def test_geo_file(spark):
    square = [[0.0, 0.0], [2.0, 0.0], [2.0, 2.0], [0.0, 0.0]]
    hole = [[1.0, 1.0], [1.0, 1.0]]

    def feature(zone, kind, coordinates, country="United States"):
        return {"properties": {"zoneName": zone, "countryName": country}, "geometry": {"type": kind, "coordinates": coordinates}}

    doc = {"features": [feature("Z", "MultiPolygon", [[square, hole], [hole]]), feature("P", "Polygon", [square]),
                        feature("X", "MultiPolygon", [[square]], "Elsewhere")]}
    path = scratch_path(spark, "geo")
    spark.createDataFrame([(json.dumps(doc, indent=1),)], "value string").write.text(path)
    features = readers.read_feature_collection(spark, path)
    assert features.count() == 3
    row = readers.zone_centroids(features).collect()
    assert len(row) == 1 and row[0].zone == "Z" and row[0].n_points == 8
    assert (row[0].lon, row[0].lat) == (1.0, 0.75)


def test_zone_catalogue_and_prefix_rules(spark):
    zones = readers.zone_catalogue(spark)
    assert zones.count() == 19
    found = {(r.zone, r.state) for r in energy.zone_states(zones).collect()}
    assert ("US-CAR-SC", "South Carolina") in found and ("US-CAR-SC", "North Carolina") in found
    assert ("US-MIDW-LGEE", "Kentucky") in found and ("US-MIDW-MISO", "Virginia") in found
    assert {s for z, s in found if z == "US-SE-SOCO"} == {"Alabama", "Georgia", "Mississippi"}


def test_synthetic_series(spark, frame):
    spine = frame([("a", f"2024-01-01 {h:02d}:00:00") for h in range(24)], "unique_id string, ds timestamp_ntz")
    calm = readers.synthetic_series(spine, 0.0).toPandas().y
    noisy = readers.synthetic_series(spine, 5.0).toPandas().y
    assert calm.between(4.9, 35.1).all() and 0 < (noisy - calm).std() < 12


def test_fallback_and_tariffs(frame):
    a = frame([("FL", "u1", 1.0)], "state string, utility string, rate double")
    b = frame([("FL", "u2", 2.0), ("GA", "u3", 3.0)], "state string, utility string, rate double")
    out = {(r.state, r.rate, r.source) for r in readers.with_fallback(a, b, ["state"]).collect()}
    assert out == {("FL", 1.0, "primary"), ("GA", 3.0, "fallback")}
    assert readers.tariffs(b, "GA").count() == 1 and readers.tariffs(b, "FL", "u9").count() == 0


def test_energy_edge_cases(frame):
    gen = frame([("z", "SUN", 0.0), ("y", "SUN", 1.0), ("y", "COL", 2.0)], "zone string, fueltype string, value double")
    assert {r.zone: (r.renewable, r.conventional) for r in energy.renewable_share(gen).collect()} == {
        "z": (0.0, 0.0), "y": (33.33, 66.67)}
    flows = frame([("a", "b", -50.0), ("a", "c", 5.0)], "from_zone string, to_zone string, value double")
    caps = frame([("a", "b", 40.0)], "from_zone string, to_zone string, capacity double")
    out = {r.to_zone: (r.available_capacity, r.utilization_pct) for r in energy.transfer_capacity(flows, caps).collect()}
    assert out == {"b": (0.0, 125.0), "c": (0.0, 0.0)}


def _land(spark, path, rows):
    df = spark.createDataFrame(rows, "event_id bigint, id string, time string, temp double").withColumn(
        "time", F.col("time").cast("timestamp"))
    df.coalesce(1).write.mode("append").parquet(path)
    return df.schema


def test_repeated_rows_are_dropped_across_runs(spark):
    path, out, state = (scratch_path(spark, n) for n in ("land", "out", "state"))

    def run():
        stream = jobs.landed_stream(spark, path, schema_)
        return jobs.run_append(jobs.deduplicated(stream, ["event_id"], "time", "30 minutes"), "once", state, out).count()

    schema_ = _land(spark, path, [(1, "a", "2024-01-01 00:05:00", 1.0), (2, "a", "2024-01-01 00:50:00", 2.0)])
    assert run() == 2
    _land(spark, path, [(2, "a", "2024-01-01 00:50:00", 2.0), (3, "a", "2024-01-01 00:40:00", 4.0)])
    assert run() == 3
    _land(spark, path, [(4, "a", "2024-01-01 05:00:00", 8.0)])
    assert run() == 4


def test_windows_close_behind_the_watermark(spark):
    path, out, state = (scratch_path(spark, n) for n in ("land", "out", "state"))
    aggs = [F.count(F.lit(1)).alias("n"), F.sum("temp").alias("temp")]

    def run():
        stream = jobs.landed_stream(spark, path, schema_)
        rolled = jobs.tumbling(stream, ["id"], "time", aggs, delay="10 minutes")
        return {r.window_start.hour: (r.n, r.temp) for r in jobs.run_append(rolled, "hourly", state, out).collect()}

    schema_ = _land(spark, path, [(1, "a", "2024-01-01 00:05:00", 1.0), (2, "a", "2024-01-01 01:05:00", 2.0)])
    assert run() == {}
    _land(spark, path, [(3, "a", "2024-01-01 00:59:00", 4.0)])  # late, within the delay
    assert run() == {}
    _land(spark, path, [(4, "a", "2024-01-01 03:00:00", 8.0)])
    assert run() == {0: (2, 5.0), 1: (1, 2.0)}
    _land(spark, path, [(5, "a", "2024-01-01 00:10:00", 16.0), (6, "a", "2024-01-01 05:00:00", 1.0)])  # beyond it
    assert run() == {0: (2, 5.0), 1: (1, 2.0), 3: (1, 8.0)}


def test_versioned_table_reruns_a_batch(spark):
    table = jobs.VersionedTable(spark, scratch_path(spark, "v"), T.StructType.fromDDL("id string, seq bigint"))
    one = spark.createDataFrame([("a", 1)], table.schema)
    two = spark.createDataFrame([("a", 2), ("b", 1)], table.schema)
    def newest(old, new):
        return old.unionByName(new).groupBy("id").agg(F.max("seq").alias("seq"))
    table.merge(one, 0, newest)
    for _ in range(2):
        table.merge(two, 1, newest)
    assert {(r.id, r.seq) for r in table.read().collect()} == {("a", 2), ("b", 1)}
    again = jobs.VersionedTable(spark, table.root, table.schema)  # a restarted job without new files
    assert {(r.id, r.seq) for r in again.read().collect()} == {("a", 2), ("b", 1)}
    assert jobs.VersionedTable(spark, scratch_path(spark, "none"), table.schema).read().count() == 0


def test_shared_folder_is_the_sessions(spark):
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        assert found.replace("file:", "") in shared_dir(spark)

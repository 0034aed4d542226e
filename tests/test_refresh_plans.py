"""The daily refresh end to end, and the shape of physical plans."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as e
from zephyrgrid.plans import load_all
from zephyrgrid.models.forecaster import Forecaster
from zephyrgrid.plans.refresh import Store, forecast_all, left_out_rows, refresh
from zephyrgrid.schema import HOURLY, MEASURES
from zephyrgrid.session import scratch_path
from zephyrgrid.sinks import tables
from zephyrgrid.sources.driver_tables import Tables

FOLDER = "/root/testdata/sf0.001"
ROWS_ONLY = set(e.queries()) - set(e.oracle_sql())
# These queries run streams or solve small systems in pandas.
PYTHON = ROWS_ONLY | {"ar2_d1_fit", "adf_stat", "adf_autolag", "arima_residuals"}


def test_refresh_twice(spark):
    t = Tables(spark, FOLDER)
    landed = tables.columns_only(t.hourly().withColumnRenamed("id", "region_name"), HOURLY, {}).cache()
    store = Store(spark, scratch_path(spark, "store"))
    early = landed.filter(F.col("time") < F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"))
    models = ("SeasonalNaive", "SeasonalAR", "FourierTrend", "WeeklySequence")
    refresh(store, early, "2024-01-20 00:00:00", models=("SeasonalNaive", "WeeklySequence"))
    assert store.history().count() == early.count()
    refresh(store, landed, "2024-01-31 00:00:00", models=models)
    history = store.history()
    assert history.count() == landed.count() == history.select("region_name", "time").distinct().count()
    daily, want = store.read("daily"), landed.groupBy("region_name", F.col("time").cast("date")).count()
    assert daily.count() == want.count()
    forecasts = store.read("forecasts")
    steps = {(r[0], r[1]): r[2] for r in forecasts.groupBy("region_id", "model_type").count().collect()}
    assert len(steps) == 20 and all(n == (7 if model == "WeeklySequence" else 24) for (_, model), n in steps.items())
    assert store.read("left_out").count() == 0
    assert forecasts.agg(F.countDistinct("region_id")).first()[0] == 5
    assert store.read("metrics").filter("metric_name = 'rmse'").count() == 20
    assert set(MEASURES) <= set(history.columns)


def test_every_model_by_name_and_who_is_left_out(spark):
    rng = np.random.default_rng(4)
    rows = [(uid, i, float(10 + np.sin(i / 4) + rng.normal(0, 0.1))) for uid, n in (("long", 900), ("brief", 30)) for i in range(n)]
    series = spark.createDataFrame(rows, "unique_id string, i int, y double").selectExpr(
        "unique_id", "cast(timestamp_seconds(i * 3600) as timestamp_ntz) as ds", "y").cache()
    names = ["SeasonalAR", "ARIMA", "BoostedTrees", "WeeklySequence", "Recurrent"]
    options = {"BoostedTrees": {"trees": 3, "depth": 3}, "Recurrent": {"hidden": (3,), "steps": 5}}
    made = forecast_all(series, 6, models=names, options=options).cache()
    steps = {(r[0], r[1]): r[2] for r in made.filter("yhat is not null").groupBy("unique_id", "model").count().collect()}
    assert {m: steps["long", m] for m in names} == {"SeasonalAR": 6, "ARIMA": 6, "BoostedTrees": 6, "WeeklySequence": 7, "Recurrent": 7}
    left = {(r["region_id"], r["model_type"], r["reason"]) for r in left_out_rows(series, made, names).collect()}
    assert ("brief", "WeeklySequence", "too short") in left and not any(r[0] == "long" for r in left)
    assert {r[:2] for r in left} == {("brief", m) for m in names if ("brief", m) not in steps}


def test_coarser_forecasts(spark):
    rows = [(i, float(i // 96)) for i in range(96 * 40)]
    series = spark.createDataFrame(rows, "i int, y double").selectExpr(
        "'q' as unique_id", "cast(timestamp_seconds(i * 900) as timestamp_ntz) as ds", "y")
    model = Forecaster("SeasonalNaive", "15min").fit(series)
    days = model.forecast_at("D").orderBy("ds").collect()
    assert [r["yhat"] for r in days] == [33.0, 34.0, 35.0, 36.0, 37.0, 38.0, 39.0] and str(days[0]["ds"]) == "1970-02-10 00:00:00"
    assert model.forecast_at("H").count() == 24 and model.forecast_at("15min").count() == 96
    with pytest.raises(ValueError, match="cannot give"):
        Forecaster("SeasonalNaive", "D").fit(series).forecast_at("H")


def test_lookups_move_no_rows(spark):
    df = e.queries()["history_lookup"](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan
    rows = spark.createDataFrame([(f"r{i % 50}", i) for i in range(500)], "region string, t long")
    table = tables.write_lookup(rows, scratch_path(spark, "lookup"), "region", "t", 8)
    assert table.filter("region = 'r7'").count() == 10
    # Files of other buckets are skipped either way; only a bucketed scan prints it.
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    try:
        plan = table.filter("region = 'r7'")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    assert "SelectedBucketsCount: 1 out of 8" in plan


@pytest.mark.parametrize("name", [n for n in load_all().QUERIES if n not in PYTHON and not n.startswith("stream")])
def test_plan_shape(spark, name):
    """Built-in expressions only, no comparison of all pairs, no window over a whole series."""
    plan = e.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    for bad in ("ArrowEvalPython", "BatchEvalPython", "MapInPandas", "MapInArrow", "FlatMapGroupsInPandas",
                "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in plan, f"{bad}\n{plan}"
    for line in plan.splitlines():
        if re.search(r"\bWindow \[", line):
            # Within a block, or over the summaries of blocks, buckets and phases.
            bounded = any(mark in line for mark in ("_blk#", "_b#", "sum(_n#", "_raw#", "_depth#"))
            # The two named rank within a user's readings and a home's few neighbours.
            assert bounded or name in ("topk_recent", "tariff_near"), line


@pytest.mark.parametrize("name", ["daily_rollup", "daily_rollup_sparse", "weekly_rollup", "monthly_rollup"])
def test_rollups_scan_raw_rows_once(spark, name):
    """The roll-up is staged, so the plan that reads it twice has no scan of the raw rows left."""
    plan = e.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "events.parquet" not in plan and "rolled-" in plan


def test_time_range_reaches_the_scan_of_a_rollup(spark):
    plan = e.queries()["range_select_hourly"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "LessThan(ts" in plan


def test_filters_and_columns_reach_the_scan(spark):
    df = Tables(spark, FOLDER).raw("lineitem").filter(F.col("l_quantity") > 10).select("l_orderkey")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity,10.0)" in plan
    assert re.search(r"ReadSchema: struct<l_orderkey:bigint,l_quantity:double>", plan)


def test_top_rows_are_limited_before_the_shuffle(spark):
    plan = e.queries()["topk_recent"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan

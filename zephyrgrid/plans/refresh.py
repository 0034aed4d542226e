"""The daily refresh: new observations in, history, roll-ups, forecasts and metrics out, for all regions.

There is no loop over regions: every step is one job over all of them. Every write replaces whole dates or
whole (region, model) groups, so a refresh that failed half-way is simply run again.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..models import arima, backtest, boosted, fourier_trend, recurrent, seasonal_ar, seasonal_naive, weekly_sequence
from ..models.folds import FoldPlan
from ..models.forecaster import left_out
from ..operators import grid, rollup
from ..operators.clean import clean_hourly
from ..schema import HOURLY, MEASURES, STEP_SECONDS
from ..session import scratch_path, stage
from ..sinks import merge, tables
from ..sources.driver_tables import Tables
from .catalog import query

MODELS = (seasonal_naive.NAME, seasonal_ar.NAME, fourier_trend.NAME, weekly_sequence.NAME)
# These work on daily means and look a week ahead.
WEEKLY = (weekly_sequence.NAME, recurrent.NAME)
WEEK = 7


@dataclass(frozen=True)
class Store:
    """Where the tables live; ``root`` must be reachable from every executor."""

    spark: SparkSession
    root: str

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def history(self) -> DataFrame:
        return tables.read_history(self.spark, self.path("history"), HOURLY)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))


def ingest(store: Store, landed: DataFrame, now, default_days: int = 365) -> DataFrame:
    """Add the landed rows newer than each region's stored history; returns the rows added.

    The last stored row of each region is cleaned along with the fresh ones and left out again: gaps at the start of
    a batch are filled from it, and a single new hour passes the two-row rule.
    """
    tables.create_history(store.spark, store.path("history"), HOURLY)
    regions = landed.select("region_name").distinct()
    starts = grid.incremental_start(regions, store.history(), "region_name", "time", now, default_days)
    fresh = grid.incremental_fetch(landed, starts, "region_name", "time")
    fresh = tables.columns_only(fresh, HOURLY, {})
    stored = store.history().select(*HOURLY.names)
    last = merge.pick_row(stored.withColumn("_rank", F.unix_micros(F.col("time").cast("timestamp"))), ["region_name"], "_rank").select(*HOURLY.names)
    seeds = last.join(fresh.select("region_name").distinct(), "region_name", "left_semi")
    old = seeds.select("region_name", "time")
    both = seeds.unionByName(fresh.select(*HOURLY.names).join(old, ["region_name", "time"], "left_anti"))
    cleaned = clean_hourly(both, ["region_name"], "time").join(old, ["region_name", "time"], "left_anti")
    added = stage(cleaned.select(*HOURLY.names), "added")
    tables.merge_history(
        store.spark, store.path("history"), HOURLY, added, "region_name", "time",
        lambda old, new: merge.append_deduplicated(old, new, ["region_name", "time"]))
    return added


def roll_days(store: Store, added: DataFrame) -> None:
    """Rebuild the daily rows of the dates the added rows touch."""
    days = added.select(F.col("time").cast("date").alias(tables.PARTITION)).distinct()
    touched = store.history().join(days, tables.PARTITION, "left_semi").drop(tables.PARTITION)
    daily = rollup.daily_rollup(touched, ["region_name"], "time", full_calendar=False)
    tables.write_history(daily, store.path("daily"), "region_name", "day")


def hourly_series(store: Store, measure: str = "temp") -> DataFrame:
    every = store.history().filter(F.col(measure).isNotNull())
    return stage(every.select(F.col("region_name").alias("unique_id"), F.col("time").alias("ds"),
                              F.col(measure).cast("double").alias("y")), "series")


def daily_series(series: DataFrame) -> DataFrame:
    return stage(rollup.daily_mean(series), "daily-series")


def forecast_all(series: DataFrame, h: int = 24, level: int = 80, models: Sequence[str] = MODELS, options: dict | None = None) -> DataFrame:
    """Forecasts of every model named: ``h`` hours ahead from the hourly series, a week ahead from its daily means.

    ``options`` by model name go to training."""
    step, options = STEP_SECONDS["H"], options or {}
    days = daily_series(series) if set(models) & set(WEEKLY) else None
    own = lambda name: options.get(name, {})
    made = {
        seasonal_naive.NAME: lambda: seasonal_naive.forecast(series, h, step).withColumns({
            c: F.lit(None).cast(k) for c, k in (("level", "int"), ("lo", "double"), ("hi", "double"))}),
        seasonal_ar.NAME: lambda: seasonal_ar.forecast(series, h, step, levels=(level,)),
        arima.NAME: lambda: arima.forecast(series, h, step, levels=(level,)),
        fourier_trend.NAME: lambda: fourier_trend.forecast(series, h, step, levels=(level,)),
        boosted.NAME: lambda: boosted.forecast(boosted.train(series, "H", **own(boosted.NAME)), series, h, step, "H"),
        weekly_sequence.NAME: lambda: weekly_sequence.forecast(days, WEEK, (level,)),
        recurrent.NAME: lambda: recurrent.forecast(days, WEEK, (level,), recurrent.train(days, **own(recurrent.NAME)), own(recurrent.NAME).get("hidden", recurrent.HIDDEN)),
    }
    columns = ["unique_id", "ds", "model", "yhat", "level", "lo", "hi"]
    out = None
    for name in models:
        part = made[name]().select(*columns)
        out = part if out is None else out.unionByName(part)
    return out


def evaluate_all(series: DataFrame, models: Sequence[str] = MODELS, plan: FoldPlan = FoldPlan(12, 12, 5), weekly_plan: FoldPlan = FoldPlan(WEEK, WEEK, 2),
                 options: dict | None = None) -> DataFrame:
    """Back-test metrics of every model named, each on its own resolution."""
    out = None
    for name in models:
        weekly = name in WEEKLY
        part = backtest.evaluate(daily_series(series) if weekly else series, [name], weekly_plan if weekly else plan,
                                 freq="D" if weekly else "H", options=(options or {}).get(name))
        out = part if out is None else out.unionByName(part)
    return out


def left_out_rows(series: DataFrame, forecasts: DataFrame, models: Sequence[str]) -> DataFrame:
    """Regions without a forecast, by model, with the reason: region_id, model_type, n_obs, n_known, reason."""
    out = None
    for name in models:
        part = left_out(series, forecasts.filter(F.col("model") == name)).select(
            F.col("unique_id").alias("region_id"), F.lit(name).alias("model_type"), "n_obs", "n_known", "reason")
        out = part if out is None else out.unionByName(part)
    return out


def refresh(store: Store, landed: DataFrame, now, h: int = 24, plan: FoldPlan = FoldPlan(12, 12, 5), models: Sequence[str] = MODELS,
            options: dict | None = None) -> None:
    """One run: ingest, roll up, forecast, evaluate, store, together with who got no forecast and why."""
    added = ingest(store, landed, now)
    roll_days(store, added)
    series = hourly_series(store)
    groups = ["region_id", "model_type"]
    made = stage(forecast_all(series, h, models=models, options=options), "forecasts")
    tables.replace_partitions(merge.forecast_rows(made), store.path("forecasts"), groups)
    # A report of the whole run: a region that has a forecast again must not stay in it.
    left_out_rows(series, made, models).write.mode("overwrite").parquet(store.path("left_out"))
    scores = merge.metric_rows(evaluate_all(series, list(models), plan, options=options))
    tables.replace_partitions(scores, store.path("metrics"), groups)


FILLED = ", ".join(
    f"coalesce(last_value({c} ignore nulls) over (w rows between unbounded preceding and current row),"
    f" first_value({c} ignore nulls) over (w rows between current row and unbounded following)) as {c}" for c in MEASURES)


@query("refresh_history", f"""select id as region_name, "time", {FILLED} from hourly window w as (partition by id order by "time")""", " ".join(MEASURES[:-1]))
def refresh_history(t: Tables):
    """History after three batches, the last of one hour: the same as after one."""
    landed = tables.columns_only(t.hourly().withColumnRenamed("id", "region_name"), HOURLY, {})
    landed = stage(landed, "landed")
    store = Store(t.spark, scratch_path(t.spark, "refresh"))
    last = F.lit(landed.agg(F.max("time")).first()[0]).cast("timestamp_ntz")
    for until in (last - F.expr("interval 12 days"), last - F.expr("interval 1 hour"), last):
        ingest(store, landed.filter(F.col("time") <= until), last)
    return store.history().select("region_name", "time", *MEASURES)

"""The season's last values repeated: the baseline of scaled errors, and checkable in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timeaxis import shift
from .folds import FULL, FoldPlan, numbered, tail_rows

NAME = "SeasonalNaive"


def predict(series: DataFrame, season: int, h: int, plan: FoldPlan = FULL) -> DataFrame:
    """Every tail row states its own forecasts, so nothing is joined."""
    rows = tail_rows(numbered(series), plan, season)
    first = (F.lit(season) - F.col("age")).cast("int")
    return rows.filter(first <= h).select(
        "unique_id", "fold", F.col("y").alias("yhat"),
        F.explode(F.sequence(first, F.lit(h), F.lit(season))).alias("horizon_step"))


def forecast(series: DataFrame, h: int, step: int, season: int = 24) -> DataFrame:
    ends = series.groupBy("unique_id").agg(F.max("ds").alias("last_ds"))
    return predict(series, season, h).join(ends, "unique_id").select(
        "unique_id", shift("last_ds", F.col("horizon_step") * step).alias("ds"),
        F.lit(NAME).alias("model"), "horizon_step", "yhat")

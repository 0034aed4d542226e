"""Gradient-boosted trees on lag, rolling and calendar features: one model for all series.

Training never puts a row's own value into its rolling windows. Forecasting is recursive: each step
predicts all series at once from an array of the last values, one row per series, and the plan is cut by
a reliable checkpoint every few steps.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import calendar_parts, cyclical_parts
from ..functions.timeaxis import shift
from ..operators.blocks import attach
from ..operators.features import feature_names, model_features
from ..operators.metrics import percent_bounds
from ..schema import LAGS, ROLLING
from ..session import cut_lineage, stage
from .folds import FULL, FoldPlan, numbered, tails

NAME = "BoostedTrees"
LEVELS = ["series_mean", "series_std"]
CUT_EVERY = 6


def inputs(freq: str) -> list[str]:
    return [*feature_names(freq), *LEVELS]


def _levels(series: DataFrame) -> DataFrame:
    """Mean and deviation of each series: what tells series apart, however many there are."""
    return series.groupBy("unique_id").agg(
        F.avg("y").alias("series_mean"), F.coalesce(F.stddev_pop("y"), F.lit(0.0)).alias("series_std"))


def train(series: DataFrame, freq: str = "H", trees: int = 100, depth: int = 6, rate: float = 0.1,
          sample: float = 0.8, seed: int = 42) -> PipelineModel:
    made = attach(model_features(series, freq, include_current=False), _levels(series), ["unique_id"], ["ds"])
    rows = stage(made.select(*inputs(freq), "y"), "features")
    assembler = VectorAssembler(inputCols=inputs(freq), outputCol="features")
    ready = assembler.transform(rows).select("features", "y")
    gbt = GBTRegressor(featuresCol="features", labelCol="y", predictionCol="yhat", maxIter=trees, maxDepth=depth,
                       stepSize=rate, subsamplingRate=sample, seed=seed)
    return PipelineModel([assembler, gbt.fit(ready)])


def _tail_features(freq: str) -> dict[str, Column]:
    """The features of the next row from ``tail``, the last values, newest first."""
    out = {f"lag_{k}": F.get("tail", F.lit(k - 1)) for k in LAGS[freq]}
    for w in ROLLING[freq]:
        part = F.filter(F.slice("tail", 1, w), lambda v: v.isNotNull())
        n = F.size(part)
        total = F.aggregate(part, F.lit(0.0), lambda a, v: a + v)
        mean = total / n
        squares = F.aggregate(part, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean))
        out[f"rolling_mean_{w}"] = mean
        out[f"rolling_std_{w}"] = F.sqrt(squares / F.nullif(n - 1, F.lit(0)))
        out[f"rolling_min_{w}"] = F.array_min(part)
        out[f"rolling_max_{w}"] = F.array_max(part)
    return out


def forecast(model: PipelineModel, series: DataFrame, h: int, step: int, freq: str = "H",
             bounds: float | None = 0.1) -> DataFrame:
    """Recursive forecast; series shorter than the longest lag are left out, as in training."""
    depth = max(LAGS[freq] + ROLLING[freq])
    ends = tails(numbered(series), FULL, depth).filter(F.size("tail") == depth)
    state = ends.select("unique_id", F.col("cutoff").alias("last_ds"), "tail", F.array().cast("array<double>").alias("path"))
    state = state.join(_levels(series), "unique_id")
    derived = _tail_features(freq) | calendar_parts("ds") | cyclical_parts("ds", freq != "D")
    advance = [
        "unique_id", *LEVELS, "last_ds", F.slice(F.concat(F.array("yhat"), "tail"), 1, depth).alias("tail"),
        F.concat("path", F.array("yhat")).alias("path"),
    ]
    for s in range(1, h + 1):
        rows = state.withColumn("ds", shift("last_ds", s * step)).withColumns(derived)
        state = model.transform(rows).select(*advance)
        if s % CUT_EVERY == 0 and s < h:
            state = cut_lineage(state)
    out = state.select("unique_id", "last_ds", F.posexplode("path").alias("i", "yhat")).select(
        "unique_id", shift("last_ds", (F.col("i") + 1) * step).alias("ds"), F.lit(NAME).alias("model"),
        (F.col("i") + 1).alias("horizon_step"), "yhat")
    return out if bounds is None else percent_bounds(out, bounds)


def predict_folds(series: DataFrame, plan: FoldPlan, step: int, freq: str = "H", **options) -> DataFrame:
    """Forecasts of every fold by a model of its own, trained on the rows before the cut: unique_id, fold, horizon_step, yhat.

    ``options`` go to ``train``. Trees are not sums of rows, so each fold is a fit of its own; the folds are few.
    """
    rows = stage(numbered(series.filter(F.col("y").isNotNull())), "fold-rows")
    out = None
    for fold in range(plan.n_windows):
        before = rows.filter(F.col("pos") < plan.cut(F.lit(fold))).select("unique_id", "ds", "y")
        path = forecast(train(before, freq, **options), before, plan.h, step, freq, None)
        path = path.select("unique_id", F.lit(fold).alias("fold"), "horizon_step", "yhat")
        out = path if out is None else out.unionByName(path)
    return out


def feature_importance(model: PipelineModel, series: DataFrame, freq: str = "H") -> DataFrame:
    """Share of each feature in the trees' gains, largest first (one row per feature)."""
    shares = model.stages[-1].featureImportances
    rows = [(name, float(shares[i])) for i, name in enumerate(inputs(freq))]
    return series.sparkSession.createDataFrame(rows, "feature string, importance double").orderBy(
        F.desc("importance"), "feature")

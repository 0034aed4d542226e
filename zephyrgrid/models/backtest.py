"""Rolling-origin back-tests: all folds and series of a model in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.metrics import METRICS, metrics_wide, to_metric_rows
from ..schema import STEP_SECONDS
from . import arima, boosted, fourier_trend, recurrent, seasonal_ar, seasonal_naive, weekly_sequence
from .folds import FoldPlan, numbered, test_rows

DEFAULT = FoldPlan(h=12, step_size=12, n_windows=5)


def predictions(series: DataFrame, model: str, plan: FoldPlan = DEFAULT, season: int = 24, freq: str = "H",
                options: dict | None = None) -> DataFrame:
    """Test rows of every fold beside the model's forecast: unique_id, fold, ds, horizon_step, y, yhat.

    Rows without a target are left out. ``options`` go to the training of boosted trees and of the recurrent network.
    """
    series = series.filter(F.col("y").isNotNull())
    if model == fourier_trend.NAME:
        paired = fourier_trend.predict_folds(series, fourier_trend.fit(series, freq, plan), plan, freq)
    else:
        if model == seasonal_naive.NAME:
            path = seasonal_naive.predict(series, season, plan.h, plan)
        elif model == seasonal_ar.NAME:
            path = seasonal_ar.predict(seasonal_ar.fit(series, season, plan), series, season, plan.h, plan)
        elif model == arima.NAME:
            path = arima.predict_folds(series, plan, season)
        elif model == recurrent.NAME:
            path = recurrent.predict_folds(series, plan, **(options or {}))
        elif model == weekly_sequence.NAME:
            scaled = weekly_sequence.scale(series)
            path = weekly_sequence.predict(weekly_sequence.fit(scaled, plan), scaled, plan.h, plan)
        elif model == boosted.NAME:
            path = boosted.predict_folds(series, plan, STEP_SECONDS[freq], freq, **(options or {}))
        else:
            raise ValueError(f"unknown model {model}")
        tests = test_rows(numbered(series), plan)
        paired = tests.join(path.select("unique_id", "fold", "horizon_step", "yhat"),
                            ["unique_id", "fold", "horizon_step"])
    return paired.select("unique_id", "fold", "ds", "horizon_step", "y", "yhat").withColumn("model", F.lit(model))


def evaluate(series: DataFrame, models: list[str], plan: FoldPlan = DEFAULT, season: int = 24, freq: str = "H",
             by: tuple[str, ...] = ("unique_id", "model"), metrics: list[str] = METRICS, options: dict | None = None) -> DataFrame:
    """Metric rows per series and model over all folds; add ``horizon_step`` to ``by`` for each step."""
    frames = [predictions(series, m, plan, season, freq, options) for m in models]
    every = frames[0]
    for frame in frames[1:]:
        every = every.unionByName(frame)
    return to_metric_rows(metrics_wide(every, by), by, metrics)

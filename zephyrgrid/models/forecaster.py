"""One surface over the models: fit, forecast, evaluate, results and summary for all series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timeaxis import bucket
from ..operators.clean import require_columns
from ..operators.grid import detect_frequency
from ..schema import CLAMPED_HORIZON, DEFAULT_HORIZON, SEASON, STEP_SECONDS
from ..session import stage
from . import arima, backtest, boosted, fourier_trend, recurrent, seasonal_ar, seasonal_naive, weekly_sequence
from .folds import FoldPlan

HORIZONS = {"15min": 96, "H": 24, "D": 7}


class Forecaster:
    """A model bound to a frame of series of one frequency (``15min``, ``H`` or ``D``)."""

    def __init__(self, model: str = seasonal_ar.NAME, freq: str = "H", season: int | None = None, **options):
        self.model, self.freq = model, freq
        self.season = season or SEASON[freq]
        self.options, self.series, self.params, self.result = options, None, None, None
        self.coarser: dict[str, Forecaster] = {}

    def fit(self, series: DataFrame) -> Forecaster:
        self.series, self.coarser = require_columns(series), {}
        if self.model == seasonal_ar.NAME:
            self.params = seasonal_ar.fit(series, self.season, **self.options)
        elif self.model == arima.NAME:
            self.params = arima.fit(series, self.season, **self.options)
        elif self.model == fourier_trend.NAME:
            self.params = fourier_trend.fit(series, self.freq)
        elif self.model == boosted.NAME:
            self.params = boosted.train(series, self.freq, **self.options)
        elif self.model == recurrent.NAME:
            self.params = recurrent.train(series, **self.options)
        elif self.model == weekly_sequence.NAME:
            self.params = weekly_sequence.fit(weekly_sequence.scale(series))
        elif self.model != seasonal_naive.NAME:
            raise ValueError(f"unknown model {self.model}")
        return self

    def horizon(self, h: int | None, clamp: bool) -> int:
        weekly = self.model in (weekly_sequence.NAME, recurrent.NAME)
        wanted = h or (7 if weekly else DEFAULT_HORIZON)
        if clamp and not weekly:
            return CLAMPED_HORIZON.get(self.freq, wanted)
        return wanted

    def forecast(self, h: int | None = None, levels: Sequence[int] = (80,), clamp: bool = False) -> DataFrame:
        if self.series is None:
            raise ValueError("call fit first")
        h, step = self.horizon(h, clamp), STEP_SECONDS[self.freq]
        if self.model == seasonal_ar.NAME:
            self.result = seasonal_ar.forecast(self.series, h, step, self.season, levels, params=self.params)
        elif self.model == arima.NAME:
            self.result = arima.forecast(self.series, h, step, self.season, levels, params=self.params)
        elif self.model == fourier_trend.NAME:
            self.result = fourier_trend.forecast(self.series, h, step, self.freq, levels, params=self.params)
        elif self.model == boosted.NAME:
            self.result = boosted.forecast(self.params, self.series, h, step, self.freq)
        elif self.model == recurrent.NAME:
            self.result = recurrent.forecast(self.series, h, levels, self.params, self.options.get("hidden", recurrent.HIDDEN))
        elif self.model == weekly_sequence.NAME:
            self.result = weekly_sequence.forecast(self.series, h, levels, self.params)
        else:
            self.result = seasonal_naive.forecast(self.series, h, step, self.season)
        return self.result

    def forecast_at(self, resolution: str) -> DataFrame:
        """The standard horizon of a resolution: 96 quarter hours, 24 hours or 7 days.

        Finer data is rolled up to means first, a model of the same kind is fitted to those and kept (``result`` stays
        the one of the model's own resolution); coarser data is refused.
        """
        if self.series is None:
            raise ValueError("call fit first")
        if STEP_SECONDS[self.freq] > STEP_SECONDS[resolution]:
            raise ValueError(f"data at {self.freq} cannot give {resolution} forecasts")
        if self.freq == resolution:
            return self.forecast(HORIZONS[resolution])
        if resolution not in self.coarser:
            self.coarser[resolution] = Forecaster(self.model, resolution, **self.options).fit(roll_up(self.series, resolution))
        return self.coarser[resolution].forecast(HORIZONS[resolution])

    def evaluate(self, h: int = 12, step_size: int = 12, n_windows: int = 5, by=("unique_id", "model")) -> DataFrame:
        if self.series is None:
            raise ValueError("call fit first")
        options = self.options if self.model in (boosted.NAME, recurrent.NAME) else None
        return backtest.evaluate(self.series, [self.model], FoldPlan(h, step_size, n_windows), self.season, self.freq, by, options=options)

    def results(self) -> dict[str, DataFrame]:
        out = {"series": self.series, "summary": self.summary()}
        if self.result is not None:
            out["forecast"] = self.result
        if isinstance(self.params, DataFrame):
            out["params"] = self.params
        return out

    def left_out(self) -> DataFrame:
        if self.result is None:
            raise ValueError("call forecast first")
        return left_out(self.series, self.result)

    def summary(self) -> DataFrame:
        return model_summary(self.series, self.result).withColumn("model", F.lit(self.model))


def roll_up(series: DataFrame, resolution: str) -> DataFrame:
    """Means of the known values of each quarter hour, hour or day, staged; buckets without one are left out."""
    means = series.groupBy("unique_id", bucket("ds", STEP_SECONDS[resolution]).alias("ds")).agg(F.avg("y").alias("y"))
    return stage(means.filter(F.col("y").isNotNull()), "rolled-series")


def left_out(series: DataFrame, forecast: DataFrame) -> DataFrame:
    """Series without a forecast, with their rows: they are shorter than the model's longest lag or have no target."""
    counts = series.groupBy("unique_id").agg(F.count(F.lit(1)).alias("n_obs"), F.count("y").alias("n_known"))
    made = forecast.filter(F.col("yhat").isNotNull()).select("unique_id").distinct()
    reason = F.when(F.col("n_known") == 0, "no target").otherwise("too short")
    return counts.join(made, "unique_id", "left_anti").withColumn("reason", reason)


def model_summary(series: DataFrame, forecast: DataFrame | None = None) -> DataFrame:
    """One row per series: extent, frequency, season and how many periods were forecast."""
    counts = series.groupBy("unique_id").agg(
        F.count(F.lit(1)).alias("n_obs"), F.min("ds").alias("first_ds"), F.max("ds").alias("last_ds"))
    out = counts.join(detect_frequency(series).select("unique_id", "freq", "season"), "unique_id", "left")
    if forecast is None:
        return out.withColumn("n_forecast", F.lit(0).cast("bigint"))
    periods = forecast.select("unique_id", "ds").distinct().groupBy("unique_id").agg(
        F.count(F.lit(1)).alias("n_forecast"))
    return out.join(periods, "unique_id", "left").na.fill(0, ["n_forecast"])

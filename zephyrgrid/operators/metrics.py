"""Forecast metrics, residuals, comparison and ensembles.

Input frames are long: ``unique_id, ds, model, y, yhat`` (and ``horizon_step`` or ``fold`` where named).
"""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timeaxis import epoch
from .blocks import attach, exact_quantiles, previous_row, row_blocks, with_position

METRICS = ["mae", "mape", "mse", "rmse", "smape", "r2"]


def _error() -> Column:
    return F.col("yhat") - F.col("y")


def metric_columns() -> dict[str, Column]:
    """MAPE skips zero actuals; SMAPE is 200 |p - a| / (|p| + |a| + 1e-8); R2 of constant actuals is NULL."""
    e = _error()
    share = F.when(F.col("y") != 0, F.abs(e / F.col("y")))
    return {
        "mae": F.avg(F.abs(e)),
        "mape": F.avg(share) * 100,
        "mse": F.avg(e * e),
        "rmse": F.sqrt(F.avg(e * e)),
        "smape": F.avg(F.lit(200.0) * F.abs(e) / (F.abs("yhat") + F.abs("y") + 1e-8)),
        "r2": F.lit(1.0) - F.sum(e * e) / F.nullif(F.var_pop("y") * F.count("y"), F.lit(0.0)),
    }


def metrics_wide(paired: DataFrame, by: Sequence[str] = ("unique_id", "model")) -> DataFrame:
    known = paired.filter(F.col("y").isNotNull() & F.col("yhat").isNotNull())
    return known.groupBy(*by).agg(*[c.alias(n) for n, c in metric_columns().items()])


def to_metric_rows(wide: DataFrame, by: Sequence[str], names: Sequence[str]) -> DataFrame:
    return wide.unpivot(list(by), list(names), "metric", "value")


def forecast_metrics(paired: DataFrame, by: Sequence[str] = ("unique_id", "model")) -> DataFrame:
    return to_metric_rows(metrics_wide(paired, by), by, METRICS)


def naive_scale(train: DataFrame, season: int = 1) -> DataFrame:
    """Mean absolute error of repeating the value ``season`` rows earlier."""
    numbered = with_position(train, ["unique_id"], ["ds"], "pos")
    stepped = row_blocks(
        numbered, ["unique_id"], lambda w: {"_d": F.abs(F.col("y") - F.lag("y", season).over(w))}, season)
    return stepped.groupBy("unique_id").agg(F.avg("_d").alias("scale"))


def mase(paired: DataFrame, train: DataFrame, season: int = 1) -> DataFrame:
    errors = paired.groupBy("unique_id", "model").agg(F.avg(F.abs(_error())).alias("mae"))
    return errors.join(naive_scale(train, season), "unique_id").select(
        "unique_id", "model", "mae", "scale",
        F.when(F.col("scale") > 0, F.col("mae") / F.col("scale")).alias("mase"))


def directional_accuracy(paired: DataFrame) -> DataFrame:
    """Share of steps whose forecast moves the way the actual moved."""
    keys = ["unique_id", "model"]
    stepped = previous_row(paired.select(*keys, "ds", "y", "yhat"), keys, "ds", ["y", "yhat"])
    same = F.signum(F.col("y") - F.col("prev_y")) == F.signum(F.col("yhat") - F.col("prev_yhat"))
    return stepped.filter(F.col("prev_y").isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_steps"), F.avg(same.cast("double")).alias("mda"))


def residuals(paired: DataFrame) -> DataFrame:
    r = F.col("y") - F.col("yhat")
    return paired.withColumns({
        "residual": r, "abs_residual": F.abs(r),
        "pct_residual": F.when(F.col("y") != 0, r / F.col("y") * 100),
    })


def histogram(df: DataFrame, keys: Sequence[str], value: str, bins: int = 20) -> DataFrame:
    """Equal-width counts between each key's extremes; bins are numbered from 0."""
    ends = df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    at = F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("_lo")) / F.nullif(width, F.lit(0.0))))
    return (
        attach(df.filter(F.col(value).isNotNull()), ends, keys, [value])
        .groupBy(*keys, F.coalesce(at, F.lit(0)).cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("_lo").alias("lo"), F.min(width).alias("width"))
        .select(*keys, "bin", "n", (F.col("lo") + F.col("bin") * F.col("width")).alias("bin_start"))
    )


def quantile_table(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Sample quantiles for a Q-Q comparison."""
    return exact_quantiles(df, keys, value, probs)


def qq_table(df: DataFrame, keys: Sequence[str], value: str, points: int = 21) -> DataFrame:
    """Sample quantiles beside normal ones, a row per point: keys, point, prob, z, sample, normal.

    Points lie at (i - 0.5) / ``points``; ``normal`` has the sample's mean and deviation (null for one row only).
    """
    probs = {i: (i - 0.5) / points for i in range(1, points + 1)}
    sample = exact_quantiles(df, keys, value, {f"_q{i}": p for i, p in probs.items()})
    moments = df.groupBy(*keys).agg(F.avg(value).alias("_mean"), F.stddev_samp(value).alias("_std"))
    stacked = F.explode(F.array(*[
        F.struct(F.lit(i).alias("point"), F.lit(p).alias("prob"), F.lit(NormalDist().inv_cdf(p)).alias("z"),
                 F.col(f"_q{i}").alias("sample")) for i, p in probs.items()
    ]))
    rows = sample.join(moments, list(keys)).select(*keys, "_mean", "_std", stacked.alias("_p")).select(*keys, "_mean", "_std", "_p.*")
    return rows.select(*keys, "point", "prob", "z", "sample", (F.col("_mean") + F.col("_std") * F.col("z")).alias("normal"))


def error_bounds(forecast: DataFrame, fitted: DataFrame, levels: Sequence[int] = (80, 95)) -> DataFrame:
    """Bounds from past errors: the forecast plus the error percentiles (100 - L) / 2 and its mirror.

    Errors are those of the series and, where both sides name one, of the model.
    """
    keys = [c for c in ("unique_id", "model") if c in forecast.columns and c in fitted.columns]
    probs = {}
    for level in levels:
        probs[f"lo_{level}"], probs[f"hi_{level}"] = (100 - level) / 200, (100 + level) / 200
    errors = fitted.select(*keys, (F.col("y") - F.col("yhat")).alias("e"))
    bounds = exact_quantiles(errors, keys, "e", probs)
    wide = attach(forecast, bounds, keys, ["ds"])
    stacked = F.explode(F.array(*[
        F.struct(F.lit(level).alias("level"), (F.col("yhat") + F.col(f"lo_{level}")).alias("lo"),
                 (F.col("yhat") + F.col(f"hi_{level}")).alias("hi")) for level in levels
    ]))
    return wide.withColumn("_b", stacked).select(*forecast.columns, "_b.*")


def percent_bounds(forecast: DataFrame, share: float = 0.1) -> DataFrame:
    """Bounds ``share`` of the forecast's size away, in order for negative forecasts too."""
    margin = F.abs("yhat") * share
    return forecast.withColumns({"lo": F.col("yhat") - margin, "hi": F.col("yhat") + margin, "level": F.lit(80)})


def compare_models(metrics: DataFrame, models: Sequence[str]) -> DataFrame:
    """One column per model; the list is given, so no extra job looks for it."""
    return metrics.groupBy("unique_id", "metric").pivot("model", list(models)).agg(F.first("value"))


def ensemble(forecasts: DataFrame, errors: DataFrame, by: Sequence[str] = ("unique_id",)) -> DataFrame:
    """Average of the models weighted by 1 / past RMSE; add ``horizon_step`` to ``by`` for weights per step.

    ``forecasts``: unique_id, ds, model, yhat (+ by); ``errors``: unique_id, model, rmse (+ by).
    """
    weight = errors.withColumn("w", F.lit(1.0) / (F.col("rmse") + 1e-9)).select(*by, "model", "w")
    joined = attach(forecasts, weight, [*by, "model"], ["ds"], "inner")
    keys = list(dict.fromkeys(["unique_id", "ds", *by]))
    return joined.groupBy(*keys).agg(
        (F.sum(F.col("w") * F.col("yhat")) / F.sum("w")).alias("yhat"), F.count(F.lit(1)).alias("n_models"))


def recent_rmse(paired: DataFrame, half_life_hours: float, by: Sequence[str] = ("unique_id",)) -> DataFrame:
    """RMSE with errors fading by half every ``half_life_hours`` before the series' last row."""
    ends = paired.groupBy("unique_id").agg(F.max("ds").alias("_end"))
    aged = attach(paired, ends, ["unique_id"], ["ds", "model"])
    fade = F.pow(F.lit(0.5), (epoch("_end") - epoch("ds")) / F.lit(half_life_hours * 3600.0))
    keys = list(dict.fromkeys([*by, "model"]))
    return aged.groupBy(*keys).agg(F.sqrt(F.sum(fade * _error() * _error()) / F.sum(fade)).alias("rmse"))


def pair(actual: DataFrame, forecast: DataFrame, how: str = "inner") -> DataFrame:
    """Actuals beside forecasts on (unique_id, ds)."""
    return actual.join(forecast, ["unique_id", "ds"], how)

"""Cleaning: filling, imputing, scaling, validating and reshaping observations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.weather import celsius_to_fahrenheit, kmh_to_mph
from ..schema import MEASURES, SNOW_FREE_PREFIXES
from .blocks import attach, known_around, previous_row


def present(df: DataFrame, columns: Sequence[str] = MEASURES) -> list[str]:
    return [c for c in columns if c in df.columns]


def drop_all_null(df: DataFrame, measures: Sequence[str] | None = None) -> DataFrame:
    return df.na.drop("all", subset=list(measures or present(df)))


def drop_any_null(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.na.drop("any", subset=list(columns or df.columns))


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN means missing in landed files."""
    doubles = [c for c, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in doubles})


def min_rows(df: DataFrame, keys: Sequence[str], at_least: int = 2) -> DataFrame:
    """Keep only series with at least ``at_least`` rows."""
    short = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") < at_least)
    return df.join(short.select(*keys), list(keys), "left_anti")


def fill(
    df: DataFrame, keys: Sequence[str], time: str, columns: Sequence[str],
    forward: bool = True, backward: bool = False,
) -> DataFrame:
    """Forward fill, then backward fill what is still missing, within each series."""
    around = known_around(df, keys, time, columns, "at" if forward else None, "at" if backward else None)
    sides = [s for s, on in (("prev", forward), ("next", backward)) if on]
    return around.select(*[
        F.coalesce(*[F.col(f"{c}_{s}") for s in sides]).alias(c) if c in columns else F.col(c)
        for c in df.columns
    ])


def clean_hourly(df: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """Drop empty rows, fill gaps both ways and drop series too short to use."""
    measures = present(df)
    full = fill(drop_all_null(df, measures), keys, time, measures, True, True)
    return min_rows(full, keys, 2)


def impute_snow(df: DataFrame, zone: str, time: str) -> DataFrame:
    """Missing snow is none in southern zones; elsewhere May to September is always none."""
    southern = F.lit(False)
    for prefix in SNOW_FREE_PREFIXES:
        southern = southern | F.col(zone).startswith(prefix)
    summer = F.month(time).between(5, 9)
    return df.withColumn(
        "snow",
        F.when(southern, F.coalesce("snow", F.lit(0.0))).when(summer, 0.0).otherwise(F.col("snow")),
    )


def impute_gust(df: DataFrame) -> DataFrame:
    return df.withColumn("wpgt", F.coalesce("wpgt", F.col("wspd") * 1.5))


def impute_sun(df: DataFrame, time: str) -> DataFrame:
    """No sun before 6 and after 18; missing daytime sun is estimated as (1 - coco / 100) * 60.

    ``coco`` is a condition code and no percentage; the formula is kept because results depend on it.
    """
    night = (F.hour(time) < 6) | (F.hour(time) > 18)
    return df.withColumn(
        "tsun",
        F.when(night, 0.0).otherwise(F.coalesce(F.col("tsun"), (F.lit(1) - F.col("coco") / 100) * 60)),
    )


def add_units(df: DataFrame) -> DataFrame:
    return df.withColumns({"temp_f": celsius_to_fahrenheit("temp"), "wspd_mph": kmh_to_mph("wspd")})


def _scaled(df: DataFrame, keys, spread_by, stats: list, scaled: dict) -> DataFrame:
    per_key = df.groupBy(*keys).agg(*stats)
    return attach(df, per_key, keys, spread_by).withColumns(scaled).select(*df.columns, *scaled)


def zscore(df: DataFrame, keys: Sequence[str], columns: Sequence[str], spread_by: Sequence[str]) -> DataFrame:
    """(x - mean) / sample standard deviation per series, as ``<c>_z``."""
    stats = [s for c in columns for s in (F.avg(c).alias(f"_m_{c}"), F.stddev_samp(c).alias(f"_s_{c}"))]
    scaled = {f"{c}_z": (F.col(c) - F.col(f"_m_{c}")) / F.nullif(F.col(f"_s_{c}"), F.lit(0.0)) for c in columns}
    return _scaled(df, keys, spread_by, stats, scaled)


def standard_scale(df: DataFrame, keys: Sequence[str], columns: Sequence[str], spread_by: Sequence[str]) -> DataFrame:
    """(x - mean) / population standard deviation; a constant column scales to 0."""
    stats = [s for c in columns for s in (F.avg(c).alias(f"_m_{c}"), F.stddev_pop(c).alias(f"_s_{c}"))]
    scaled = {
        f"{c}_std": (F.col(c) - F.col(f"_m_{c}"))
        / F.when(F.col(f"_s_{c}") == 0, 1.0).otherwise(F.col(f"_s_{c}"))
        for c in columns
    }
    return _scaled(df, keys, spread_by, stats, scaled)


def minmax_scale(df: DataFrame, keys: Sequence[str], column: str, spread_by: Sequence[str]) -> DataFrame:
    """Scale to [0, 1] as ``scaled``; ``lo`` and ``span`` are kept so that it can be undone."""
    stats = [F.min(column).alias("lo"), (F.max(column) - F.min(column)).alias("span")]
    per_key = df.groupBy(*keys).agg(*stats).withColumn(
        "span", F.when(F.col("span") == 0, 1.0).otherwise(F.col("span")))
    return attach(df, per_key, keys, spread_by).withColumn(
        "scaled", (F.col(column) - F.col("lo")) / F.col("span"))


def minmax_restore(df: DataFrame, scaled: str, out: str) -> DataFrame:
    return df.withColumn(out, F.col(scaled) * F.col("span") + F.col("lo"))


def log_transform(df: DataFrame, column: str, out: str = "log_y") -> DataFrame:
    return df.withColumn(out, F.when(F.col(column) > 0, F.ln(column)))


def local_time(df: DataFrame, time: str, zone_tz: str, out: str = "local_time") -> DataFrame:
    """Wall clock of a UTC time in the zone named by the column ``zone_tz``."""
    return df.withColumn(out, F.convert_timezone(F.lit("UTC"), F.col(zone_tz), F.col(time)))


def require_columns(df: DataFrame, columns: Sequence[str] = ("unique_id", "ds", "y")) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def validate_series(df: DataFrame) -> DataFrame:
    """Violation counts per series: missing, not finite and repeated times."""
    require_columns(df)
    infinite = F.isnan("y") | (F.abs("y") == float("inf"))
    stepped = previous_row(df.select("unique_id", "ds", "y"), ["unique_id"], "ds", ["ds"])
    return stepped.groupBy("unique_id").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("y").isNull()).alias("n_null"),
        F.count_if(infinite).alias("n_not_finite"),
        F.count_if(F.col("ds") == F.col("prev_ds")).alias("n_duplicate_ds"),
    )


def to_long(df: DataFrame, zone: str, time: str, measures: Sequence[str]) -> DataFrame:
    """Wide measures to one series per (zone, measure), without missing values."""
    return (
        df.select(zone, time, *[F.col(m).cast("double").alias(m) for m in measures])
        .unpivot([zone, time], list(measures), "measure", "y")
        .filter(F.col("y").isNotNull())
        .select(
            F.concat_ws("/", zone, "measure").alias("unique_id"),
            F.col(time).alias("ds"), "y",
        )
    )

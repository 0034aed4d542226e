"""Readers of landed files: observations, API envelopes, zones, energy series, tariffs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.clean import nan_to_null
from ..operators.spatial import near
from ..schema import GEO_FEATURE, HOURLY, ZONES


def normalise_time(df: DataFrame) -> DataFrame:
    """``date`` or ``ds`` instead of ``time``; text becomes a zone-less timestamp."""
    for name in ("date", "ds", "timestamp"):
        if name in df.columns and "time" not in df.columns:
            df = df.withColumnRenamed(name, "time")
    return df.withColumn("time", F.col("time").cast("timestamp_ntz"))


def read_hourly(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType = HOURLY,
                start=None, end=None) -> DataFrame:
    """Landed hourly observations with an explicit schema; NaN is NULL."""
    reader = spark.read.schema(schema)
    raw = reader.option("header", True).csv(path) if fmt == "csv" else reader.format(fmt).load(path)
    return in_range(nan_to_null(normalise_time(raw)), "time", start, end)


def in_range(df: DataFrame, time: str, start=None, end=None) -> DataFrame:
    """Inclusive on both sides; either side may be open."""
    if start is not None:
        df = df.filter(F.col(time) >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        df = df.filter(F.col(time) <= F.lit(end).cast("timestamp_ntz"))
    return df


def select_range(df: DataFrame, key: str, time: str, zones: Sequence[str] | None = None,
                 start=None, end=None) -> DataFrame:
    """Rows of the given zones (all by default) in a time range, ordered by zone and time."""
    if zones is not None:
        df = df.filter(F.col(key).isin(*zones))
    return in_range(df, time, start, end).orderBy(key, time)


def zone_catalogue(spark: SparkSession) -> DataFrame:
    schema = T.StructType([
        T.StructField("zone", T.StringType(), False), T.StructField("lat", T.DoubleType()),
        T.StructField("lon", T.DoubleType()), T.StructField("alt", T.DoubleType()),
        T.StructField("tz", T.StringType()),
    ])
    return spark.createDataFrame([(zone, *rest) for zone, rest in ZONES.items()], schema)


def parse_envelope(df: DataFrame, payload: str, row_schema: str) -> DataFrame:
    """Rows of ``response.data[]``; a missing or broken envelope gives no rows."""
    parsed = F.from_json(payload, f"response struct<data: array<{row_schema}>>")
    return df.withColumn("_row", F.explode(parsed["response"]["data"])).select(
        *[c for c in df.columns if c != payload], "_row.*")


def read_envelopes(spark: SparkSession, path: str, row_schema: str) -> DataFrame:
    """Landed API answers, one JSON document per line."""
    return parse_envelope(spark.read.text(path), "value", row_schema)


def parse_features(lines: DataFrame, payload: str = "value") -> DataFrame:
    """GeoJSON features, one per line."""
    f = F.from_json(payload, GEO_FEATURE)
    return lines.select(
        *[c for c in lines.columns if c != payload],
        f["properties"]["zoneName"].alias("zone"), f["properties"]["countryName"].alias("country"),
        f["geometry"]["type"].alias("geometry_type"), f["geometry"]["coordinates"].alias("coordinates"))


def read_feature_collection(spark: SparkSession, path: str) -> DataFrame:
    """A whole GeoJSON file: its ``features`` array, one row each."""
    schema = T.StructType([T.StructField("features", T.ArrayType(GEO_FEATURE))])
    f = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    return f.select(
        F.col("f.properties.zoneName").alias("zone"), F.col("f.properties.countryName").alias("country"),
        F.col("f.geometry.type").alias("geometry_type"), F.col("f.geometry.coordinates").alias("coordinates"))


def zone_centroids(features: DataFrame, country: str = "United States") -> DataFrame:
    """Plain mean of all ring vertices (holes and closing vertices count); MultiPolygon only."""
    points = features.filter((F.col("country") == country) & (F.col("geometry_type") == "MultiPolygon")).select(
        "zone", F.explode(F.flatten(F.flatten("coordinates"))).alias("p"))
    return points.groupBy("zone").agg(
        F.avg(F.col("p")[1]).alias("lat"), F.avg(F.col("p")[0]).alias("lon"), F.count(F.lit(1)).alias("n_points"))


def with_fallback(primary: DataFrame, fallback: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of the first source and, for keys it lacks, of the second; ``source`` tells which."""
    missing = fallback.join(primary.select(*keys).distinct(), list(keys), "left_anti")
    return primary.withColumn("source", F.lit("primary")).unionByName(
        missing.withColumn("source", F.lit("fallback")), allowMissingColumns=True)


def tariffs(rates: DataFrame, state: str | None = None, utility: str | None = None) -> DataFrame:
    if state is not None:
        rates = rates.filter(F.col("state") == state)
    if utility is not None:
        rates = rates.filter(F.col("utility") == utility)
    return rates


def tariffs_near(points: DataFrame, rates: DataFrame, km: float, point_id: str, tariff_id: str) -> DataFrame:
    """Tariffs whose service point lies within ``km`` of a point, with their distance and the rank of it."""
    found = near(points, rates, km, point_id, tariff_id)
    nearest = F.row_number().over(Window.partitionBy(point_id).orderBy("km", tariff_id))
    return found.withColumn("rank", nearest).join(rates.drop("lat", "lon"), tariff_id)


def hashed_normal(seed: int, *keys: Column) -> Column:
    """Standard normal noise that depends on the seed and the keys alone, not on how rows are dealt or in which engine."""
    text = F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys])
    uniform = lambda at: (F.conv(F.substring(F.md5(text), at, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.sqrt(-2 * F.ln(uniform(1))) * F.cos(F.lit(2 * 3.141592653589793) * uniform(9))


def synthetic_series(spine: DataFrame, sigma: float = 5.0, seed: int = 42) -> DataFrame:
    """Test series on a 15-minute spine: 20 + noise + daily and weekly sine waves.

    ``spine``: unique_id, ds. The wave phase counts quarter hours since the epoch's Monday.
    """
    step = F.floor(F.unix_seconds(F.col("ds").cast("timestamp")) / 900)
    daily = F.sin(F.lit(2 * 3.141592653589793) * (step % 96) / 96) * 10
    weekly = F.sin(F.lit(2 * 3.141592653589793) * (step % 672) / 672) * 5
    noise = hashed_normal(seed, F.col("unique_id"), step) * sigma if sigma else F.lit(0.0)
    return spine.withColumn("y", F.lit(20.0) + noise + daily + weekly)

"""Joins by position: what lies near a point, and which zone holds it.

Positions are degrees. Every join is an equi-join on grid cells or bands that is confirmed by exact geometry afterwards, so
work follows the density of the data, not the product of both sides. The side with more rows per cell is salted where it is hot.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage

# Fixed value: mean radius of the earth.
EARTH_KM = 6371.0088
KM_PER_DEGREE = EARTH_KM * 3.141592653589793 / 180
# Rows of one cell that one task takes.
HOT = 20_000


def distance_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance (haversine)."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def _cell(value: Column, degrees: float) -> Column:
    return F.floor(value / F.lit(degrees)).cast("long")


def _spread(rows: DataFrame, cells: DataFrame, on: Sequence[str], by: Sequence[str], hot: int) -> DataFrame:
    """``rows``, which are read twice, joined to those of ``cells`` with the same cell.

    A cell of more than ``hot`` rows is spread over a salt for each ``hot`` of them; only what ``cells`` has there is copied.
    The join is never a broadcast: the planner takes the size of ``cells`` from the files that they were unfolded from.
    """
    heat = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot).select(*on, F.ceil(F.col("_n") / hot).cast("int").alias("_salts"))
    salts = F.coalesce("_salts", F.lit(1))
    salted = rows.join(heat, on, "left").withColumn("_salt", F.pmod(F.xxhash64(*by), salts).cast("int")).drop("_salts")
    copies = cells.join(heat, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return salted.join(copies.hint("merge"), [*on, "_salt"]).drop("_salt")


def near(points: DataFrame, places: DataFrame, km: float, point_id: str, place_id: str, lat: str = "lat", lon: str = "lon",
         degrees: float | None = None, hot: int = HOT) -> DataFrame:
    """Every place within ``km`` of a point: point_id, place_id, km.

    A place lies in one cell; a point asks the cells its circle can touch (across the date line as well, and all
    longitudes where the circle holds a pole). Rows without a position find nothing. ``places`` is the larger side.
    """
    # A whole number of cells goes around the earth, so that cells fit together where it closes.
    turn = max(1, int(360 // (degrees or max(km / KM_PER_DEGREE, 0.01))))
    degrees, reach = 360 / turn, km / KM_PER_DEGREE
    # Where the circle meets a pole it spans all longitudes; elsewhere a longitude step shrinks with the cosine.
    ratio = F.sin(F.radians(F.lit(min(reach, 90.0)))) / F.cos(F.radians(F.col(lat)))
    wide = F.when((F.abs(lat) + reach >= 90) | (ratio >= 1), F.lit(180.0)).otherwise(F.degrees(F.asin(ratio)) + 1e-9)
    ys = F.sequence(_cell(F.greatest(F.col(lat) - reach, F.lit(-90.0)), degrees), _cell(F.least(F.col(lat) + reach, F.lit(90.0)), degrees))
    xs = F.array_distinct(F.transform(F.sequence(_cell(F.col(lon) - wide + 180, degrees), _cell(F.col(lon) + wide + 180, degrees)),
                                      lambda x: F.pmod(x, F.lit(turn).cast("long"))))
    asked = points.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).select(
        F.col(point_id).alias("_point"), F.col(lat).alias("_lat"), F.col(lon).alias("_lon"), F.explode(ys).alias("_y"), xs.alias("_xs"))
    asked = asked.select("_point", "_lat", "_lon", "_y", F.explode("_xs").alias("_x"))
    held = places.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).select(
        F.col(place_id).alias("_place"), F.col(lat).alias("_plat"), F.col(lon).alias("_plon"), _cell(F.col(lat), degrees).alias("_y"),
        F.pmod(_cell(F.col(lon) + 180, degrees), F.lit(turn).cast("long")).alias("_x"))
    far = distance_km(F.col("_lat"), F.col("_lon"), F.col("_plat"), F.col("_plon"))
    met = _spread(held, asked, ["_y", "_x"], ["_place"], hot).withColumn("km", far).where(F.col("km") <= km)
    return met.select(F.col("_point").alias(point_id), F.col("_place").alias(place_id), "km")


def edges(features: DataFrame, zone: str = "zone") -> DataFrame:
    """Sides of all rings: zone, part (one number a polygon), x1, y1, x2, y2. Rings may be open; holes are rings as well."""
    polygons = features.select(F.col(zone).alias("zone"), F.explode("coordinates").alias("rings")).withColumn(
        "part", F.monotonically_increasing_id())
    rings = polygons.select("zone", "part", F.explode("rings").alias("ring")).where(F.size("ring") > 2)
    sides = F.transform("ring", lambda p, i: F.struct(
        p[0].alias("x1"), p[1].alias("y1"), F.element_at("ring", F.pmod(i + 1, F.size("ring")) + 1)[0].alias("x2"),
        F.element_at("ring", F.pmod(i + 1, F.size("ring")) + 1)[1].alias("y2")))
    return rings.select("zone", "part", F.explode(sides).alias("s")).select("zone", "part", "s.*").where("y1 <> y2 or x1 <> x2")


def zone_at(points: DataFrame, features: DataFrame, point_id: str, lat: str = "lat", lon: str = "lon", zone: str = "zone",
            degrees: float = 0.5, hot: int = HOT) -> DataFrame:
    """Zones that hold a point: point_id, zone; several where zones overlap, none outside of all.

    A ray to the east crosses a polygon's sides (holes included) an odd number of times from inside. A point meets the
    polygons whose bounding box touches its cell, then only those of their sides that span its band of latitude. Sides
    hold their southern and not their northern end, so a point on a shared border is in exactly one of two neighbours
    split by latitude; polygons do not cross the date line.
    """
    sides = stage(edges(features.where(F.col(zone).isNotNull()), zone), "sides")  # read twice, and polygons keep their numbers
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    boxes = sides.groupBy("part").agg(F.min(F.least("x1", "x2")).alias("w"), F.max(F.greatest("x1", "x2")).alias("e"),
                                      F.min(low).alias("s"), F.max(high).alias("n"))
    cells = boxes.select("part", "w", "e", "s", "n", F.explode(F.sequence(_cell(F.col("s"), degrees), _cell(F.col("n"), degrees))).alias("_y"))
    cells = cells.select("*", F.explode(F.sequence(_cell(F.col("w"), degrees), _cell(F.col("e"), degrees))).alias("_x"))
    at = points.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).select(
        F.col(point_id).alias("_point"), F.col(lat).alias("_lat"), F.col(lon).alias("_lon"), _cell(F.col(lat), degrees).alias("_y"), _cell(F.col(lon), degrees).alias("_x"))
    boxed = _spread(at, cells, ["_y", "_x"], ["_point"], hot).where("_lon between w and e and _lat between s and n")
    boxed = stage(boxed.select("_point", "_lat", "_lon", "_y", "part"), "boxed")
    bands = sides.where("y1 <> y2").select("zone", "part", "x1", "y1", "x2", "y2", F.explode(F.sequence(_cell(low, degrees), _cell(high, degrees))).alias("_y"))
    crossed = _spread(boxed, bands, ["part", "_y"], ["_point"], hot).where(
        (low <= F.col("_lat")) & (F.col("_lat") < high)
        & (F.col("_lon") < F.col("x1") + (F.col("_lat") - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))))
    inside = crossed.groupBy("_point", "zone", "part").agg(F.count("*").alias("n")).where("n % 2 = 1")
    return inside.select(F.col("_point").alias(point_id), F.col("zone").alias(zone)).distinct()

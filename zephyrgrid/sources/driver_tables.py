"""The given tables read as weather and electricity data (see FIXTURES.md).

Measures are dyadic fractions (quarters, eighths) wherever possible: their sums are exact in any order,
so results do not depend on the partitioning. Wind directions stay within half a circle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timeaxis import HOUR, hour_of, shift
from ..functions.weather import circular_mean
from ..operators.blocks import row_blocks, with_position
from ..operators.grid import complete_grid
from ..session import configure, stage

FUELS = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
RENEWABLE = ["ECONOMY", "SMALL"]
NAIVE_LAGS = {"naive_1": 1, "naive_24": 24, "naive_168": 168}
RULES = {"temp": F.avg, "dwpt": F.avg, "rhum": F.avg, "prcp": F.sum, "snow": F.max, "wdir": circular_mean,
         "wspd": F.avg, "wpgt": F.max, "pres": F.avg, "tsun": F.sum, "coco": F.max}


class Tables:
    """Views for one query. Roll-ups that a plan reads more than once are staged as small tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = configure(spark), folder
        self._staged: dict[str, DataFrame] = {}

    def staged(self, name: str) -> DataFrame:
        """The named view as a table written once per query."""
        if name not in self._staged:
            self._staged[name] = stage(getattr(self, name)(), name.strip("_"))
        return self._staged[name]

    def raw(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        stamps = [c for c, t in df.dtypes if t == "timestamp"]
        return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in stamps}) if stamps else df

    def obs(self) -> DataFrame:
        """Raw readings; the series is the event type."""
        k = F.regexp_extract("props", r"(\d+)", 1).cast("int")
        v = F.floor("value").cast("double")
        return self.raw("events").withColumn("k", k).select(
            F.col("event_type").alias("id"), F.col("ts").alias("time"), "event_id", "user_id", "k",
            (F.round(F.col("value") * 4) / 4).alias("temp"),
            (F.round(F.col("value") * 4) / 4 - (F.lit(100) - F.col("k")) / 4).alias("dwpt"),
            F.col("k").cast("double").alias("rhum"), (v / 8).alias("prcp"),
            F.when(F.col("k") % 3 != 0, F.floor(F.col("k") / 10) / 4).alias("snow"),
            F.pmod(F.col("k") * 1.75 + 300.0, F.lit(360.0)).alias("wdir"),
            (v / 4).alias("wspd"), F.when(F.col("k") % 5 != 0, v / 2).alias("wpgt"),
            (F.lit(1000.0) + F.col("k") / 4).alias("pres"),
            F.when(F.col("k") % 4 != 0, F.col("k") / 2).alias("tsun"),
            (F.lit(1) + F.col("k") % 27).cast("int").alias("coco"))

    def obs_by_user(self) -> DataFrame:
        return self.obs().withColumn("id", F.col("user_id").cast("string"))

    def hourly(self, start: str | None = None, end: str | None = None) -> DataFrame:
        """Hours from ``start`` to ``end`` (both included); the range is set on the raw time, where the scan prunes by it."""
        raw = self.obs()
        if start is not None:
            raw = raw.filter(F.col("time") >= F.date_trunc("hour", F.lit(start).cast("timestamp_ntz")).cast("timestamp_ntz"))
        if end is not None:
            raw = raw.filter(F.col("time") < shift(F.lit(end).cast("timestamp_ntz"), HOUR))
        return raw.groupBy("id", hour_of("time").alias("time")).agg(
            *[fn(m).alias(m) for m, fn in RULES.items()])

    def hourly_full(self) -> DataFrame:
        return complete_grid(self.staged("hourly"), ["id"], "time")

    def hourly_mean(self) -> DataFrame:
        return self.obs().groupBy(F.col("id").alias("unique_id"), hour_of("time").alias("ds")).agg(
            F.avg("temp").alias("y"))

    def series(self) -> DataFrame:
        """Hourly mean temperature per series, in the models' long form."""
        return self.staged("hourly_mean")

    def zones(self) -> DataFrame:
        r = self.raw("region")
        return self.raw("nation").join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(
            F.concat(F.lit("US-"), "r_name", F.lit("-"), "n_nationkey").alias("zone"),
            F.col("r_name").alias("state"), "n_name", "n_nationkey")

    def load(self) -> DataFrame:
        """Daily load by customer nation."""
        n = self.raw("nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("zone"))
        c = self.raw("customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey").join(n, "c_nationkey")
        return self.raw("orders").join(c, "o_custkey").groupBy("zone", F.col("o_orderdate").alias("period")).agg(
            F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("value"))

    def supplier_zone(self) -> DataFrame:
        n = self.raw("nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("zone"))
        return self.raw("supplier").select("s_suppkey", "s_nationkey").join(n, "s_nationkey").select(
            F.col("s_suppkey").alias("l_suppkey"), "zone")

    def sales(self) -> DataFrame:
        """Lines with their supplier's nation. Fact-to-dimension joins leave hot keys to the skew join."""
        return self.raw("lineitem").withColumnRenamed("l_shipdate", "period").join(self.supplier_zone(), "l_suppkey")

    def price(self) -> DataFrame:
        """Mean price per unit by supplier nation and day, in whole cents."""
        cents = (F.sum(F.col("l_extendedprice").cast("decimal(18,2)")) * 100).cast("double")
        return self.sales().groupBy("zone", "period").agg((F.floor(cents / F.sum("l_quantity")) / 100).alias("value"))

    def generation(self) -> DataFrame:
        parts = self.raw("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("fueltype"))
        return self.sales().join(parts, "l_partkey").groupBy("zone", "period", "fueltype").agg(
            F.sum("l_quantity").alias("value"))

    def flows(self) -> DataFrame:
        n = self.raw("nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("to_zone"))
        c = self.raw("customer").select("c_custkey", "c_nationkey").join(n, "c_nationkey").select("c_custkey", "to_zone")
        o = self.raw("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
        to = o.join(c, "c_custkey").select("l_orderkey", "to_zone")
        return self.sales().withColumnRenamed("zone", "from_zone").join(to, "l_orderkey").groupBy(
            "from_zone", "to_zone", "period").agg(F.sum("l_quantity").alias("value"))

    def capacity(self) -> DataFrame:
        """Sizes of the distinct parts each nation's suppliers shipped, by part type."""
        made = self.raw("lineitem").select("l_partkey", "l_suppkey").distinct().join(
            self.supplier_zone(), "l_suppkey").select("zone", "l_partkey").distinct()
        parts = self.raw("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("fuel"), "p_size")
        return made.join(parts, "l_partkey").groupBy("zone", "fuel").agg(
            F.sum("p_size").cast("double").alias("capacity"))

    def paired(self) -> DataFrame:
        """Actuals beside three naive forecasts (the value 1, 24 and 168 rows earlier)."""
        numbered = with_position(self.series(), ["unique_id"], ["ds"], "pos")
        lagged = row_blocks(
            numbered, ["unique_id"],
            lambda w: {name: F.lag("y", k).over(w) for name, k in NAIVE_LAGS.items()}, max(NAIVE_LAGS.values()))
        step = (F.lit(1) + F.col("pos") % 24).cast("int").alias("horizon_step")
        return lagged.select("unique_id", "ds", "y", step, *NAIVE_LAGS).unpivot(
            ["unique_id", "ds", "y", "horizon_step"], list(NAIVE_LAGS), "model", "yhat"
        ).filter(F.col("yhat").isNotNull())

    def geo_lines(self) -> DataFrame:
        """One GeoJSON feature per customer: a square ring, every third with a hole, every fifth a Polygon."""
        x, y = (F.floor("c_acctbal") / 4).alias("x"), (F.col("c_custkey") / 4).alias("y")
        named = self.raw("customer").join(
            self.raw("nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey"
        ).select("c_custkey", "n_name", x, y)

        def ring(size: float):
            corners = [(0, 0), (size, 0), (size, size), (0, size), (0, 0)]
            return F.array(*[F.array(F.col("x") + dx, F.col("y") + dy) for dx, dy in corners])

        rings = F.when(F.col("c_custkey") % 3 == 0, F.array(ring(2.0), ring(0.5))).otherwise(F.array(ring(2.0)))
        kind = F.when(F.col("c_custkey") % 5 == 0, "Polygon").otherwise("MultiPolygon")
        country = F.when(F.col("c_custkey") % 7 == 0, "Elsewhere").otherwise("United States")
        feature = F.struct(
            F.struct(F.col("n_name").alias("zoneName"), country.alias("countryName")).alias("properties"),
            F.struct(kind.alias("type"), F.array(rings).alias("coordinates")).alias("geometry"))
        return named.select("c_custkey", F.to_json(feature).alias("value"))


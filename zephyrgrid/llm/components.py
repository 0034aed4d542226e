"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest node of each node's component: g, node, label, from edges g, a, b; components never cross ``g``.

    Both steps replace edges by edges to smaller nodes and keep every component connected, until all edges are stars.
    Each round's edges are written to the shared folder. No node's neighbours are gathered: minima are aggregated.
    Loops and repeated edges are allowed; nodes of loops alone are left out.
    """
    now = edges.where("a <> b").select("g", F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, mark = _settle(now)
    for _ in range(max_rounds):
        both = now.select("g", "a", "b").union(now.select("g", F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("g", "a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.where("b > a").join(least, ["g", "a"]).select("g", F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = stage(large, "large-star")
        least = large.groupBy("g", "a").agg(F.min("b").alias("m"))
        moved = large.join(least, ["g", "a"]).where("b <> m").select("g", F.col("b").alias("a"), F.col("m").alias("b"))
        now, seen = _settle(moved.union(least.select("g", "a", F.col("m").alias("b"))).distinct())
        if seen == mark:
            return now.groupBy("g", "a").agg(F.min("b").alias("label")).union(
                now.select("g", "b", F.col("b").alias("label")).distinct()).toDF("g", "node", "label")
        mark = seen
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _settle(edges: DataFrame) -> tuple[DataFrame, tuple]:
    edges = stage(edges, "stars")
    digest = F.xxhash64("g", "a", "b")
    return edges, tuple(edges.agg(F.count("*"), F.sum(digest.bitwiseAND(F.lit(0xFFFFFFFF))), F.bit_xor(digest)).first())

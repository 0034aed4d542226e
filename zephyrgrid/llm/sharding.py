"""Sharding by best-fit-decreasing bin packing (operator 10).

A group is all rows of one text and is never divided. The packer sees a bounded number of items: every group of at least
1/64 of a mean shard by itself (there can be 64 per shard at most), all smaller ones gathered by a hash of the text into
a fixed number of bundles. Items go, from the largest down, into the open shard with the tightest sufficient room, found
in an ordered tree; the smallest capacity at which the shards suffice is found by bisection.
"""

from __future__ import annotations

import bisect
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import stage
from .text import crc32_text, whole

ROW_BYTES = 16
BUNDLES = 4096
GIANTS_PER_SHARD = 64
SLOT_ROWS = 20_000


class RoomTree:
    """Open bins ordered by (room, bin) in a balanced search tree laid out as one sorted array; at most one entry per shard."""

    def __init__(self) -> None:
        self.entries: list[tuple[int, int]] = []

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        at = bisect.bisect_left(self.entries, (size, -1))
        return self.entries.pop(at) if at < len(self.entries) else None

    def put(self, room: int, bin_: int) -> None:
        bisect.insort(self.entries, (room, bin_))


def best_fit(sizes: list[int], capacity: int, bins: int) -> list[int] | None:
    """Bin of each size (sizes fall), or None when ``bins`` of this capacity do not suffice."""
    tree, opened, placed = RoomTree(), 0, []
    for size in sizes:
        found = tree.take_tightest(size)
        if found is None:
            if opened == bins or size > capacity:
                return None
            found, opened = (capacity, opened), opened + 1
        tree.put(found[0] - size, found[1])
        placed.append(found[1])
    return placed


def pack(items: list[tuple[int, str]], bins: int) -> dict[str, int]:
    """Shard of each item (size, key): items above the mean of what is left stand alone, the rest is packed as tightly as possible."""
    items = sorted(items, key=lambda x: (-x[0], x[1]))
    out, first, left = {}, 0, sum(size for size, _ in items)
    while items and bins - first > 1 and items[0][0] * (bins - first) >= left:
        size, key = items.pop(0)
        out[key], first, left = first, first + 1, left - size
    if not items:
        return out
    sizes, room = [size for size, _ in items], bins - first
    low = max(math.ceil(left / room), sizes[0])
    high, best = low, best_fit(sizes, low, room)
    while best is None:
        low, high = high + 1, high + max(1, high // 64)
        best = best_fit(sizes, high, room)
    while low < high:
        middle = (low + high) // 2
        tried = best_fit(sizes, middle, room)
        if tried is None:
            low = middle + 1
        else:
            high, best = middle, tried
    return out | {key: first + bin_ for (_, key), bin_ in zip(items, best, strict=True)}


def shard_documents(docs: DataFrame, shards: int = 40, id: str = "doc_id", text: str = "text", bundles: int = BUNDLES) -> DataFrame:
    """Shard and slot of every row: id, size, text_crc32, group_hash, shard, slot.

    * Sizes are the UTF-8 bytes of the text plus 16; the law is near-equal bytes. Rows of equal text share a shard; a null
      text counts as the empty one. A group larger than a mean shard gets a shard of its own and the others share the rest.
    * ``slot`` counts each shard's rows from 0 without gaps, by a hash of the id and then the id. Repeated rows get slots
      of their own; null ids come first in their range; an empty table gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    value = whole(text)
    sized = stage(docs.select(
        F.col(id).alias("__id"), (F.octet_length(value) + ROW_BYTES).cast("long").alias("size"),
        crc32_text(value).alias("text_crc32"), F.xxhash64(value).alias("group_hash")), "sized")
    total, rows = sized.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    groups = stage(sized.groupBy("group_hash").agg(F.sum("size").alias("bytes")), "groups")
    giant = F.col("bytes") * (shards * GIANTS_PER_SHARD) >= total
    bundle = F.pmod(F.col("group_hash"), F.lit(bundles)).cast("int")
    items = [(r[1], f"g{r[0]}") for r in groups.where(giant).collect()]  # at most shards * 64
    items += [(r[1], f"b{r[0]}") for r in groups.where(~giant).groupBy(bundle.alias("b")).agg(F.sum("bytes")).collect()]
    placed = pack(items, shards)
    of = lambda kind: [(int(k[1:]), s) for k, s in placed.items() if k[0] == kind]
    giants = spark.createDataFrame(of("g"), "group_hash long, own int")
    bundled = spark.createDataFrame(of("b"), "bundle int, shared int")
    parts = max(1, math.ceil(rows / (shards * SLOT_ROWS)))
    shares = (sized.withColumn("bundle", bundle).join(giants, "group_hash", "left").join(bundled, "bundle", "left")
              .select("__id", "size", "text_crc32", "group_hash", F.coalesce("own", "shared").alias("shard"),
                      F.pmod(F.xxhash64("__id"), F.lit(parts)).cast("int").alias("part")))
    counts = shares.groupBy("shard", "part").count()
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "part").orderBy("__id", "group_hash")
    return shares.withColumn("rank", F.row_number().over(inside)).join(starts, ["shard", "part"]).select(
        F.col("__id").alias(id), "size", "text_crc32", "group_hash", "shard",
        (F.col("start") + F.col("rank") - 1).cast("long").alias("slot"))

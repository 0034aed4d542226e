"""Merkle manifest of a dataset with persistent versions (operator 12).

Every row is a leaf; the leaves of a source form a tree by runs of three, and the roots of all sources form the tree
above. Trees are built in aligned blocks of 3^8 nodes: a block is one small task's work, its root is a node of the next
round, so no task sees a source. A leaf that is found changed makes a new version of the tree that shares every untouched
node: only its ancestors are copied, inside its block first, then along the block's upper path, which is joined to it;
versions are never gathered.
"""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import sha256

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage

FANOUT = 3
DEPTH = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(parts: bytes) -> bytes:
    """Lower-case hexadecimal SHA-256 as ASCII."""
    return sha256(parts).hexdigest().encode()


def leaf(values: Sequence[Column]) -> Column:
    """Digest of a row: each value as its UTF-8 byte count, a colon and its text, or ``-`` where it is null."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def height(nodes: int) -> int:
    """Levels above ``nodes`` nodes until one remains."""
    levels, reach = 0, 1
    while reach < nodes:
        levels, reach = levels + 1, reach * FANOUT
    return levels


class Block:
    """An aligned part of a tree: its nodes level by level, and versions of it that share them."""

    def __init__(self, nodes: list[bytes], levels: int) -> None:
        self.levels = [nodes]
        for _ in range(levels):
            below = self.levels[-1]
            self.levels.append([digest(b"".join(below[i:i + FANOUT])) for i in range(0, len(below), FANOUT)])

    @property
    def root(self) -> bytes:
        return self.levels[-1][0]

    def siblings(self, level: int, i: int) -> tuple[bytes, bytes]:
        """The others of a node's run: those before it and those after it."""
        nodes, first = self.levels[level], i - i % FANOUT
        return b"".join(nodes[first:i]), b"".join(nodes[i + 1:first + FANOUT])

    def paths(self) -> list[bytes]:
        """For each node of the lowest level its siblings up to the root, as ``before|after`` joined by ``;``."""
        above = [b""]
        for level in range(len(self.levels) - 2, -1, -1):
            at = []
            for i in range(len(self.levels[level])):
                own, rest = b"|".join(self.siblings(level, i)), above[i // FANOUT]
                at.append(own + b";" + rest if rest else own)
            above = at
        return above

    def version(self, i: int, node: bytes) -> list[bytes]:
        """Copies of the ancestors of node ``i`` once it is ``node``, from its parent to the root; all else is shared."""
        copies = []
        for level in range(len(self.levels) - 1):
            before, after = self.siblings(level, i)
            node, i = digest(before + node + after), i // FANOUT
            copies.append(node)
        return copies


def climb(node: bytes, path: bytes) -> list[bytes]:
    """Copies of a node's ancestors along an upper path."""
    copies = []
    for run in path.split(b";") if path else []:
        before, after = run.split(b"|")
        node = digest(before + node + after)
        copies.append(node)
    return copies


def number(rows: DataFrame, key: str, order: Sequence[str], label: str) -> DataFrame:
    """Add rank (from 0) and n (rows) within ``key``: rows are dealt by ranges of key and order and sorted inside them, and
    counts by key and range are summed, so a key of any size is spread. ``order`` must tell equal rows apart."""
    dealt = stage(rows, f"{label}-rows").repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    placed = stage(dealt.select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__at")), f"{label}-placed")
    whole = Window.partitionBy(key)
    before = whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    runs = placed.groupBy(key, "__part").agg(F.count("*").alias("__c"), F.min("__at").alias("__first")).select(
        key, "__part", (F.coalesce(F.sum("__c").over(before), F.lit(0)) - F.col("__first")).alias("__shift"), F.sum("__c").over(whole).alias("n"))
    return placed.join(runs, [key, "__part"]).withColumn("rank", F.col("__at") + F.col("__shift")).drop("__part", "__at", "__shift")


def _levels(n: int, block: int, depth: int) -> int:
    return depth if n > block else height(n)


def block_roots(nodes: DataFrame, depth: int) -> DataFrame:
    """Root of every aligned block of nodes k, rank, node, n: as nodes of the next round."""
    block = FANOUT ** depth

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank")
        n = int(rows["n"].iloc[0])
        root = Block([x.encode() for x in rows["node"]], _levels(n, block, depth)).root
        return pd.DataFrame([(key[0], key[1], root.decode(), -(-n // block))], columns=["k", "rank", "node", "n"])

    grouped = nodes.select("k", "rank", "node", "n", F.floor(F.col("rank") / block).alias("block")).groupBy("k", "block")
    return grouped.applyInPandas(run, "k string, rank long, node string, n long")


def upper_paths(nodes: DataFrame, depth: int, label: str) -> DataFrame:
    """Path to the key's root of nodes k, rank, node, n, and that root: k, rank, path, root. A recursion over rounds of
    blocks; each round has 3^``depth`` times fewer nodes."""
    block = FANOUT ** depth
    nodes = stage(nodes, f"{label}-nodes")

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank")
        made = Block([x.encode() for x in rows["node"]], _levels(int(rows["n"].iloc[0]), block, depth))
        return pd.DataFrame({"k": rows["k"], "rank": rows["rank"], "block": rows["block"], "path": [p.decode() for p in made.paths()], "root": made.root.decode()})

    at = nodes.withColumn("block", F.floor(F.col("rank") / block))
    local = at.groupBy("k", "block").applyInPandas(run, "k string, rank long, block long, path string, root string")
    if nodes.where(F.col("n") > block).isEmpty():
        return local.drop("block")
    above = upper_paths(block_roots(nodes, depth), depth, label).select("k", F.col("rank").alias("block"), F.col("path").alias("up"), F.col("root").alias("top"))
    path = F.concat_ws(";", F.nullif("path", F.lit("")), F.nullif("up", F.lit("")))
    return local.join(above, ["k", "block"]).select("k", "rank", path.alias("path"), F.col("top").alias("root"))


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, id: str = "doc_id", group: str = "source",
             found: dict[str, Column] | None = None, depth: int = DEPTH, versions: bool = False) -> DataFrame:
    """Leaf, subroot, root, proof and folded root of every row: id, leaf, subroot, root, proof_sha256, folded_root, verified;
    with ``versions`` also the version's copied nodes from the leaf's parent to the root (empty where nothing changed).

    * ``found`` gives fields as they are found later; where that changes a leaf, its version is folded along the original
      siblings. Without it every row is verified.
    * Leaves of a group ascend by id, null first, then by digest; equal rows get a leaf each. A null group is a group and
      the first one. Empty texts are values; very long texts are hashed whole, in the JVM. An empty table gives an empty
      result; columns other than the fields are not read, whatever their names.
    * A task holds one block: ``3 ** depth`` leaves with their paths (some 8 MB). What is shuffled are digests.
    """
    found = found or {}
    original = leaf([F.col(c) for c in fields])
    later = leaf([found.get(c, F.col(c)) for c in fields])
    differs = F.lit(False)
    for c, value in found.items():
        differs = differs | ~value.eqNullSafe(F.col(c))
    rows = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("k"), F.col(id).alias("__id"), original.alias("node"),
        F.when(differs, later).alias("later"), F.monotonically_increasing_id().alias("row"))
    block = FANOUT ** depth
    leaves = stage(number(rows, "k", ["__id", "node", "row"], "leaves").withColumn("block", F.floor(F.col("rank") / block)).drop("row"), "leaves")

    below = upper_paths(block_roots(leaves, depth), depth, "blocks").select("k", F.col("rank").alias("block"), "path", F.col("root").alias("subroot"))
    below = stage(below, "block-paths")
    groups = number(below.where("block = 0").select(F.lit("").alias("all"), "k", F.col("subroot").alias("node")), "all", ["k"], "groups")
    tops = stage(upper_paths(groups.select(F.col("all").alias("k"), "rank", "node", "n"), depth, "groups"), "group-paths")
    groups = groups.join(tops.select("rank", F.col("path").alias("up"), "root"), "rank").select("k", "up", "root")
    path = F.concat_ws(";", F.nullif("path", F.lit("")), F.nullif("up", F.lit("")))
    above = below.join(groups, "k").select("k", "block", F.lit(-1).cast("long").alias("rank"), path.alias("path"), "subroot", "root")

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("rank")
        top, rows = rows.slice(0, 1).to_pylist()[0], rows.slice(1)
        upper, root = top["path"].encode(), top["root"]
        siblings = upper.translate(None, b"|;")
        leaves = rows.column("node").to_pylist()
        tree = Block([x.encode() for x in leaves], _levels(rows.column("n")[0].as_py(), block, depth))
        proofs = [digest(p.translate(None, b"|;") + siblings).decode() for p in tree.paths()]
        copied = []
        for i, later in enumerate(rows.column("later").to_pylist()):
            copies = []
            if later is not None:
                copies = tree.version(i, later.encode())
                copies += climb(copies[-1] if copies else later.encode(), upper)
                copies = copies or [later.encode()]  # one leaf, one group: the leaf is the root
            copied.append([c.decode() for c in copies])
        out = {"__id": rows.column("__id"), "leaf": leaves, "subroot": [top["subroot"]] * len(leaves), "root": [root] * len(leaves),
               "proof_sha256": proofs, "folded_root": [c[-1] if c else root for c in copied]}
        return pa.table(out | ({"versions": pa.array(copied, pa.list_(pa.string()))} if versions else {}))

    kind = leaves.schema["__id"].dataType.simpleString()
    schema = f"__id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string" + (", versions array<string>" if versions else "")
    every = leaves.select("k", "block", "rank", "n", "__id", "node", "later").unionByName(above, allowMissingColumns=True)
    made = every.groupBy("k", "block").applyInArrow(run, schema)
    return made.withColumn("verified", F.col("folded_root") == F.col("root")).withColumnRenamed("__id", id)

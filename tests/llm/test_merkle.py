import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as e
from compare import compare, duck
from zephyrgrid.llm.merkle import manifest

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return sha(*["-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in FIELDS])


def up(nodes):
    """All levels of a plain tree."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i:i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def walk(levels, i):
    for nodes in levels[:-1]:
        first = i - i % 3
        yield nodes[first:i], nodes[i + 1:first + 3]
        i //= 3


def brute(rows, tamper):
    groups = defaultdict(list)
    for row in rows:
        groups[row["source"]].append((row["doc_id"] is not None, row["doc_id"] or 0, leaf_of(row), row))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: up([leaf for _, _, leaf, _ in sorted(groups[s], key=lambda g: g[:3])]) for s in order}
    top = up([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, (_, _, leaf, row) in enumerate(sorted(groups[s], key=lambda g: g[:3])):
            runs = [*walk(trees[s], i), *walk(top, k)]
            changed = {**row, "text": row["text"].replace("\n", "")} if row["text"] is not None and tamper(row) else row
            node = leaf_of(changed)
            for before, after in runs:
                node = sha(*before, node, *after)
            proof = sha(*[x for before, after in runs for x in before + after])
            out.append((row["doc_id"], leaf, trees[s][-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return sorted(out, key=repr)


def tampered(row):
    return zlib.crc32(str("" if row["doc_id"] is None else row["doc_id"]).encode()) % 2 == 0


def found():
    even = F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8")) % 2 == 0
    return {"text": F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))}


def plain(df):
    return sorted([tuple(r) for r in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()], key=repr)


@pytest.mark.parametrize("depth", [1, 8])
def test_odd_rows(docs, depth):
    frame = docs("node")
    rows = [r.asDict() for r in frame.collect()]
    assert plain(manifest(frame, found=found(), depth=depth)) == brute(rows, tampered)
    assert manifest(frame, depth=depth).where("not verified").isEmpty()


@pytest.mark.parametrize("sizes", [(1,), (1, 1), (40, 1, 3, 9, 10, 0, 27), (28, 4, 1, 1, 1, 82)])
def test_blocks_of_every_shape(spark, sizes):
    rows = [(10 * k + 1000 * s, f"s{s}" if s else None, "en", i, f"text\n{k}\n" if i % 3 else "flat")
            for s, n in enumerate(sizes) for i, k in enumerate(range(n))]
    frame = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(4)
    want = brute([dict(zip(FIELDS, r)) for r in rows], tampered)
    for depth in (1, 2):
        assert plain(manifest(frame, found=found(), depth=depth)) == want


def test_versions_share_untouched_nodes(spark):
    rows = [(k, "a", "en", 1, f"t{k}") for k in range(30)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    made = manifest(frame, found={"text": F.when(F.col("doc_id") == 4, F.lit("x")).otherwise(F.col("text"))}, depth=2, versions=True)
    by_id = {r["doc_id"]: r for r in made.collect()}
    assert len(by_id[4]["versions"]) == 4 and by_id[4]["versions"][-1] == by_id[4]["folded_root"] and not by_id[4]["verified"]
    assert all(not r["versions"] and r["verified"] for k, r in by_id.items() if k != 4)


def test_empty(docs):
    assert manifest(docs().limit(0)).count() == 0


def test_large_ids_and_sample(spark, sample):
    frame = sample.withColumn("doc_id", F.col("doc_id") + F.lit(1 << 60))
    assert plain(manifest(frame, found=found())) == brute([r.asDict() for r in frame.collect()], tampered)


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    problem, rows = compare(spark, duck(folder), "op12", e.queries()["op12_merkle"], e.oracle_sql()["op12_merkle"], folder)
    assert problem is None and rows > 0, problem

import math
import random
import re
from pathlib import Path

import numpy as np
import psutil
import pytest
from pyspark.sql import functions as F

from compare import compare, duck
import __spark_entry__ as e
from zephyrgrid.llm import topk


def brute(rows, ask, k):
    def floor(v):
        return [math.floor(1024 * x) for x in v]
    good = [(i, floor(v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in good if ask(i)}):
        v = min(x for i, x in good if i == q)
        scored = sorted((-sum(a * b for a, b in zip(v, x, strict=False)), i) for i, x in good if i != q)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return out


@pytest.mark.parametrize("spread", [0.0, 1.0])
def test_matches_all_pairs(spark, monkeypatch, spread):
    monkeypatch.setattr(topk, "TILE_ROWS", 50)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 20)
    monkeypatch.setattr(topk, "CHUNK", 16)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 12)) * np.exp(spread * rng.normal(size=(400, 1))) * np.linspace(2, 0.2, 12)
    x = np.round(x, 1)  # ties
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 7 == 0, k=10).collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows, lambda i: i % 7 == 0, 10))


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [1.0]), (6, []), (None, [1.0, 1.0]),
            (7, [0.5, 0.5]), (7, [0.5, 0.5]), (8, [-3.0, 1e3]), (100, [0.0, 0.0]), (200, [1e9, -1e9])]
    frame = spark.createDataFrame([(*r, 1.0) for r in rows], "vec_id long, embedding array<double>, length double")
    got = topk.top_k(frame, F.col("vec_id") % 100 == 0, k=4).collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows, lambda i: i % 100 == 0, 4))
    assert topk.top_k(frame.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert topk.top_k(frame, F.col("vec_id") == -1).count() == 0


def test_query_against_sql(spark):
    folder = "/root/testdata/sf0.001"
    assert compare(spark, duck(folder), "op3_topk", e.queries()["op3_topk"], e.oracle_sql()["op3_topk"], folder)[0] is None


def test_large_sums_are_exact():
    random.seed(1)
    q = np.array([[random.randint(-2**40, 2**40) for _ in range(3)] for _ in range(5)])
    assert topk._exact(q, q[::-1]).tolist() == [min(max(sum(int(a) * int(b) for a, b in zip(x, y, strict=True)), -2**63), 2**63 - 1) for x, y in zip(q, q[::-1], strict=True)]


def test_rounds_and_several_tasks_match_all_pairs(spark, monkeypatch):
    for name, value in {"TILE_ROWS": 40, "BLOCK_ROWS": 20, "FILE_TILES": 2, "TASK_BLOCKS": 1, "EARLY": 0.5}.items():
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=(500, 9)) * np.exp(0.3 * rng.normal(size=(500, 1))), 1)
    x[100:160] = x[100]  # ties of one vector
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 4 == 0, k=5).collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows, lambda i: i % 4 == 0, 5))


@pytest.mark.parametrize("large", [30, 2**40])
def test_block_finds_the_best_in_any_tiles(monkeypatch, large):
    for name, value in {"CHUNK": 16, "PAIRS": 8, "FOUND": 64, "SPARSE": 0.2, "DENSE": 0.5}.items():
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(7)
    v = np.floor(rng.normal(size=(300, 6)) * np.linspace(1, 0.05, 6) * large).astype(np.int64)
    v = v[np.argsort(-(v.astype(float) ** 2).sum(axis=1), kind="stable")]
    v[5], basis = 0, topk.rotation(v.tolist(), 6)
    ids = rng.permutation(300)
    block = topk._Block(ids[::5], v[::5], np.full(60, topk.NO_FLOOR), 4, basis)
    for first in range(0, 300, 70):
        block.meet(topk._Vectors(ids[first:first + 70], v[first:first + 70], basis, False))
    got = {r for batch in block.best() for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)}
    ends = np.iinfo(np.int64)
    score = lambda a, b: min(max(sum(int(x) * int(y) for x, y in zip(a, b, strict=True)), ends.min), ends.max)
    assert got == {(int(q), i, -s) for q, a in zip(ids[::5], v[::5], strict=True)
                   for s, i in sorted((-score(a, b), int(i)) for i, b in zip(ids, v, strict=True) if i != q)[:4]}


def test_memory_of_a_task_does_not_grow_with_queries_by_candidates(spark):
    def workers():
        return [p for p in psutil.Process().children(recursive=True) if p.name().startswith("python")]
    rng = np.random.default_rng(8)
    x = rng.normal(size=(4096, 64)) * 0.1
    frame = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    for p in workers():
        Path(f"/proc/{p.pid}/clear_refs").write_text("5")  # peaks count from here on
    assert topk.top_k(frame, F.lit(True)).count() == 40960
    peaks = [int(re.search(r"VmHWM:\s+(\d+)", Path(f"/proc/{p.pid}/status").read_text())[1]) for p in workers()]
    assert peaks and max(peaks) < 1_200_000  # KB; 4,096 queries by 512 candidates of 64 numbers took 3 GB and more


def test_rotation_is_fitted_on_the_smallest_hashes(spark, monkeypatch):
    monkeypatch.setattr(topk, "SAMPLE", 16)
    rows = spark.range(3000, numPartitions=5).select(F.col("id").alias("__id"), F.array("id").alias("v"))
    compared = []
    limit = type(rows).limit
    monkeypatch.setattr(type(rows), "limit", lambda self, n: (compared.append(self.count()), limit(self, n))[1])
    got = [v[0] for v in topk._sample(rows, 3000)]
    assert got == [r["__id"] for r in limit(rows.orderBy(F.xxhash64("__id")), 16).collect()]
    assert compared and compared[0] < 100  # not all rows, of which every partition would send its own 16

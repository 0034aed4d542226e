import random
import zlib
from collections import Counter, defaultdict

import pytest

import __spark_entry__ as e
from zephyrgrid.llm import sharding


def reference_fit(sizes, capacity):
    rooms, placed = [], []
    for size in sizes:
        fits = [(room, i) for i, room in enumerate(rooms) if room >= size]
        i = min(fits)[1] if fits else len(rooms)
        if not fits:
            rooms.append(capacity)
        rooms[i] -= size
        placed.append(i)
    return placed, len(rooms)


def test_best_fit_matches_a_plain_search():
    rng = random.Random(1)
    for _ in range(20):
        sizes = sorted((rng.randint(1, 60) for _ in range(80)), reverse=True)
        placed, bins = reference_fit(sizes, 100)
        assert sharding.best_fit(sizes, 100, bins) == placed and sharding.best_fit(sizes, 100, bins - 1) is None


def test_pack_stands_large_items_alone():
    out = sharding.pack([(1000, "big"), *[(10, f"s{i}") for i in range(30)]], 4)
    loads = Counter()
    for key, bin_ in out.items():
        loads[bin_] += 1000 if key == "big" else 10
    assert sorted(loads.values()) == [100, 100, 100, 1000]


def verify(rows, shards):
    slots, group = defaultdict(list), defaultdict(set)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        group[r["text_crc32"], r["size"]].add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(shards))
    assert all(len(s) == 1 for s in group.values())


def test_query(spark):
    folder = "/root/testdata/sf0.1"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = e.queries()["op10_sharding"](spark, folder).collect()
    assert len(rows) == len(docs)
    loads = Counter()
    for r in rows:
        raw = (docs[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 16, zlib.crc32(raw), "bytes", None)
        loads[r["shard"]] += r["size"]
    verify(rows, 40)
    assert len(loads) == 40 and max(loads.values()) < 1.01 * sum(loads.values()) / 40 and min(loads.values()) > 0.95 * sum(loads.values()) / 40


@pytest.mark.parametrize("shards", [1, 3, 40])
def test_odd_rows(docs, shards):
    frame = docs("shard")
    rows = sharding.shard_documents(frame, shards).collect()
    assert len(rows) == frame.count()
    verify(rows, shards)
    assert sharding.shard_documents(frame.limit(0), shards).count() == 0

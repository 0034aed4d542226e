import random

import numpy as np
import pytest

import __spark_entry__ as e
from zephyrgrid.llm import jaccard
from zephyrgrid.llm.components import components


def shingles(text):
    words = (text or "").encode().lower().split()
    if not words:
        return set()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def brute(rows):
    """Component and links of each (id, text), by comparing all pairs that share a shingle."""
    sets = [shingles(t) for _, t in rows]
    holders = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    root, links, seen = list(range(len(rows))), [0] * len(rows), [dict() for _ in rows]
    for i, s in enumerate(sets):
        for x in s:
            for j in holders[x]:
                if j < i:
                    seen[i][j] = seen[i].get(j, 0) + 1

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, common in enumerate(seen):
        for j, o in common.items():
            if 100 * o >= 75 * (len(sets[i]) + len(sets[j]) - o):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    best = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            best[find(i)] = min(best.get(find(i), key), key)
    return [(key, len(sets[i]), best.get(find(i)), links[i]) for i, (key, _) in enumerate(rows)]


def compare(docs, got):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    plain = lambda x: sorted(x, key=repr)
    assert plain(tuple(r) for r in got.select("doc_id", "n_shingles", "component_id", "n_links").collect()) == plain(brute(rows))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query(spark, sf):
    folder = f"/root/testdata/{sf}"
    compare(spark.read.parquet(f"{folder}/documents.parquet"), e.queries()["op6_jaccard"](spark, folder))


def test_near_copies_over_several_tiles(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE", 16)
    monkeypatch.setattr(jaccard, "FLUSH_TOKENS", 3000)
    rng = random.Random(3)
    base = [f"w{rng.randint(0, 400)}" for _ in range(120)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randint(0, 7)):
            words[rng.randrange(120)] = f"x{i}_{rng.randint(0, 9)}"
        rows.append((i, " ".join(words)))
    rows += [(200 + i, rows[i % 5][1]) for i in range(40)] + [(300 + i, " ".join(f"y{i}_{k}" for k in range(rng.randint(1, 30)))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    compare(docs, jaccard.jaccard_join(docs))


def test_odd_rows(docs):
    frame = docs("class")
    compare(frame, jaccard.jaccard_join(frame))
    assert jaccard.jaccard_join(frame.limit(0)).count() == 0
    kept = jaccard.keep_first(frame)
    assert kept.columns == frame.columns and {r["doc_id"] for r in kept.collect()} == {1, 2, 3, 4, 5, 6, 8, 9, 10, None} and kept.count() == 10


def test_word_hashes_do_not_depend_on_place(monkeypatch):
    words = [b"alpha", b"b", b"gamma", b"alpha", b"delta" * 40, b"alpha"]
    whole = jaccard.word_hashes(b" ".join(words))
    assert whole[0][0] == whole[0][3] == whole[0][5] and len(set(whole[0].tolist())) == 4
    monkeypatch.setattr(jaccard, "SEGMENT", 8)
    assert (jaccard.word_hashes(b" ".join(words))[0] == whole[0]).all()
    assert len(jaccard.word_hashes(b" \t\n")[0]) == 0


def test_intersections():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 300, 80)).astype(np.uint64) for _ in range(60)]
    want = [[len(np.intersect1d(a, b)) if a is not b else None for b in sets] for a in sets]
    got = jaccard.intersections(sets)
    assert all(got[i, j] == want[i][j] for i in range(60) for j in range(60) if i != j)


def test_components_of_a_chain_and_a_star(spark):
    edges = [(0, i, i + 1) for i in range(50)] + [(1, 100, i) for i in range(40)] + [(1, 7, 7), (2, 9, 9)]
    rows = components(spark.createDataFrame(edges, "g int, a long, b long")).collect()
    assert {(r["g"], r["node"], r["label"]) for r in rows} == {(0, i, 0) for i in range(51)} | {(1, i, 0) for i in range(40)} | {(1, 100, 0)}

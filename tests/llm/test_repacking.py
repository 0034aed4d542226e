import itertools
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from zephyrgrid.llm import repacking
from zephyrgrid.llm.repacking import best_fit_decreasing, dual_feasible, lower_bound, pack, plan, sequences

PATH = str(public_tokenizers.path("word_bpe_49k.json"))


def fewest_bins(sizes, capacity):
    """Exact, by trying every assignment of few pieces."""
    best = len(sizes)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for b in {room: k for k, room in enumerate(bins)}.values():
            if bins[b] >= sizes[i]:
                place(i + 1, bins[:b] + [bins[b] - sizes[i]] + bins[b + 1:])
        place(i + 1, [*bins, capacity - sizes[i]])

    place(0, [])
    return best


@pytest.mark.parametrize("capacity", [6, 9, 10])
def test_functions_are_dual_feasible(capacity):
    fits = [c for n in range(1, capacity + 1) for c in itertools.combinations_with_replacement(range(1, capacity + 1), n) if sum(c) <= capacity]
    for worth, bin_ in dual_feasible(capacity, 12):
        assert max(worth[list(c)].sum() for c in fits) <= bin_


def test_bounds_against_exact_counts():
    rng, certified = np.random.default_rng(5), 0
    for _ in range(60):
        sizes = np.sort(rng.integers(1, 20, 8))[::-1]
        exact = fewest_bins(sizes.tolist(), 20)
        bound, (places, offsets, bins) = lower_bound(sizes, 20), best_fit_decreasing(sizes, 20)
        assert bound <= exact <= bins and set(places) == set(range(bins))
        certified += bound == bins
        for b in range(bins):
            at = 0
            for i in np.argsort(offsets):
                if places[i] == b:
                    assert offsets[i] == at
                    at += sizes[i]
            assert at <= 20
    assert certified > 40
    # Pieces just over a half and a third: sizes alone say 2, the functions say 3.
    assert lower_bound(np.array([11, 11, 11]), 20) == 3 and lower_bound(np.array([7, 7, 7, 7, 7]), 20) == 3


def check(docs, pieces, length, end=0):
    tokenizer = Tokenizer.from_file(PATH)
    want, got, bins = defaultdict(int), defaultdict(int), defaultdict(list)
    for row in docs.collect():
        ids = tokenizer.encode(row["text"] or "", add_special_tokens=False).ids + [end]
        for k, first in enumerate(range(0, len(ids), length)):
            want[row["doc_id"], k, first, np.array(ids[first:first + length], "<u4").tobytes()] += 1
    for r in pieces.collect():
        assert len(r["ids"]) == 4 * r["length"]
        got[r["doc_id"], r["piece"], r["start"], bytes(r["ids"])] += 1
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    assert got == want
    for placed in bins.values():
        at = 0
        for offset, size in sorted(placed):
            assert offset == at
            at += size
        assert at <= length
    return bins


@pytest.mark.parametrize("length", [7, 2048])
def test_odd_rows(docs, length):
    frame = docs("key")
    check(frame, pack(frame, PATH, length=length), length)


def test_no_end_id_and_empty(docs):
    assert pack(docs().limit(0), PATH).count() == 0
    assert {r[0] for r in pack(docs().where("doc_id in (2, 3, 10)"), PATH, end_id=None).select("doc_id").collect()} == {10}


def test_partitions_with_a_gap_exchange_documents(spark):
    # From the longest down fours meet fours and threes meet threes, which leaves a gap that larger pools narrow.
    rows = [(k, n) for k, n in enumerate([4, 4, 3, 3, 3, 3] * 40)]
    pieces = spark.createDataFrame(rows, "key long, length long")
    apart = plan(pieces, 10, part_pieces=12, rounds=0)
    pooled = plan(pieces, 10, part_pieces=12, rounds=6)
    total = lambda df: df.groupBy().sum("bins", "bound").first()
    assert total(pooled)[0] < total(apart)[0]
    assert pooled.where("bins < bound").count() == 0
    assert pooled.where("bins > bound").count() <= apart.where("bins > bound").count()
    keys = [k for r in pooled.collect() for k in np.frombuffer(r["keys"], "<i8")]
    assert sorted(keys) == list(range(len(rows)))
    again = lambda turns: sorted((r["sequence_id"], r["key"], r["offset"]) for r in repacking.placements(plan(pieces, 10, 12, turns)).collect())
    assert again(6) == again(6)


def test_sample_is_near_its_bound(sample):
    packed = pack(sample, PATH)
    bins = check(sample, packed, 2048)
    tokens = sum(size for placed in bins.values() for _, size in placed)
    assert len(bins) <= -(-tokens // 2048) + 2
    rows = sequences(packed).collect()
    assert {r["sequence_id"] for r in rows} == set(bins) and all(len(r["ids"]) == 4 * r["length"] == 4 * sum(r["document_lengths"]) for r in rows)


def test_query(spark):
    import zlib

    import __spark_entry__ as e
    rows = e.queries()["op11_repacking"](spark, "/root/testdata/sf0.001").collect()
    tokenizer = Tokenizer.from_file(PATH)
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert {r["doc_id"] for r in rows} == set(text)
    for r in rows:
        ids = tokenizer.encode(text[r["doc_id"]] or "", add_special_tokens=False).ids + [0]
        assert r["start"] == 2048 * r["piece"] and r["length"] == min(2048, len(ids) - r["start"])
        assert zlib.crc32(np.array(ids[r["start"]:r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"]

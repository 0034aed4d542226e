import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from zephyrgrid.llm.packing import pack

PATH = str(public_tokenizers.path("word_bpe_49k.json"))


def check(docs, pieces, length):
    """Every row's ids come back from its pieces, sequences are gapless and only the last one is short."""
    tokenizer = Tokenizer.from_file(PATH)
    want = defaultdict(int)
    for row in docs.collect():
        ids = tokenizer.encode(row["text"] or "", add_special_tokens=False).ids + [1]
        want[row["doc_id"], np.array(ids, "<u4").tobytes()] += 1
    rows = sorted(pieces.collect(), key=lambda r: (r["sequence_id"], r["offset"]))
    at, stream, got = (0, 0), [], defaultdict(int)
    for r in rows:
        if at[1] == length:
            at = (at[0] + 1, 0)
        assert (r["sequence_id"], r["offset"]) == at
        assert len(r["ids"]) == 4 * r["length"] and r["continues"] == (r["start"] > 0)
        at = (at[0], at[1] + r["length"])
        if r["start"] == 0:
            stream.append([r["doc_id"], b"", r["doc_tokens"]])
        assert stream[-1][0] == r["doc_id"] and len(stream[-1][1]) == 4 * r["start"]
        stream[-1][1] += bytes(r["ids"])
        assert r["continued"] == (len(stream[-1][1]) < 4 * r["doc_tokens"])
    for id_, ids, n in stream:
        assert len(ids) == 4 * n
        got[id_, ids] += 1
    assert got == want


@pytest.mark.parametrize("length", [7, 2048])
def test_odd_rows(docs, length):
    frame = docs("ids")
    check(frame, pack(frame, PATH, length=length), length)


def test_sample_matches_the_tokenizer(sample):
    check(sample, pack(sample, PATH), 2048)


def test_no_end_id_and_empty(docs):
    assert pack(docs().limit(0), PATH).count() == 0
    assert {r[0] for r in pack(docs().where("doc_id in (2, 3, 10)"), PATH, end_id=None).select("doc_id").collect()} == {10}


def test_query(spark):
    import __spark_entry__ as e
    rows = e.queries()["op2_packing"](spark, "/root/testdata/sf0.001").collect()
    tokenizer = Tokenizer.from_file(PATH)
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert {r["doc_id"] for r in rows} == set(text)
    for r in rows:
        ids = tokenizer.encode(text[r["doc_id"]] or "", add_special_tokens=False).ids + [1]
        part = np.array(ids[r["start"]:r["start"] + r["length"]], "<u4").tobytes()
        assert (len(ids), len(part), zlib.crc32(part)) == (r["doc_tokens"], 4 * r["length"], r["ids_crc32"])

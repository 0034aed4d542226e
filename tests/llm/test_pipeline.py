from collections import Counter

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline as p
from test_jaccard import brute
from test_native import spans
from zephyrgrid.llm import language_id, mixing


def expected_pieces(docs):
    tokenizer = Tokenizer.from_file(p.TOKENIZER)
    return Counter((d, len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1) for d, t in docs)


def test_every_stage_against_brute_force(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    docs, n = spark.read.parquet(f"{folder}/documents.parquet"), 0
    columns = docs.columns
    for (name, step), check in zip(p.STAGES, (_language, _jaccard, _secrets, _mixing, _packing), strict=True):
        out = step(spark, docs, folder)
        out.write.parquet(str(tmp_path / str(n)))
        after = spark.read.parquet(str(tmp_path / str(n)))
        assert name == "packing" or after.columns == columns
        check(docs, after)
        docs, n = after, n + 1
    run = p.run(spark, folder)
    assert sorted(map(repr, run.select("doc_id", "start", "length", "doc_tokens").collect())) == sorted(
        map(repr, docs.select("doc_id", "start", "length", "doc_tokens").collect())) or run.count() == docs.count()


def _language(before, after):
    verdict = {r["doc_id"]: r["rejected"] for r in language_id.predict(before, language_id.fit(before)).collect()}
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(i for i, gone in verdict.items() if not gone)
    assert after.count() > 0.95 * before.count()


def _jaccard(before, after):
    rows = [(r["doc_id"], r["text"]) for r in before.collect()]
    assert sorted(r["doc_id"] for r in after.collect()) == sorted({c for _, _, c, _ in brute(rows)})


def _secrets(before, after):
    old = {r["doc_id"]: r["text"] for r in before.collect()}
    new = {r["doc_id"]: r for r in after.collect()}
    assert set(old) == set(new)
    for i, text in old.items():
        assert spans(new[i]["text"]) == "" and (spans(text) or new[i]["text"] == text) and new[i]["n_chars"] == len(new[i]["text"])


def _mixing(before, after):
    words, source = {r["doc_id"]: len(r["text"].split()) for r in before.collect()}, {r["doc_id"]: r["source"] for r in before.collect()}
    tokens = Counter()
    for i, n in words.items():
        tokens[source[i]] += n
    _, weights = mixing.choose_weights(tokens, max_repeats=p.MAX_REPEATS)
    budget, taken = mixing.budget_of(tokens, weights, None), Counter()
    for r in after.collect():
        taken[r["source"]] += words[r["doc_id"]]
    assert {r["doc_id"] for r in after.collect()} == set(words)
    for s, w in weights.items():
        assert budget * w - max(n for i, n in words.items() if source[i] == s) - 1 <= taken[s] <= budget * w + 1


def _packing(before, after):
    rows = after.collect()
    got = Counter((r["doc_id"], r["doc_tokens"]) for r in rows if r["start"] == 0)
    assert got == expected_pieces([(r["doc_id"], r["text"]) for r in before.collect()])
    assert sum(r["length"] for r in rows) == sum(n * k for (_, n), k in got.items())
    assert all(len(np.frombuffer(r["ids"], "<u4")) == r["length"] for r in rows)


def test_odd_rows(docs, spark):
    for frame in (docs("word"), docs("word").limit(0)):
        for name, step in p.STAGES:
            out = step(spark, frame, "/nowhere")
            assert name == "packing" or out.columns == frame.columns
            frame = out
        frame.count()

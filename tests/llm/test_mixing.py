import math
from collections import Counter, defaultdict

import pytest

from zephyrgrid.llm import mixing


def test_exponent_meets_entropy_and_limit():
    tokens = {"a": 9000, "b": 900, "c": 100, "d": 0}
    exponent, weights = mixing.choose_weights(tokens, 0.5, 100.0, 10_000)
    natural, even = mixing.entropy(mixing.weights_at(tokens, 1.0)), math.log(3)
    assert abs(mixing.entropy(weights) - (natural + even) / 2) < 1e-9 and 0 < exponent < 1 and "d" not in weights
    limited, held = mixing.choose_weights(tokens, 0.9, 2.0, 10_000)
    assert limited > exponent and max(10_000 * w / tokens[s] for s, w in held.items()) == pytest.approx(2.0)
    assert mixing.choose_weights({}, 0.5, 2.0, None) == (1.0, {}) and mixing.choose_weights({"d": 0}, 0.5, 2.0, 5) == (1.0, {})


@pytest.mark.parametrize("budget,block", [("total", 500), (None, 100_000), ("total", 100_000)])
def test_realised_tokens(sample, budget, block):
    total = mixing.token_total(sample)
    budget = total if budget else None
    rows = mixing.mix_sources(sample, budget_tokens=budget, block_tokens=block).collect()
    words = {r["doc_id"]: len((r["text"] or "").split()) for r in sample.collect()}
    source = {r["doc_id"]: r["source"] for r in sample.collect()}
    tokens = defaultdict(int)
    for i, n in words.items():
        tokens[source[i]] += n
    _, weights = mixing.choose_weights(tokens, budget=budget)
    whole = mixing.budget_of(tokens, weights, budget)
    taken, epochs = Counter(), defaultdict(set)
    for r in rows:
        assert r["__mix"]["tokens"] == words[r["doc_id"]] and r["__mix"]["epoch"] not in epochs[r["doc_id"]]
        epochs[r["doc_id"]].add(r["__mix"]["epoch"])
        taken[r["source"]] += r["__mix"]["tokens"]
    for s, w in weights.items():
        longest = max(n for i, n in words.items() if source[i] == s)
        quota = int(whole * w + 0.5)
        assert quota - longest <= taken[s] <= quota
    for i, seen in epochs.items():
        assert seen == set(range(len(seen)))  # epochs before the last one are whole
    if budget is None:
        assert set(epochs) == set(words)


def test_odd_rows(docs):
    frame = docs("__key2")
    rows = mixing.mix_sources(frame).collect()
    assert rows[0].__fields__ == [*frame.columns, "__mix"]
    seen = Counter((r["doc_id"], r["text"]) for r in rows if r["__mix"]["epoch"] == 0)
    assert seen == Counter((r["doc_id"], r["text"]) for r in frame.collect())
    assert mixing.mix_sources(frame.limit(0)).count() == 0
    assert mixing.mix_sources(frame.where("doc_id in (2, 3)")).count() == 2


def test_rows_without_tokens_are_part_of_a_cut_epoch(spark):
    rows = [(i, f"a{i} b c d", "big") for i in range(200)] + [(1000 + i, " " * (i % 5) if i % 2 else None, "big") for i in range(100)]
    frame = spark.createDataFrame([*rows, *[(2000 + i, "x y", "small") for i in range(20)]], "doc_id long, text string, source string")
    mixed = mixing.mix_sources(frame, budget_tokens=400, block_tokens=50).where("source = 'big'").collect()
    with_tokens = [r for r in mixed if r["doc_id"] < 1000]
    assert 0 < len(with_tokens) < 200 and {r["__mix"]["epoch"] for r in mixed} == {0}
    assert sorted(r["doc_id"] for r in mixed if r["doc_id"] >= 1000) == list(range(1000, 1100))

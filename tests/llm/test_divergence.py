import re
from collections import Counter, defaultdict

import pytest

import __spark_entry__ as e
from compare import compare, duck
from zephyrgrid.llm.divergence import audit, collapse

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_docs, top):
    df, n, groups = Counter(), Counter(), set()
    for row in rows:
        lang, source = row["lang"] or "", row["source"] or ""
        groups.add((lang, source))
        found = TERM.findall((row["text"] or "").translate(LOWER))
        n.update((lang, source, t) for t in found)
        df.update((lang, t) for t in set(found))
    kept = defaultdict(list)
    for (lang, t), k in df.items():
        if k >= min_docs:
            kept[lang].append(t)

    def weights(lang, count):
        total, v = sum(count(t) for t in kept[lang]), len(kept[lang])
        return {t: 1 + 1000000000 * (count(t) + 2) // (total + 2 * v) for t in kept[lang]}

    f = lambda p, q: (p - q) ** 2 // (p + q)
    p = {(lang, s): weights(lang, lambda t, lang=lang, s=s: n[lang, s, t]) for lang, s in groups}
    out = []
    for lang, s in groups:
        q = weights(lang, lambda t: sum(n[lang, o, t] for la, o in groups if la == lang))
        own = p[lang, s]
        pairs = [(sum(f(own[t], p[lang, o][t]) for t in own), o) for la, o in groups if la == lang and o != s]
        terms = [(f(own[t], q[t]), t) for t in own if n[lang, s, t] > 0 and own[t] > q[t]]
        for part, items, most in (("pair", pairs, None), ("term", terms, top)):
            for rank, (value, item) in enumerate(sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                out.append((lang, s, part, item, value, rank))
    return sorted(out)


@pytest.mark.parametrize("min_docs", [1, 2, 10])
def test_odd_rows(docs, min_docs):
    frame = docs("term")
    got = sorted(tuple(r) for r in audit(frame, min_docs=min_docs, top_terms=3).collect())
    assert got == brute([r.asDict() for r in frame.collect()], min_docs, 3)


def test_hot_copies(spark):
    rows = [("same Text of many COPIES", "en", f"s{i % 3}") for i in range(300)] + [(f"text number {'abc'[i % 3]} of ten", "en", "s1") for i in range(40)]
    frame = spark.createDataFrame(rows, "text string, lang string, source string").repartition(5)
    assert {tuple(sorted((s["source"], s["copies"]) for s in r["sources"])) for r in collapse(frame).collect()} >= {(("s0", 100), ("s1", 100), ("s2", 100))}
    assert collapse(frame).count() == 4
    assert sorted(tuple(r) for r in audit(frame).collect()) == brute([r.asDict() for r in frame.collect()], 10, 10)


def test_large_counts(spark):
    rows = [("word " * 200_000 + "other", "en", "a"), ("other word", "en", "b")]
    frame = spark.createDataFrame(rows, "text string, lang string, source string")
    assert sorted(tuple(r) for r in audit(frame, min_docs=1).collect()) == brute([r.asDict() for r in frame.collect()], 1, 10)


def test_empty(docs):
    assert audit(docs().limit(0)).count() == 0


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    problem, rows = compare(spark, duck(folder), "op13", e.queries()["op13_divergence"], e.oracle_sql()["op13_divergence"], folder)
    assert problem is None and rows > 0, problem

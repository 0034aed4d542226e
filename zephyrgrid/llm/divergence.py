"""Divergence of the sources of a language by duplicate-text collapse (operator 13).

Identical texts of a language become one text with a multiplicity per source; each is cut into terms once, and its counts
and document frequencies are weighted by the multiplicities. Two sources are compared on the terms that both hold; what a
term adds where only one of them, or neither, has it depends on its count alone and is added up from histograms of counts.
All arithmetic is in whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .encoding import released
from .text import bounded_batches, whole

MIN_DOCS = 10
TOP_TERMS = 10
SCALE = 1_000_000_000
HELD_ROWS = 500_000
# A-Z in lower case, every other ASCII character but a-z a space; bytes of longer characters stay.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def collapse(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Each different text of a language once: lang, text, sources (source, copies). Nulls count as empty.

    Multiplicities are counted by digest; texts combine map-side and are shuffled once, however many copies there are.
    """
    rows = docs.select(whole(F.col(lang).cast("string")).alias("lang"), whole(F.col(source).cast("string")).alias("source"), whole(text).alias("text"))
    known = rows.withColumn("h", F.coalesce(F.sha2("text", 256), F.lit("")))  # never null, and Spark then need not ask
    copies = known.groupBy("lang", "h", "source").agg(F.count("*").alias("copies"))
    # As many entries as a text has different sources.
    sources = copies.groupBy("lang", "h").agg(F.collect_list(F.struct("source", "copies")).alias("sources"))
    texts = known.groupBy("lang", "h").agg(F.first("text").alias("text"))
    return texts.join(sources, ["lang", "h"]).select("lang", "text", "sources")


def _terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Text and term (as a number) of every occurrence, and the terms."""
    texts = texts.cast(pa.string())
    _, offsets, data = texts.buffers()
    places = np.frombuffer(offsets, dtype=np.int32)[texts.offset:texts.offset + len(texts) + 1]
    flat = bytes(memoryview(data)[places[0]:places[-1]]).translate(TABLE) if data is not None else b""
    spaced = pa.Array.from_buffers(pa.string(), len(texts), [None, pa.py_buffer((places - places[0]).tobytes()), pa.py_buffer(flat)])
    split = pc.split_pattern(spaced, " ")
    words = split.flatten().dictionary_encode()
    row = np.repeat(np.arange(len(texts), dtype=np.int64), np.diff(np.asarray(split.offsets)))
    term = np.asarray(words.indices)
    empty = pc.index(words.dictionary, "").as_py()
    if empty >= 0:
        kept = term != empty
        row, term = row[kept], term[kept]
    return row, term, words.dictionary


def _sum_by(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys and the sums of their values, in whole numbers."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], *[np.add.reduceat(v[order], first) for v in values]


def count_terms(collapsed: DataFrame) -> DataFrame:
    """Occurrences and documents of each term: lang, source, term, n, docs.

    Tasks add up their own batches, some ``HELD_ROWS`` sums at a time; what is left is dealt by language and term, so that
    sums by source and by language need no other shuffle.
    """
    schema = "lang string, source string, term string, n long, docs long"
    keys, sums = ["lang", "source", "term"], [("n", "sum"), ("docs", "sum")]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, term, terms = _terms(batch.column(1))
            if not len(row):
                continue
            width = len(terms)
            pair, times = _sum_by(row * width + term, np.ones(len(row), dtype=np.int64))
            row, term = np.divmod(pair, width)
            # Groups of the batch, and each text's groups one after another.
            lists = batch.column(2)
            per_text = np.diff(np.asarray(lists.offsets))
            entries = lists.flatten()
            names = list(zip(pc.take(batch.column(0), pa.array(np.repeat(np.arange(len(per_text)), per_text))).to_pylist(), entries.field("source").to_pylist()))
            number: dict[tuple, int] = {}
            group = np.array([number.setdefault(name, len(number)) for name in names], dtype=np.int64)
            copies = np.asarray(entries.field("copies"))
            many = per_text[row]
            entry = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat((np.cumsum(per_text) - per_text)[row], many)
            found, n, docs = _sum_by(group[entry] * width + np.repeat(term, many), copies[entry] * np.repeat(times, many), copies[entry])
            group, term = np.divmod(found, width)
            names = list(number)
            yield pa.RecordBatch.from_arrays([
                pa.array([x[0] for x in names], pa.string()).take(pa.array(group)), pa.array([x[1] for x in names], pa.string()).take(pa.array(group)),
                terms.take(pa.array(term)), pa.array(n), pa.array(docs)], names=["lang", "source", "term", "n", "docs"])

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for part in count(batches):
            held, rows = [*held, part], rows + part.num_rows
            if rows > HELD_ROWS:
                yield from add_up(held)
                held, rows = [], 0
        if held:
            yield from add_up(held)

    def add_up(parts: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
        added = pa.Table.from_batches(parts).group_by(keys, use_threads=False).aggregate(sums)
        return added.rename_columns({"n_sum": "n", "docs_sum": "docs"}).select([*keys, "n", "docs"]).to_batches(max_chunksize=50_000)

    parts = bounded_batches(collapsed).select("lang", "text", "sources").mapInArrow(run, schema).repartition("lang", "term")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _p(count: Column, total: Column, terms: Column) -> Column:
    """Smoothed share of a term in billionths, one at least; products can pass 64 bits. Null without any kept term."""
    return F.when(terms > 0, F.lit(1) + F.call_function("div", (count + 2).cast("decimal(28,0)") * F.lit(SCALE), total + terms * 2))


def _f(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """Divergence of every source of a language from each other one and its terms above the language's share:
    lang, source, part (``pair`` or ``term``), item, value, rank.

    * Terms are runs of ASCII letters and characters beyond ASCII; a language keeps those in at least ``min_docs`` of its
      documents, copies counted each. A term's weight in a group is p = 1 + floor(1e9 (n + 2) / (N + 2 V)); two weights
      differ by floor((p - q)^2 / (p + q)).
    * ``pair``: the sum over all kept terms, for every other source of the language, ranked from the most distant; 0 where the
      language keeps no term. ``term``: the ``top_terms`` terms the group holds and has more of than the language.
    * Null text, language and source count as empty. Groups without terms take part; a language of one source has no pair.
      Ties go by item. Repeated rows count each; very long texts are cut whole; an empty table gives an empty result; other
      columns are not read, whatever their names.
    * The result has a row per ordered pair of a language's sources. Only pairs that share a term meet in the join.
    """
    rows = docs.select(whole(F.col(lang).cast("string")).alias("lang"), whole(F.col(source).cast("string")).alias("source"))
    counts = count_terms(collapse(docs, text, lang, source))
    spread = Window.partitionBy("lang", "term")
    kept = stage(counts.withColumn("df", F.sum("docs").over(spread)).where(F.col("df") >= min_docs).select("lang", "source", "term", "n"), "kept-terms")

    terms = kept.select("lang", "term").distinct().groupBy("lang").agg(F.count("*").alias("v"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = rows.distinct().join(totals, ["lang", "source"], "left").join(terms, "lang", "left").na.fill(0, ["total", "v"])
    groups = stage(groups.withColumn("p0", _p(F.lit(0), F.col("total"), F.col("v"))), "groups")
    weighed = kept.join(groups, ["lang", "source"]).withColumn("p", _p(F.col("n"), F.col("total"), F.col("v")))

    # What a group's own terms add against another's empty weight, by count.
    histogram = weighed.groupBy("lang", "source", "p").agg(F.count("*").alias("m"))
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    against = groups.select("lang", "source", "p0", "v").join(other, "lang").where("source <> item")
    alone = histogram.join(against.drop("v"), ["lang", "source"]).groupBy("lang", "source", "item").agg(
        F.sum(F.col("m") * (_f("p", "q0") - _f("p0", "q0"))).alias("alone"))
    held = weighed.select("lang", "term", "source", "p", "p0")
    theirs = held.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("p0").alias("q0"))
    both = held.join(theirs, ["lang", "term"]).where("source < item").groupBy("lang", "source", "item").agg(
        F.sum(_f("p", "q") - _f("p", "q0") - _f("p0", "q") + _f("p0", "q0")).alias("both"))
    both = stage(both, "shared-terms")
    both = both.unionByName(both.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "both"))
    alone = stage(alone, "own-terms")
    turned = alone.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("alone").alias("turned"))
    keys = ["lang", "source", "item"]
    sums = against.join(alone, keys, "left").join(turned, keys, "left").join(both, keys, "left").na.fill(0, ["alone", "turned", "both"])
    value = F.coalesce(F.col("v") * _f("p0", "q0"), F.lit(0)) + F.col("alone") + F.col("turned") + F.col("both")
    pairs = sums.select("lang", "source", F.lit("pair").alias("part"), "item", value.cast("long").alias("value"))

    overall = kept.groupBy("lang", "term").agg(F.sum("n").alias("n")).join(
        groups.groupBy("lang").agg(F.sum("total").alias("total"), F.max("v").alias("v")), "lang")
    overall = overall.select("lang", "term", _p(F.col("n"), F.col("total"), F.col("v")).alias("q"))
    more = weighed.select("lang", "source", "term", "p").join(overall, ["lang", "term"]).where("p > q")
    tops = more.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _f("p", "q").alias("value"))

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order))
    return ranked(pairs).unionByName(ranked(tops).where(F.col("rank") <= top_terms))

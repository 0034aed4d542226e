"""Host-level quality rules (operator 9).

Every text is measured inside its row. Failures of each rule are summed by host, the rates are shrunk towards the corpus
rate with a beta prior fitted to the hosts by moments, and hosts whose shrunk rate passes the limit are joined back to
their documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .text import SPACE, SPACE_CHARS, whole, words_of

# Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
WINDOW = 3

# Limits of the host rules: a document fails a rule, a host fails when its shrunk failure rate passes MAX_RATE.
MAX_SYMBOLS_PER_WORD = 0.5
MAX_DUP_LINES_PER_WORD = 0.05
WORD_CHARS_RANGE = (2.0, 15.0)
MAX_RATE = 0.6
STRENGTH = (2.0, 1000.0)
RULES = ("base", "symbols", "lines", "lengths")


def bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def repeat_words(words: Column) -> Column:
    """Words inside windows of three that the text holds twice or more.

    Windows are hashed and sorted with their positions; a window is repeated when a neighbour in that order has its hash.
    Of the repeated positions, in order, each covers up to three words that the next one does not.
    """
    none = F.lit(0).cast("long")

    def repeated(ranked: Column) -> Column:
        return F.sort_array(F.array_compact(F.transform(ranked, lambda x, j: F.when(
            (x["h"] == F.get(ranked, j - 1)["h"]) | (x["h"] == F.get(ranked, j + 1)["h"]), x["i"]))))

    def covered(at: Column) -> Column:
        widths = F.transform(at, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(at, j + 1) - x, F.lit(WINDOW))))
        return F.aggregate(widths, none, lambda a, x: a + x)

    def count(hashes: Column) -> Column:
        ranked = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), none).otherwise(
            bind(ranked, lambda r: bind(repeated(r), covered)))

    starts = F.sequence(F.lit(0), F.size(words) - WINDOW)
    hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))
    return F.when(F.size(words) > WINDOW, bind(hashes, count)).otherwise(none)


def measures(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text (not null)."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(f"[^{SPACE}]"))
    return bind(words_of(text), lambda words: F.struct(
        F.size(words).cast("long").alias("n_words"),
        F.length(F.translate(text, SPACE_CHARS, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeat_words(words).alias("n_repeat_words")))


def failures() -> dict[str, Column]:
    """A document's failure of each rule, over its measures."""
    low, high = WORD_CHARS_RANGE
    return {
        "base": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
        "symbols": F.col("n_symbols") > MAX_SYMBOLS_PER_WORD * F.col("n_words"),
        "lines": F.col("n_dup_lines") > MAX_DUP_LINES_PER_WORD * F.col("n_words"),
        "lengths": (F.col("n_words") > 0) & ~F.col("word_chars").between(low * F.col("n_words"), high * F.col("n_words")),
    }


def host_verdicts(measured: DataFrame, host: str = "host", max_rate: float = MAX_RATE) -> DataFrame:
    """One row per host: its documents, the failures and shrunk rate of each rule, and host_ok.

    The prior of a rule has the corpus rate m as its mean; its strength m (1 - m) / v - 1 comes from the variance v of the
    hosts' rates weighted by their documents, held within ``STRENGTH`` (the upper end when the hosts do not differ).
    """
    sums = measured.groupBy(host).agg(F.count("*").alias("docs"), *[F.sum(F.col(f"fails_{r}").cast("long")).alias(f"n_{r}") for r in RULES])
    sums = stage(sums, "hosts")
    means = sums.agg(*[(F.sum(f"n_{r}") / F.sum("docs")).alias(r) for r in RULES]).first()
    mean = {r: F.lit(means[r]).cast("double") for r in RULES}
    spread = sums.agg(*[(F.sum(F.col("docs") * F.pow(F.col(f"n_{r}") / F.col("docs") - mean[r], F.lit(2))) / F.sum("docs")).alias(r)
                        for r in RULES]).first()
    out = sums
    for r in RULES:
        m, v = mean[r], F.lit(spread[r]).cast("double")
        strength = F.when(v > 0, F.greatest(F.lit(STRENGTH[0]), F.least(F.lit(STRENGTH[1]), m * (1 - m) / v - 1))).otherwise(F.lit(STRENGTH[1]))
        out = out.withColumn(f"rate_{r}", (F.col(f"n_{r}") + strength * m) / (F.col("docs") + strength))
    worst = F.greatest(*[F.col(f"rate_{r}") for r in RULES])
    return out.select(host, "docs", *[f"n_{r}" for r in RULES], *[f"rate_{r}" for r in RULES], worst.alias("worst_rate"),
                      (worst <= max_rate).alias("host_ok"))


def judge_documents(docs: DataFrame, id: str = "doc_id", text: str = "text", host: str = "source", max_rate: float = MAX_RATE) -> DataFrame:
    """Measures and verdict of every row: id, the five measures, base_failed, kept, host, host_rate.

    * A document is kept when it passes the base rules and its host's shrunk failure rates stay within ``max_rate``.
    * A null text has no words and fails. Rows of a null host form one host. Repeated rows are judged and counted one by
      one; an empty table gives an empty result. Other columns are not read, whatever their names.
    * Memory: a row at a time; hosts are summed map-side, so a host with a third of all rows costs no more than another.
    """
    rows = docs.select(F.col(id).alias("__id"), F.col(host).alias("host"), measures(whole(text)).alias("m")).select("__id", "host", "m.*")
    fails = failures()
    measured = stage(rows.withColumns({f"fails_{r}": fails[r] for r in RULES}), "measures")
    hosts = host_verdicts(measured, "host", max_rate).select(F.col("host").alias("__host"), "worst_rate", "host_ok")
    hosts = stage(hosts, "verdicts")
    joined = measured.join(hosts, measured.host.eqNullSafe(hosts["__host"]), "left")
    return joined.select(
        F.col("__id").alias(id), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        F.col("fails_base").alias("base_failed"), (~F.col("fails_base") & F.col("host_ok")).alias("kept"),
        "host", F.round("worst_rate", 6).alias("host_rate"))

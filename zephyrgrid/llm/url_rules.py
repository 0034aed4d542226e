"""URL filter by host-suffix and path-prefix expressions (operator 5).

Every URL is expanded into the expressions that a rule could have: a suffix of its host with as many labels as some
rule's host, followed by a prefix of its path as long as some rule's path. Expressions and rules meet in an equi-join on
the first hexadecimal digits of their SHA-256; the full digest and the strings confirm a meeting. Of the confirmed rules
the longest one wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .text import ascii_lower

HASH_PREFIX = 8
MAX_SHAPES = 1024


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or a URL without ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def _labels(host: Column) -> Column:
    return F.size(F.split(host, r"\.", -1))


def prepare_rules(rules: DataFrame) -> DataFrame:
    """Rules (host, path, verdict) with their digests; a null or empty host fits nothing, a null path is empty.

    Of rules with equal host and path, ``block`` wins.
    """
    clean = rules.select(ascii_lower(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"),
                         F.lower(F.col("verdict")).alias("verdict")).where("host <> '' and verdict in ('allow', 'block')")
    return clean.groupBy("host", "path").agg(F.max("verdict").alias("verdict")).withColumns({
        "rule": F.concat("host", "path"), "labels": _labels(F.col("host")), "path_length": F.length("path"),
        "digest": F.sha2(F.concat("host", "path"), 256),
    }).withColumn("short", F.substring("digest", 1, HASH_PREFIX))


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", keep: tuple[str, ...] = ("page_id",),
               default: str = "allow") -> DataFrame:
    """Verdict of every page: the columns ``keep``, host, path, rule, verdict and matched_rules.

    * A rule fits its host and all subdomains when the path starts with the rule's path. The longest rule (host and path
      together) wins; among equally long ones the longer host. Without a rule: rule null, verdict ``default``.
    * Null URLs, URLs without ``://`` and empty URLs have empty host and path. Repeated rows are judged one by one; an
      empty table gives an empty result; no rule at all gives the default. Other columns of ``pages`` are not read.
    * Expressions grow with the distinct shapes (labels, path length) of rules, of which at most 1,024 are allowed;
      a rule book with more is refused. URLs are made distinct before they are expanded, so a hot URL counts once.
    """
    host, path = host_and_path(F.col(url))
    seen = pages.select(*keep, host.alias("__host"), path.alias("__path"))
    book = prepare_rules(rules)
    shapes = [(r[0], r[1]) for r in book.select("labels", "path_length").distinct().limit(MAX_SHAPES + 1).collect()]
    if len(shapes) > MAX_SHAPES:
        raise ValueError(f"more than {MAX_SHAPES} shapes of rules")
    best = stage(_winning(seen.select("__host", "__path").distinct(), book, shapes), "urls")
    joined = seen.join(best, ["__host", "__path"], "left")
    return joined.select(*keep, F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__best.rule").alias("rule"),
                         F.coalesce("__best.verdict", F.lit(default)).alias("verdict"),
                         F.coalesce("__matched", F.lit(0)).alias("matched_rules"))


def _winning(urls: DataFrame, book: DataFrame, shapes: list[tuple[int, int]]) -> DataFrame:
    """The best rule of every distinct (host, path) that any rule fits."""
    labels = F.split(F.col("__host"), r"\.", -1)
    expressions = [
        F.when((F.size(labels) >= k) & (F.length("__path") >= n),
               F.struct(F.array_join(F.slice(labels, -k, k), ".").alias("host"), F.substring("__path", 1, n).alias("path")))
        for k, n in shapes]
    if not expressions:
        expressions = [F.struct(F.lit("").alias("host"), F.lit("").alias("path"))]
    tried = urls.withColumn("__try", F.explode(F.array_compact(F.array(*expressions)))).withColumn(
        "__digest", F.sha2(F.concat("__try.host", "__try.path"), 256))
    met = tried.join(book, F.substring("__digest", 1, HASH_PREFIX) == F.col("short"))
    sure = met.where((F.col("__digest") == F.col("digest")) & (F.col("__try.host") == F.col("host"))
                     & (F.col("__try.path") == F.col("path")))
    order = F.struct(F.length("rule").alias("long"), F.length("host").alias("host_length"), "rule", "verdict")
    return sure.groupBy("__host", "__path").agg(F.max(order).alias("__best"), F.count("*").cast("int").alias("__matched"))

"""Secret scan with corpus-wide ownership frequency (operator 7).

Patterns give spans of certain kinds. Less certain candidates (long mixed tokens) are hashed and counted by the distinct
owners and repositories that hold them: a value that many owners share is a copied example, one that stays with few
owners looks like a live credential and becomes a span as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .text import whole

# The base kinds, in the order in which equal starts are listed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
BASE = ("assign", "access", "hex")
ASSIGN_LENGTH = 8

# Candidates that ownership decides on: tokens of 24 or more characters with upper case, lower case and digits.
MIXED = r"[A-Za-z0-9+/_-]{24,}"
MAX_OWNERS = 3
MAX_REPOSITORIES = 50
MARK = "[SECRET]"
SPAN = "array<struct<start:int,rank:int,end:int,kind:string,value:string>>"


def spans_of(text: Column, pattern: str, kind: str, rank: int, value: Column | None = None) -> Column:
    """All leftmost matches of a pattern that do not overlap, with their places in code points (end exclusive).

    The pieces between the matches come from splitting the text by the same pattern; places are running lengths. They are
    summed in runs of about the square root of the number of matches, so that no array is copied once a match.
    """
    matches, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    pairs = F.zip_with(F.slice(gaps, 1, F.size(matches)), matches, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("size"), m.alias("match")))
    run = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(matches)))).cast("int")
    runs = F.transform(F.sequence(F.lit(0), F.ceil(F.size(matches) / run).cast("int") - 1), lambda k: F.slice(pairs, k * run + 1, run))
    total = lambda r: F.aggregate(r, F.lit(0), lambda acc, p: acc + p["gap"] + p["size"])
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    starts = F.aggregate(runs, first, lambda acc, r: F.struct((acc["at"] + total(r)).alias("at"), F.concat(acc["starts"], F.array(acc["at"])).alias("starts")),
                         lambda acc: acc["starts"])

    def step(acc: Column, pair: Column) -> Column:
        start = acc["at"] + pair["gap"]
        end = start + pair["size"]
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), pair["match"].alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    def spans(r: Column, start: Column) -> Column:
        return F.aggregate(r, F.struct(start.alias("at"), F.array().cast(SPAN).alias("out")), step, lambda acc: acc["out"])

    return F.when(F.size(matches) > 0, F.flatten(F.zip_with(runs, starts, spans))).otherwise(F.array().cast(SPAN))


def base_spans(text: Column) -> Column:
    """Spans of the base kinds by start and kind; assignments need a value of eight characters or more."""
    assigned = F.filter(spans_of(text, ASSIGN, "assign", 0),
                        lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 2)) >= ASSIGN_LENGTH)
    return F.sort_array(F.concat(assigned, spans_of(text, ACCESS, "access", 1), spans_of(text, HEX, "hex", 2)))


def candidate_spans(text: Column) -> Column:
    """Long tokens with upper case, lower case and digits."""
    return F.filter(spans_of(text, MIXED, "owned", 3),
                    lambda s: s["value"].rlike("[a-z]") & s["value"].rlike("[A-Z]") & s["value"].rlike("[0-9]"))


def listed(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def ownership(found: DataFrame, max_owners: int = MAX_OWNERS, max_repositories: int | None = MAX_REPOSITORIES) -> DataFrame:
    """Per value hash: distinct owners and repositories, and whether it looks live (few of both; of owners alone where
    ``max_repositories`` is None).

    ``found`` has value_hash, owner, repository. Pairs are made distinct map-side first, so a value that a third of all
    rows repeat costs one row per task, owner and repository.
    """
    by_owner = found.groupBy("value_hash", "owner", "repository").agg(F.count("*").alias("n")).groupBy("value_hash", "owner").agg(
        F.count("*").alias("repositories"), F.sum("n").alias("n"))
    sums = by_owner.groupBy("value_hash").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"), F.sum("n").alias("uses"))
    few = F.col("owners") <= max_owners
    return sums.withColumn("live", few if max_repositories is None else few & (F.col("repositories") <= max_repositories))


def scan_secrets(docs: DataFrame, id: str = "doc_id", text: str = "text", owner: str = "source", repository: str | None = None,
                 max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES, count_inside: bool = True) -> DataFrame:
    """Spans of every row: id, text_hash, base and spans (arrays of start, rank, end, kind, value), examples (candidates left).

    * ``repository`` names the column of repositories; without one owners alone decide, however many rows of few owners
      hold a value. A null owner or repository counts as one owner or repository of its own.
    * Candidates that overlap a base span are left to it, but their owners count as uses of the value (not so with
      ``count_inside`` False). Of the others the live-looking ones join the base spans.
    * A null text is an empty one and has no spans. Rows of equal id and text share their result and each keep a row; an
      empty table gives an empty result. Other columns are not read.
    """
    value = whole(text)
    overlaps = lambda c: F.exists(F.col("base"), lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
    outside, inside = F.filter(F.col("found"), lambda c: ~overlaps(c)), F.filter(F.col("found"), overlaps)
    rows = docs.select(F.col(id).alias("__id"), F.col(owner).alias("owner"), (F.col(repository) if repository else F.lit(None)).cast("string").alias("repository"),
                       F.xxhash64(value).alias("text_hash"), base_spans(value).alias("base"), candidate_spans(value).alias("found"))
    inside = F.transform(inside, lambda c: c["value"]) if count_inside else F.array().cast("array<string>")
    rows = stage(rows.withColumns({"found": outside, "inside": inside}), "spans")
    loose = rows.where(F.size("found") > 0).select("__id", "text_hash", "owner", "repository", F.explode("found").alias("span")).withColumn(
        "value_hash", F.sha2("span.value", 256))
    uses = loose.select("value_hash", "owner", "repository")
    if count_inside:
        inner = rows.where(F.size("inside") > 0).select("owner", "repository", F.explode("inside").alias("value"))
        uses = uses.unionByName(inner.select(F.sha2("value", 256).alias("value_hash"), "owner", "repository"))
    owned = stage(ownership(uses, max_owners, max_repositories if repository else None), "owners")
    judged = loose.select("__id", "text_hash", "span", "value_hash").distinct().join(owned, "value_hash")
    judged = stage(judged.groupBy("__id", "text_hash").agg(
        F.collect_list(F.when(F.col("live"), F.col("span"))).alias("live"), F.sum(F.when(F.col("live"), 0).otherwise(1)).alias("examples")), "live")
    judged = judged.withColumnsRenamed({"__id": "__same", "text_hash": "__text"})
    joined = rows.join(judged, rows["__id"].eqNullSafe(judged["__same"]) & (rows.text_hash == judged["__text"]), "left")
    none = F.array().cast(SPAN)
    return joined.select(F.col("__id").alias(id), "text_hash", "base", F.sort_array(F.concat("base", F.coalesce("live", none))).alias("spans"),
                         F.coalesce("examples", F.lit(0)).cast("long").alias("examples"))


def redact(text: Column, spans: Column, mark: str = MARK) -> Column:
    """The text with every span replaced by a mark; overlapping spans share one."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, span: Column) -> Column:
        fresh = span["start"] >= acc["at"]
        before = F.substring(text, acc["at"] + 1, span["start"] - acc["at"])
        return F.struct(F.greatest(acc["at"], span["end"]).alias("at"),
                        F.when(fresh, F.concat(acc["out"], before, F.lit(mark))).otherwise(acc["out"]).alias("out"))

    rest = lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(F.sort_array(spans), start, step, rest)).otherwise(text)


def redact_documents(docs: DataFrame, id: str = "doc_id", text: str = "text", owner: str = "source", count: str | None = "n_chars",
                     mark: str = MARK) -> DataFrame:
    """All rows with their columns as they are, every span of the text replaced by a mark and the characters counted anew.

    Texts without spans and null texts stay untouched.
    """
    columns = [f"c{i}" for i in range(len(docs.columns))]
    at = {name: f"c{i}" for i, name in enumerate(docs.columns)}
    found = scan_secrets(docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text"), F.col(f"`{owner}`").alias("owner")), "id", "text", "owner")
    found = stage(found.where(F.size("spans") > 0).select(F.col("id").alias("key"), F.col("text_hash").alias("hash"), "spans").dropDuplicates(["key", "hash"]), "found")
    plain = docs.toDF(*columns)
    joined = plain.join(found, F.col(at[id]).eqNullSafe(F.col("key")) & (F.xxhash64(whole(at[text])) == F.col("hash")), "left")
    fresh = F.when(F.col("spans").isNotNull(), redact(F.col(at[text]), F.col("spans"), mark)).otherwise(F.col(at[text]))
    joined = joined.withColumn("fresh", fresh)
    new = {at[text]: F.col("fresh")}
    if count in at:
        kind = dict(plain.dtypes)[at[count]]
        new[at[count]] = F.when(F.col("spans").isNotNull(), F.length("fresh").cast(kind)).otherwise(F.col(at[count]))
    return joined.withColumns(new).select(*columns).toDF(*docs.columns)

"""Temperature mixing of sources (operator 4).

Token shares p of the sources are raised to an exponent in [0, 1] and normalised. The exponent is bisected for a target
entropy and held where no source repeats more often than a limit. Each source then gives its share of the token budget:
whole epochs, and of one more epoch the first blocks of a permutation, the last of them up to the budget.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import stage
from .text import SPACE, whole

BLOCK_TOKENS = 100_000
MAX_SOURCES = 100_000
EVENNESS = 0.5
MAX_REPEATS = 4.0


def weights_at(tokens: dict, exponent: float) -> dict:
    """Normalised weights at an exponent; sources without tokens weigh nothing."""
    total = sum(tokens.values())
    raised = {s: (n / total) ** exponent for s, n in tokens.items() if n > 0}
    scale = math.fsum(raised.values())
    return {s: x / scale for s, x in raised.items()}


def entropy(weights: dict) -> float:
    return -math.fsum(w * math.log(w) for w in weights.values() if w > 0)


def budget_of(tokens: dict, weights: dict, budget: int | None) -> int:
    """The given budget, or the smallest at which every source is seen whole at least once."""
    return budget if budget is not None else math.ceil(max((tokens[s] / w for s, w in weights.items()), default=0))


def most_repeats(tokens: dict, weights: dict, budget: int | None) -> float:
    whole_budget = budget_of(tokens, weights, budget)
    return max((whole_budget * w / tokens[s] for s, w in weights.items()), default=0.0)


def bisect_exponent(holds, steps: int = 60) -> float:
    """The smallest exponent in [0, 1] at which ``holds``, which is false below some exponent and true above it (or true at 1 only)."""
    if holds(0.0):
        return 0.0
    low, high = 0.0, 1.0
    for _ in range(steps):
        middle = (low + high) / 2
        low, high = (low, middle) if holds(middle) else (middle, high)
    return high


def choose_weights(tokens: dict, evenness: float = EVENNESS, max_repeats: float = MAX_REPEATS, budget: int | None = None) -> tuple[float, dict]:
    """Exponent and weights. The target entropy lies ``evenness`` of the way from the natural one to that of equal weights."""
    natural, even = entropy(weights_at(tokens, 1.0)) if any(tokens.values()) else 0.0, math.log(max(1, sum(n > 0 for n in tokens.values())))
    target = natural + evenness * (even - natural)
    if not any(tokens.values()):
        return 1.0, {}
    by_entropy = bisect_exponent(lambda a: entropy(weights_at(tokens, a)) <= target + 1e-12)
    by_limit = bisect_exponent(lambda a: most_repeats(tokens, weights_at(tokens, a), budget) <= max_repeats + 1e-12)
    exponent = max(by_entropy, by_limit)
    return exponent, weights_at(tokens, exponent)


def token_count(value: Column) -> Column:
    """Words of a text (not null)."""
    return F.regexp_count(value, F.lit(f"[^{SPACE}]+")).cast("long")


def token_total(docs: DataFrame, text: str = "text") -> int:
    """Words of all texts."""
    return int(docs.agg(F.sum(token_count(whole(text)))).first()[0] or 0)


def _order(*parts: Column | str | int) -> Column:
    return F.xxhash64(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def mix_sources(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", evenness: float = EVENNESS,
                max_repeats: float = MAX_REPEATS, budget_tokens: int | None = None, block_tokens: int = BLOCK_TOKENS, seed: int = 0) -> DataFrame:
    """The rows of ``docs``, each as often as the mixture takes it, with __mix (struct of tokens, epoch, block, block_rank, weight).

    * Tokens are words between white space; a null text has none. Rows without tokens are part of every epoch, also of one
      that is cut; a source without any token gives one epoch. A null source is a source of its own.
    * Sources are taken ``floor(quota / tokens)`` times whole. The blocks of the epoch after that come in an order of
      their own; rows of the block where the quota ends come in hashed order while they fit, so the realised tokens fall
      short of the quota by less than that block's next row. Rows of equal id and text stand or fall together.
    * ``budget_tokens`` None takes the smallest budget at which no source is cut. An empty table gives an empty result.
      Other columns are kept, whatever their names; ``__mix`` must not be one of them.
    * The driver holds one row per source (at most 100,000). A source of any size is dealt over blocks by a hash; texts
      are never shuffled: what decides on a row is its own hash and its source's thresholds.
    """
    spark = docs.sparkSession
    value = whole(F.col(f"`{text}`"))
    key, tokens = _order(seed, F.col(f"`{id}`").cast("string"), value), token_count(value)
    slim = stage(docs.select(F.col(f"`{source}`").cast("string").alias("source"), tokens.alias("n"), key.alias("key")), "mix")
    found = slim.groupBy("source").agg(F.sum("n").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    totals = {r["source"]: int(r["n"]) for r in found}
    exponent, weights = choose_weights(totals, evenness, max_repeats, budget_tokens)
    budget = budget_of(totals, weights, budget_tokens)
    plan = []
    for name, total in totals.items():
        quota = min(int(budget * weights[name] + 0.5), int(max_repeats * total + 0.5)) if name in weights else 0
        whole_epochs, rest = divmod(quota, total) if total else (1, 0)
        plan.append((name, whole_epochs, rest, max(1, -(-total // block_tokens)), weights.get(name, 0.0)))
    plan = spark.createDataFrame(plan, "source string, epochs long, rest long, blocks long, weight double")
    same = lambda left, right: left["source"].eqNullSafe(right["source"])
    block = lambda key, blocks: F.pmod(_order(seed, key), blocks)
    turn = lambda epoch, name, block: _order(seed, epoch, F.coalesce(name, F.lit("")), block)

    dealt = slim.join(plan, same(slim, plan)).drop(plan["source"]).where("rest > 0").withColumn("block", block(F.col("key"), F.col("blocks")))
    dealt = dealt.withColumn("turn", turn(F.col("epochs"), F.col("source"), F.col("block")))
    sums = dealt.groupBy("source", "turn").agg(F.sum("n").alias("size"), F.first("rest").alias("rest"))
    upto = Window.partitionBy("source").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = sums.withColumn("end", F.sum("size").over(upto)).where("end > rest and end - size <= rest").select(
        F.col("source").alias("__s"), F.col("turn").alias("edge"), (F.col("rest") - F.col("end") + F.col("size")).alias("left"))
    edge = stage(edge, "edges")
    inside = dealt.join(edge, dealt["source"].eqNullSafe(edge["__s"]) & (dealt["turn"] == edge["edge"])).groupBy("source", "edge", "left", "key").agg(F.sum("n").alias("n"))
    upto = Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = inside.withColumn("end", F.sum("n").over(upto)).where("end <= left").groupBy("source").agg(F.max("key").alias("last"))
    last = last.withColumnRenamed("source", "__l")
    rules = plan.join(edge, plan["source"].eqNullSafe(edge["__s"]), "left").join(last, plan["source"].eqNullSafe(last["__l"]), "left")
    rules = stage(rules.select(F.struct("epochs", "rest", "blocks", "weight", "edge", "last").alias("__rule"), F.col("source").alias("__source")), "rules")

    rows = docs.withColumns({"__key": key, "__tokens": tokens}).join(rules, F.col(f"`{source}`").cast("string").eqNullSafe(F.col("__source")))
    r = lambda name: F.col(f"__rule.{name}")
    rows = rows.withColumn("__block", block(F.col("__key"), r("blocks")))
    rows = rows.withColumn("__turn", turn(r("epochs"), F.col("__source"), F.col("__block")))
    partial = (r("rest") > 0) & ((F.col("__tokens") == 0) | r("edge").isNull() | (F.col("__turn") < r("edge")) | ((F.col("__turn") == r("edge")) & (F.col("__key") <= r("last"))))
    times = r("epochs") + F.when(F.coalesce(partial, F.lit(False)), 1).otherwise(0)
    rows = rows.withColumn("__epoch", F.explode(F.when(times > 0, F.sequence(F.lit(0).cast("long"), times - 1)).otherwise(F.array().cast("array<long>"))))
    mixed = F.struct(F.col("__tokens").alias("tokens"), F.col("__epoch").alias("epoch"), F.col("__block").alias("block"),
                     turn(F.col("__epoch"), F.col("__source"), F.col("__block")).alias("block_rank"), r("weight").alias("weight"))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns], mixed.alias("__mix"))

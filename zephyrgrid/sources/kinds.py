"""Energy answers of every kind from landed JSON lines: one registry from kind to typed fields and default range.

A line is a kind and a payload. Payloads are parsed once into ``variant`` values, whatever their fields; the kind says which
fields are the respondent, the period, the item and the values. Lines that do not fit are counted, not dropped unseen.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timeaxis import shift
from ..schema import DEFAULT_LOOKBACK_HOURS


@dataclass(frozen=True)
class Kind:
    """Where a kind's answers keep their parts. ``values`` maps items to value fields; where there is one field alone its item is
    taken from ``item`` fields, joined by ``>``."""

    respondent: str = "respondent"
    period: str | None = "period"
    item: tuple[str, ...] = ()
    values: dict[str, str] = field(default_factory=lambda: {"": "value"})


# The kinds and the field names of their answers.
KINDS = {
    "D": Kind(),
    "DF": Kind(),
    "NG": Kind(item=("fueltype",)),
    "TI": Kind(item=("fromba", "toba")),
    "SR": Kind(item=("type",)),
    "NR": Kind(item=("type",)),
    "LMP": Kind(),
    "DAM": Kind(),
    "capacity": Kind("stateid", None, ("plantprimaryFuel",), {"": "capacity"}),
    "retail": Kind("stateid", values={"price": "price", "revenue": "revenue", "sales": "sales"}),
    "peak": Kind(),
}


def _text(name: str) -> Column:
    return F.try_variant_get("_v", f"$.{name}", "string")


def _period(text: Column) -> Column:
    """Months, days, hours (without minutes) and full times; null for anything else."""
    whole = F.when(text.rlike(r"T\d\d$"), F.concat(text, F.lit(":00"))).otherwise(text)
    return F.try_to_timestamp(whole).cast("timestamp_ntz")


def parse(landed: DataFrame, kind: str = "kind", payload: str = "payload") -> DataFrame:
    """One row per value: kind, respondent, period, item, value, problem.

    ``problem`` is null for a good row, else what is wrong with the line: ``unknown kind``, ``broken payload``, ``no respondent``,
    ``no period`` or ``no value`` (text that is no number counts as none); a broken line gives one row.
    """
    lines = landed.select(F.col(kind).alias("kind"), F.try_parse_json(F.col(payload)).alias("_v"))

    def by_kind(make) -> Column:
        out = None
        for name, spec in KINDS.items():
            out = F.when(F.col("kind") == name, make(spec)) if out is None else out.when(F.col("kind") == name, make(spec))
        return out

    def values(spec: Kind) -> Column:
        own = F.concat_ws(">", *[_text(c) for c in spec.item]) if spec.item else F.lit("")
        return F.array(*[F.struct((F.lit(name) if name else own).alias("item"), F.try_variant_get("_v", f"$.{c}", "double").alias("value"))
                         for name, c in spec.values.items()])

    none = F.array(F.struct(F.lit("").alias("item"), F.lit(None).cast("double").alias("value")))
    parts = lines.select(
        "kind", "_v", by_kind(lambda s: _text(s.respondent)).alias("respondent"),
        by_kind(lambda s: _period(_text(s.period)) if s.period else F.lit(None).cast("timestamp_ntz")).alias("period"),
        by_kind(lambda s: F.lit(s.period is not None)).alias("_dated"), F.explode(F.coalesce(by_kind(values), none)).alias("_i"))
    problem = (F.when(F.col("_dated").isNull(), "unknown kind").when(F.col("_v").isNull(), "broken payload").when(F.col("respondent").isNull(), "no respondent")
               .when(F.col("_dated") & F.col("period").isNull(), "no period").when(F.col("_i.value").isNull(), "no value"))
    return parts.select("kind", "respondent", "period", "_i.item", "_i.value", problem.alias("problem"))


def report(parsed: DataFrame) -> DataFrame:
    """Rows by kind and problem (null for good ones)."""
    return parsed.groupBy("kind", "problem").agg(F.count(F.lit(1)).alias("n"))


def lookback(kind: str, now) -> tuple[Column, Column]:
    """Default range of a kind: its look-back window up to ``now``; from the beginning where it has none."""
    end = F.lit(now).cast("timestamp_ntz")
    hours = DEFAULT_LOOKBACK_HOURS.get(kind)
    return (shift(end, -hours * 3600) if hours else F.lit("0001-01-01").cast("timestamp_ntz")), end


def series(parsed: DataFrame, kinds: Sequence[str] | None = None, respondents: Sequence[str] | None = None, start=None, end=None, now=None) -> DataFrame:
    """Good rows of some kinds and respondents in an inclusive range; with ``now`` each kind's own default range. Kinds
    without a period are in every range."""
    out = parsed.filter(F.col("problem").isNull()).drop("problem")
    if kinds is not None:
        out = out.filter(F.col("kind").isin(*kinds))
    if respondents is not None:
        out = out.filter(F.col("respondent").isin(*respondents))
    inside = F.lit(True)
    if now is not None:
        for name in kinds or KINDS:
            low, high = lookback(name, now)
            inside = inside & ((F.col("kind") != name) | F.col("period").between(low, high))
    if start is not None:
        inside = inside & (F.col("period") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        inside = inside & (F.col("period") <= F.lit(end).cast("timestamp_ntz"))
    return out.filter(F.col("period").isNull() | inside)

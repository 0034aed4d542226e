"""Rolling-origin folds as prefix sums.

A fold trains on all rows before its cut, so folds overlap almost entirely. Instead of copying rows per
fold, each row gets the segment between two cuts it falls in; sums are taken per segment, and fold f uses
segments 0..f. A plain fit is the plan with one fold that cuts after the last row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.blocks import with_position


@dataclass(frozen=True)
class FoldPlan:
    h: int = 0
    step_size: int = 1
    n_windows: int = 1

    def cut(self, fold: Column) -> Column:
        return F.col("n") - self.h - (F.lit(self.n_windows - 1) - fold) * self.step_size

    def segment(self) -> Column:
        past = F.floor((F.col("pos") - F.col("n") + self.h) / self.step_size) + self.n_windows
        return F.greatest(F.lit(0), F.least(F.lit(self.n_windows), past)).cast("int")

    def folds(self) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(self.n_windows - 1)))


FULL = FoldPlan()


def numbered(series: DataFrame) -> DataFrame:
    return with_position(series, ["unique_id"], ["ds"], "pos", "n")


def tail_rows(rows: DataFrame, plan: FoldPlan, length: int) -> DataFrame:
    """The last ``length`` training rows of each fold, with their age (0 is the newest)."""
    reach = plan.h + (plan.n_windows - 1) * plan.step_size + length
    near = rows.filter(F.col("pos") >= F.col("n") - reach).withColumn("fold", plan.folds())
    aged = near.withColumn("cut", plan.cut(F.col("fold"))).withColumn("age", F.col("cut") - 1 - F.col("pos"))
    return aged.filter((F.col("cut") > 0) & F.col("age").between(0, length - 1))


def tails(rows: DataFrame, plan: FoldPlan, length: int, value: str = "y") -> DataFrame:
    """One row per series and fold: the last values, newest first, and the cut-off time."""
    packed = F.array_sort(F.collect_list(F.struct(F.col("age"), F.col(value).alias("v"))))
    return tail_rows(rows, plan, length).groupBy("unique_id", "fold").agg(
        F.max("ds").alias("cutoff"), F.transform(packed, lambda s: s["v"]).alias("tail"))


def test_rows(rows: DataFrame, plan: FoldPlan) -> DataFrame:
    """The ``h`` rows after each cut with their horizon step."""
    reach = plan.h + (plan.n_windows - 1) * plan.step_size
    near = rows.filter(F.col("pos") >= F.col("n") - reach).withColumn("fold", plan.folds())
    cut = near.withColumn("cut", plan.cut(F.col("fold")))
    return cut.filter(
        (F.col("cut") > 0) & (F.col("pos") >= F.col("cut")) & (F.col("pos") < F.col("cut") + plan.h)
    ).select("unique_id", "fold", "ds", "y", (F.col("pos") - F.col("cut") + 1).cast("int").alias("horizon_step"))

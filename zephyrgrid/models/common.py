"""Pieces the models share: small solves per series and interval columns."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.stats import unpack_gram
from ..schema import Z_VALUES


def ridge(flat, n: int, size: int, penalty=None) -> tuple[np.ndarray, float]:
    """Coefficients and residual variance from sums of products; the last column is the target."""
    gram = unpack_gram(np.asarray(flat, dtype=float), size)
    xtx, xty, yty = gram[:-1, :-1], gram[:-1, -1], gram[-1, -1]
    weights = np.zeros(size - 1) if penalty is None else np.asarray(penalty, dtype=float)
    beta = np.linalg.pinv(xtx + np.diag(weights), hermitian=True) @ xty
    rss = max(yty - 2 * beta @ xty + beta @ xtx @ beta, 0.0)
    return beta, rss / max(n - (size - 1), 1)


def with_levels(forecast: DataFrame, sd: Column, levels: Sequence[int]) -> DataFrame:
    """One row per confidence level with normal bounds; without levels the bounds are NULL."""
    if not levels:
        none = F.lit(None)
        return forecast.withColumns({
            "level": none.cast("int"), "lo": none.cast("double"), "hi": none.cast("double")})
    bands = F.explode(F.array(*[
        F.struct(F.lit(level).alias("level"), F.lit(Z_VALUES[level]).alias("z")) for level in levels]))
    return forecast.withColumn("_band", bands).withColumns({
        "level": F.col("_band.level"),
        "lo": F.col("yhat") - F.col("_band.z") * sd,
        "hi": F.col("yhat") + F.col("_band.z") * sd,
    }).drop("_band")


FORECAST_COLUMNS = ["unique_id", "ds", "model", "horizon_step", "yhat", "level", "lo", "hi"]

"""Lag, rolling and calendar features of a series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import calendar_parts, cyclical_parts
from ..schema import FULL_WINDOW_LAGS, FULL_WINDOW_ROLLING, LAGS, ROLLING
from .blocks import row_blocks, with_position

STATS = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}


def _lags(w, lags) -> dict[str, Column]:
    return {f"lag_{k}": F.lag("y", k).over(w) for k in lags}


def _rolling(w, windows, include_current: bool, full_only: bool, stats) -> dict[str, Column]:
    out = {}
    for size in windows:
        frame = w.rowsBetween(-size + 1, 0) if include_current else w.rowsBetween(-size, -1)
        for name in stats:
            value = STATS[name]("y").over(frame)
            if full_only:
                value = F.when(F.count("y").over(frame) == size, value)
            out[f"rolling_{name}_{size}"] = value
    return out


def _windowed(series: DataFrame, make, reach: int) -> DataFrame:
    numbered = with_position(series, ["unique_id"], ["ds"], "pos")
    return row_blocks(numbered, ["unique_id"], make, reach).drop("pos")


def lag_features(series: DataFrame, freq: str = "H") -> DataFrame:
    lags = LAGS[freq]
    return _windowed(series, lambda w: _lags(w, lags), max(lags))


def rolling_features(series: DataFrame, freq: str = "H", include_current: bool = True) -> DataFrame:
    """Rolling mean, sample deviation, minimum and maximum over up to ``w`` rows."""
    sizes = ROLLING[freq]
    return _windowed(series, lambda w: _rolling(w, sizes, include_current, False, STATS), max(sizes))


def rolling_full(series: DataFrame) -> DataFrame:
    """The older feature set: full windows only, mean and deviation."""
    def make(w):
        return _lags(w, FULL_WINDOW_LAGS) | _rolling(w, FULL_WINDOW_ROLLING, True, True, ("mean", "std"))
    return _windowed(series, make, max(FULL_WINDOW_LAGS + FULL_WINDOW_ROLLING))


def calendar_features(series: DataFrame, sub_daily: bool = True, day_of_month: bool = False) -> DataFrame:
    return series.withColumns(calendar_parts("ds") | cyclical_parts("ds", sub_daily, day_of_month))


def feature_names(freq: str = "H") -> list[str]:
    names = list(calendar_parts("ds")) + [f"lag_{k}" for k in LAGS[freq]]
    names += [f"rolling_{s}_{w}" for w in ROLLING[freq] for s in STATS]
    return names + list(cyclical_parts("ds", freq != "D"))


def model_features(series: DataFrame, freq: str = "H", include_current: bool = True,
                   drop_missing: bool = True) -> DataFrame:
    """All features of the boosted model; incomplete rows are dropped.

    ``include_current`` puts the row's own value into its rolling windows; models that predict that
    value must switch it off.
    """
    lags, sizes = LAGS[freq], ROLLING[freq]

    def make(w):
        return _lags(w, lags) | _rolling(w, sizes, include_current, False, STATS)

    out = calendar_features(_windowed(series, make, max(lags + sizes)), freq != "D")
    return out.na.drop("any", subset=["y", *feature_names(freq)]) if drop_missing else out

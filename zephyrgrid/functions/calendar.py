"""Calendar features of a time column."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .timeaxis import as_col

CALENDAR = {
    "hour": F.hour,
    "dayofweek": F.weekday,
    "quarter": F.quarter,
    "month": F.month,
    "year": F.year,
    "dayofyear": F.dayofyear,
    "dayofmonth": F.dayofmonth,
    "weekofyear": F.weekofyear,
}


def calendar_parts(ds) -> dict[str, Column]:
    """Integer parts; weeks are ISO weeks and Monday is day 0."""
    return {name: fn(as_col(ds)).cast("int") for name, fn in CALENDAR.items()}


def cycle(value: Column, period: float) -> tuple[Column, Column]:
    angle = value * F.lit(2 * math.pi / period)
    return F.sin(angle), F.cos(angle)


def cyclical_parts(ds, sub_daily: bool = True, day_of_month: bool = False) -> dict[str, Column]:
    """Sine and cosine pairs of the hour (sub-daily data only), week day, month and month day."""
    ds = as_col(ds)
    cycles = {"dayofweek": (F.weekday(ds), 7), "month": (F.month(ds), 12)}
    if sub_daily:
        cycles["hour"] = (F.hour(ds), 24)
    if day_of_month:
        cycles["day"] = (F.dayofmonth(ds), 31)
    out = {}
    for name, (value, period) in cycles.items():
        out[f"{name}_sin"], out[f"{name}_cos"] = cycle(value, period)
    return out

"""Time buckets and steps on zone-less timestamps (the session zone is UTC)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MINUTE, QUARTER, HOUR, DAY, WEEK = 60, 900, 3600, 86400, 604800


def as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def epoch(c) -> Column:
    return F.unix_seconds(as_col(c).cast("timestamp"))


def from_epoch(c) -> Column:
    return F.timestamp_seconds(as_col(c)).cast("timestamp_ntz")


def bucket(c, seconds: int) -> Column:
    """Start of the fixed-length bucket holding ``c``."""
    return from_epoch(floor_to(epoch(c), seconds))


def floor_to(number: Column, step: int) -> Column:
    """The multiple of ``step`` at or below a whole number, in whole-number arithmetic."""
    return number - F.pmod(number, F.lit(step).cast("bigint"))


def hour_of(c) -> Column:
    return bucket(c, HOUR)


def day_of(c) -> Column:
    return as_col(c).cast("date").cast("timestamp_ntz")


def month_of(c) -> Column:
    return F.trunc(as_col(c).cast("date"), "MM").cast("timestamp_ntz")


def week_ending_sunday(c) -> Column:
    """The Sunday that closes the Monday-to-Sunday week holding ``c``."""
    return F.date_add(F.trunc(as_col(c).cast("date"), "WEEK"), 6).cast("timestamp_ntz")


def shift(c, seconds) -> Column:
    """``c`` moved by a whole number of seconds; microseconds are kept."""
    amount = seconds if isinstance(seconds, Column) else F.lit(int(seconds))
    return as_col(c) + F.make_dt_interval(secs=amount.cast("decimal(18,6)"))


def truncate(c, frequency: str) -> Column:
    """Bucket start for a named frequency: hourly, daily or monthly."""
    rules = {"hourly": hour_of, "daily": day_of, "monthly": month_of}
    return rules[frequency](c)

"""Column helpers that several operators share."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The white space that separates words.
SPACE = r"\x20\x09-\x0D"
BATCH_BYTES = 8 << 20
BATCH_ROWS = 2000
SPACE_CHARS = "\x20\x09\x0a\x0b\x0c\x0d"


def whole(column: str | Column) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def ascii_lower(column: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(column, string.ascii_uppercase, string.ascii_lowercase)


def crc32_text(column: Column) -> Column:
    """CRC-32 of a value written as text; null as the empty text."""
    return F.crc32(F.encode(F.coalesce(column.cast("string"), F.lit("")), "UTF-8"))


def words_of(column: Column) -> Column:
    """Words of a text, in order: maximal runs without white space."""
    return F.array_remove(F.split(column, f"[{SPACE}]+", -1), "")


def byte_total(docs: DataFrame, text: str) -> int:
    """UTF-8 bytes of all texts."""
    row = docs.agg(F.sum(F.octet_length(F.col(text))).alias("n")).first()
    return int(row["n"] or 0)


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``, with the session's Arrow batches bounded in bytes and rows: whole texts and packed rows are large."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df

"""Packing by concatenation and cutting (operator 2).

First pass: tasks tokenise their rows, note every document's place within the task's own stream and write ids and
places to the shared folder. Second pass: prefix sums over the tasks' token totals turn places into offsets of one global
stream, which is cut into windows of fixed length; a document that crosses a cut leaves boundary records on both sides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .encoding import BatchEncoder, binary, load, released
from .text import bounded_batches

LENGTH = 2048
END_ID = 1


def tokenize(docs: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text", end_id: int | None = END_ID) -> DataFrame:
    """Ids of every row and their place in the task's stream: __id, ids (bytes), n, task, place.

    ``tokenizer`` is the path of a tokenizers file on the driver; its content is broadcast (a few MB by its nature).
    """
    with open(tokenizer, encoding="utf-8") as file:
        definition = docs.sparkSession.sparkContext.broadcast(file.read())
    rows = bounded_batches(docs).select(F.col(id).alias("__id"), F.col(text).alias("text"))

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, place = BatchEncoder(load(definition.value), end_id), TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, n = encode(batch.column(1))
            places = place + np.cumsum(n) - n
            place += int(n.sum())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), binary(ids, n), pa.array(n), pa.array(np.full(len(n), task, dtype=np.int32)), pa.array(places)],
                names=["__id", "ids", "n", "task", "place"])

    return rows.mapInArrow(run, f"__id {rows.schema['__id'].dataType.simpleString()}, ids binary, n long, task int, place long")


def pack(docs: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text", length: int = LENGTH, end_id: int | None = END_ID) -> DataFrame:
    """Pieces of all rows: id, start, length, ids (bytes), doc_tokens, sequence_id, offset, continues, continued.

    * Sequence s holds the stream's ids s * length up to (s + 1) * length; only the last one may be shorter. ``continues``
      and ``continued`` mark boundary records: the document began in, or goes on in, another sequence.
    * A null text is an empty one and holds the end id alone (without an end id it has no piece). Very long texts become
      many pieces. Repeated rows are documents of their own; an empty table gives an empty result; other columns are not read.
    * The order of documents is the scan's. Tokens are written once to the shared folder before they get offsets, so a
      repeated task changes nothing. The driver holds one total per task.
    """
    spark = docs.sparkSession
    tokens = stage(tokenize(docs, tokenizer, id, text, end_id), "tokens")
    totals = tokens.groupBy("task").agg(F.sum("n").alias("n")).orderBy("task").collect()
    before = np.concatenate([[0], np.cumsum([r["n"] for r in totals])])[:-1]
    bases = spark.createDataFrame([(r["task"], int(b)) for r, b in zip(totals, before, strict=True)], "task int, base long")
    bases = stage(bases.coalesce(1), "bases")  # a file has a size by which Spark decides on a broadcast
    first = F.col("base") + F.col("place")
    placed = tokens.where("n > 0").join(bases, "task").withColumn("first", first)
    span = F.sequence(F.floor(F.col("first") / length), F.floor((F.col("first") + F.col("n") - 1) / length))

    def piece(s):
        start = F.greatest(s * length - F.col("first"), F.lit(0).cast("long"))
        size = F.least((s + 1) * length - F.col("first"), F.col("n")) - start
        return F.struct(start.alias("start"), size.alias("length"),
                        F.substring(F.col("ids"), (start * 4 + 1).cast("int"), (size * 4).cast("int")).alias("ids"),
                        s.alias("sequence_id"), F.greatest(F.col("first") - s * length, F.lit(0).cast("long")).alias("offset"))

    cut = placed.select("__id", F.col("n").alias("doc_tokens"), F.explode(F.transform(span, piece)).alias("p"))
    return cut.select(F.col("__id").alias(id), "p.start", "p.length", "p.ids", "doc_tokens", "p.sequence_id", "p.offset",
                      (F.col("p.start") > 0).alias("continues"), (F.col("p.start") + F.col("p.length") < F.col("doc_tokens")).alias("continued"))

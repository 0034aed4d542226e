"""Best-fit packing with certified bin counts (operator 11).

Documents are whole pieces of at most one sequence; only longer ones are cut. Pieces are dealt to partitions of bounded
size, each packed by best-fit decreasing. Dual feasible functions give a lower bound of the sequences any packing of the
partition needs: where it is met, the partition is certified. Partitions with a gap are pooled, so that their documents
are exchanged, and packed again, until bounds are met or a round gains nothing.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .encoding import BatchEncoder, binary, load, released
from .text import bounded_batches

LENGTH = 2048
END_ID = 0
PART_PIECES = 20_000
ROUNDS = 4
ROUNDED_STEPS = 100
# Pieces are known by task * 2^40 + count, packed sequences by partition * 2^32 + bin, full ones by -1 - piece.
TASK_BITS, BIN_BITS = 40, 32
PARTS = "part int, bins long, bound long, keys binary, lengths binary, places binary, offsets binary"


def dual_feasible(capacity: int, steps: int = ROUNDED_STEPS) -> Iterator[tuple[np.ndarray, int]]:
    """Dual feasible functions as whole numbers by size (0 to ``capacity``) and what a full bin is worth.

    For each, no sizes that fit into one bin are worth more than a bin; so the worth of all pieces, divided by a bin's
    and rounded up, is a lower bound. Plain sizes; sizes with those above ``capacity - e`` full and those below ``e``
    free (Martello and Toth); sizes rounded to k-ths; and counts of parts of size ``e`` (Fekete and Schepers).
    """
    size = np.arange(capacity + 1, dtype=np.int64)
    yield size, capacity
    for e in range(1, capacity // 2 + 1):
        yield np.where(size > capacity - e, capacity, np.where(size < e, 0, size)), capacity
    for k in range(1, steps + 1):
        whole, rest = np.divmod((k + 1) * size, capacity)
        yield np.where(rest == 0, whole * k, whole * (k + 1)), k * (k + 1)
    for e in range(1, capacity // 2 + 1):
        parts = capacity // e
        yield np.where(2 * size > capacity, parts - (capacity - size) // e, (size >= e).astype(np.int64)), parts


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Bins that any packing of these pieces needs at least, by the best of the dual feasible functions."""
    counts = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    return max(-(-int(worth @ counts) // bin_) for worth, bin_ in dual_feasible(capacity))


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each piece and the number of bins: from the longest down, into the fullest bin with room."""
    places, offsets = np.zeros(len(lengths), dtype=np.int32), np.zeros(len(lengths), dtype=np.int32)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, opened = 0, 0  # bit r: there is a bin with room r
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            place = open_bins[room].pop()
            if not open_bins[room]:
                rooms ^= 1 << room
        else:
            room, place, opened = capacity, opened, opened + 1
        places[i], offsets[i] = place, capacity - room
        room -= size
        if room:
            open_bins[room].append(place)
            rooms |= 1 << room
    return places, offsets, opened


def _row(part: int, keys: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple:
    places, offsets, bins = best_fit_decreasing(lengths, capacity)
    return (part, bins, lower_bound(lengths, capacity), keys.astype("<i8").tobytes(), lengths.astype("<i4").tobytes(),
            places.astype("<i4").tobytes(), offsets.astype("<i4").tobytes())


def _rows(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in PARTS.split(", ")])


def cut(docs: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text", length: int = LENGTH, end_id: int | None = END_ID) -> DataFrame:
    """Pieces of all rows: key, __id, piece, start, length, ids (bytes), ids_crc32. A batch of whole texts is in memory."""
    with open(tokenizer, encoding="utf-8") as file:
        definition = docs.sparkSession.sparkContext.broadcast(file.read())
    rows = bounded_batches(docs).select(F.col(id).alias("__id"), F.col(text).alias("text"))

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, key = BatchEncoder(load(definition.value), end_id), TaskContext.get().partitionId() << TASK_BITS
        for batch in batches:
            ids, n = encode(batch.column(1))
            pieces = -(-n // length)
            row = np.repeat(np.arange(len(n)), pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * length
            size = np.minimum(length, n[row] - start)
            bounds, data = np.concatenate([[0], np.cumsum(size) * 4]), memoryview(ids).cast("B")
            sums = [zlib.crc32(data[a:b]) for a, b in zip(bounds, bounds[1:])]
            yield pa.RecordBatch.from_arrays([
                pa.array(key + np.arange(len(row))), batch.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start),
                pa.array(size), binary(ids, size), pa.array(sums, pa.int64())],
                names=["key", "__id", "piece", "start", "length", "ids", "ids_crc32"])
            key += len(row)

    kind = rows.schema["__id"].dataType.simpleString()
    return rows.mapInArrow(run, f"key long, __id {kind}, piece int, start long, length long, ids binary, ids_crc32 long")


def plan(pieces: DataFrame, length: int = LENGTH, part_pieces: int = PART_PIECES, rounds: int = ROUNDS) -> DataFrame:
    """Partitions of the pieces shorter than a sequence: part, bins, bound, and their keys, lengths, bins and offsets as
    bytes. A partition has about ``part_pieces`` pieces; one that met a gap can hold those of up to 2 ^ ``rounds`` others.
    """
    items = pieces.where(F.col("length") < length).select("key", "length")
    parts = max(1, -(-items.count() // part_pieces))

    def first(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("key")
        return _rows([_row(int(rows["part"].iloc[0]), rows["key"].to_numpy(), rows["length"].to_numpy(), length)])

    def again(rows: pd.DataFrame) -> pd.DataFrame:
        """One partition out of the pool if that saves bins or certifies them all, else the pool as it was."""
        rows = rows.sort_values("part")
        keys = np.concatenate([np.frombuffer(b, "<i8") for b in rows["keys"]])
        lengths = np.concatenate([np.frombuffer(b, "<i4") for b in rows["lengths"]])
        made = _row(int(rows["part"].iloc[0]), keys, lengths, length)
        before = int(rows["bins"].sum())
        if made[1] < before or made[1] == made[2]:
            return _rows([made])
        return rows.drop(columns="pool")

    packed = stage(items.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int")).groupBy("part").applyInPandas(first, PARTS), "packed")
    for turn in range(rounds):
        gap = F.col("bins") > F.col("bound")
        state = packed.agg(F.count_if(gap), F.sum("bins")).first()
        if state[0] < 2:
            break
        pooled = packed.where(gap).withColumn("pool", F.pmod(F.xxhash64("part", F.lit(turn)), F.lit(-(-state[0] // 2))).cast("int"))
        packed = stage(packed.where(~gap).unionByName(pooled.groupBy("pool").applyInPandas(again, PARTS)), "repacked")
        if tuple(packed.agg(F.count_if(gap), F.sum("bins")).first()) == tuple(state):
            break
    return packed


def placements(packed: DataFrame) -> DataFrame:
    """Sequence and offset of every piece of the partitions: key, sequence_id, offset."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                places = np.frombuffer(row["places"], "<i4").astype(np.int64)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.frombuffer(row["keys"], "<i8")), pa.array(places + (row["part"] << BIN_BITS)),
                    pa.array(np.frombuffer(row["offsets"], "<i4").astype(np.int64))], names=["key", "sequence_id", "offset"])

    return packed.select("part", "keys", "places", "offsets").mapInArrow(run, "key long, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text", length: int = LENGTH, end_id: int | None = END_ID,
         part_pieces: int = PART_PIECES, rounds: int = ROUNDS) -> DataFrame:
    """Pieces of all rows in few sequences: id, piece, start, length, ids (bytes), ids_crc32, sequence_id, offset.

    * A document of at most ``length`` ids is one piece; a longer one is cut into pieces of ``length``, the last of which may
      be shorter. A sequence's pieces lie one after another from offset 0. Full pieces have a sequence of their own (negative).
    * A null text is an empty one and holds the end id alone (without an end id it has no piece). Repeated rows are documents
      of their own; null ids stay; ties of length go by piece key. An empty table gives an empty result; other columns are
      not read.
    * Ids are written once to the shared folder and stay there; what is dealt, shuffled and joined are keys and lengths. The
      driver sees counts. Which documents meet in a partition depends on the scan's tasks, the certificates do not.
    """
    pieces = stage(cut(docs, tokenizer, id, text, length, end_id), "pieces")
    full = pieces.where(F.col("length") == length).select(
        "key", (-1 - F.col("key")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    placed = placements(plan(pieces, length, part_pieces, rounds)).unionByName(full)
    return pieces.join(placed, "key").select(F.col("__id").alias(id), "piece", "start", "length", "ids", "ids_crc32", "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves: sequence_id, length, ids (bytes) and the lengths of their documents for attention masks."""
    piece = F.struct("offset", "length", "ids")
    rows = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(piece)).alias("p"))  # at most ``length`` pieces
    joined = F.aggregate("p", F.lit("").cast("binary"), lambda acc, p: F.concat(acc, p["ids"]))
    return rows.select("sequence_id", F.aggregate("p", F.lit(0).cast("long"), lambda acc, p: acc + p["length"]).alias("length"),
                       joined.alias("ids"), F.transform("p", lambda p: p["length"]).alias("document_lengths"))

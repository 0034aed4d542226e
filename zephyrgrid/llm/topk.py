"""Exact top-k inner products over norm-sorted vectors (operator 3).

Vectors are packed into tiles by falling length. Queries meet the tile of the longest vectors first, then the next
longest ones, then the rest; the k-th score of what a query has met is a floor for what follows, and a tile is visited by
the query blocks that its length bound still allows. Inside a tile partial sums in the directions of a singular value
decomposition, with the Cauchy-Schwarz bound of what is left, leave few pairs to score exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import stage

BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
SCALE = 1024
TILE_ROWS = 4096
BLOCK_ROWS = 4096
CHUNK = 512
SAMPLE = 4096
LEVELS = (0.25, 0.5, 0.75, 1.0)
EARLY = 1 / 16  # share of the tiles whose scores set the floors of the others
FILE_TILES = 16  # tiles that one task sorts
TASK_BLOCKS = 4  # blocks that one task holds
BATCH = "16m"  # pairs of tiles and blocks that are on their way to Python at once
PAIRS = 1 << 12  # pairs scored one by one at once
FOUND = 1 << 16  # candidates that a block gathers before the floors rise
SPARSE = 1 / 512  # share of open pairs from which on the next level is cheaper than scoring them one by one
DENSE = 1 / 16  # and from which on, after the last level, a product of all is
EXACT = float(1 << 52)
NO_FLOOR = np.iinfo(np.int64).min


def usable(vector: Column) -> Column:
    """Not null, without null or non-finite components."""
    return vector.isNotNull() & F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def quantised(vectors: DataFrame, id: str, vector: str, scale: int) -> DataFrame:
    """__id, v (floor of scale times each component) and length of the usable rows with an id."""
    value = F.col(vector)
    rows = vectors.where(F.col(id).isNotNull() & usable(value)).select(
        F.col(id).cast("long").alias("__id"), F.transform(value, lambda x: F.floor(x.cast("double") * float(scale)).cast("long")).alias("v"))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return rows.withColumn("length", F.sqrt(square))


def rotation(sample: list[list[int]], width: int) -> np.ndarray:
    """Right singular vectors of a sample of vectors (any orthonormal basis gives right results)."""
    if not sample:
        return np.eye(width)
    out = np.zeros((len(sample), width))
    for i, row in enumerate(sample):
        out[i, :len(row)] = row
    return np.linalg.svd(out, full_matrices=True)[2].T


def _column(rows: pa.Table | pa.RecordBatch, name: str) -> pa.Array:
    found = rows.column(name)
    return pa.concat_arrays(found.chunks) if isinstance(found, pa.ChunkedArray) else found


def _numbers(rows: pa.Table | pa.RecordBatch, name: str) -> np.ndarray:
    return _column(rows, name).to_numpy(zero_copy_only=False)


def _packed(lists: pa.ListArray, width: int) -> bytes:
    """Vectors padded with zeros, in the smallest integers that hold them."""
    values = lists.flatten().to_numpy(zero_copy_only=False)
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    ends = values.min(initial=0), values.max(initial=0)
    out = np.zeros((len(lists), width), dtype=next(t for t in (np.int16, np.int32, np.int64) if np.iinfo(t).min <= ends[0] and ends[1] <= np.iinfo(t).max))
    out[np.arange(width) < sizes[:, None]] = values
    return out.tobytes()


def _unpacked(vectors: bytes, count: int, width: int) -> np.ndarray:
    return np.frombuffer(vectors, dtype=f"i{len(vectors) // (count * width)}").reshape(count, width)


def _exact(q: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Inner products of rows with rows as 64-bit integers; sums beyond doubles' exact range by Python integers, held at the ends."""
    x, y = q.astype(float), t.astype(float)
    if _fits(np.abs(x).max(initial=0), np.abs(y).max(initial=0), q.shape[1]):
        return _sums(x, y)
    ends = np.iinfo(np.int64)
    return np.array([min(max(sum(int(a) * int(b) for a, b in zip(x, y, strict=True)), ends.min), ends.max) for x, y in zip(q, t, strict=True)], dtype=np.int64)


def _sums(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x, y).astype(np.int64)


def _fits(x: float, y: float, width: int) -> bool:
    """Sums of products of so large numbers are exact in doubles, in any order."""
    return x * y * max(1, width) < EXACT


class _Vectors:
    """Rows of a tile or a block: ids, integer vectors, lengths, and by level the rotated parts with the length of what is left."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, basis: np.ndarray, own_scale: bool):
        self.ids, self.vectors = ids, vectors
        self.values = values = vectors.astype(float)
        self.largest = np.abs(values).max(initial=0)
        self.lengths = np.sqrt((values ** 2).sum(axis=1))
        # A nonzero vector of integers is at least 1 long. Parts are divided by it, so that no sum of theirs exceeds 1.
        self.scale = np.maximum(self.lengths, 1.0) if own_scale else np.full(len(ids), max(1.0, self.lengths.max(initial=1.0)))
        self.rotated = (values @ basis) / self.scale[:, None]
        self.levels: dict[int, np.ndarray] = {}

    def level(self, c: int) -> np.ndarray:
        """Products of two such rows bound the inner product of the whole ones from above."""
        if c not in self.levels:
            rest = np.sqrt((self.rotated[:, c:] ** 2).sum(axis=1, keepdims=True))
            self.levels[c] = np.ascontiguousarray(np.hstack([self.rotated[:, :c], rest] if c < self.rotated.shape[1] else [self.rotated]), dtype=np.float32)
        return self.levels[c]


class _Block:
    """Queries of a block with the best candidates that a task has found for them.

    ``floors`` holds a score that each query's k-th best reaches at least (NO_FLOOR when unknown).
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, floors: np.ndarray, k: int, basis: np.ndarray):
        self.rows, self.floors, self.k = _Vectors(ids, vectors, basis, True), floors.copy(), k
        self.last = np.full(len(ids), np.iinfo(np.int64).max)  # ids of the k-th best; ties with larger ones are out
        self.order = np.argsort(ids)
        self.found, self.new = [], 0

    def meet(self, tile: _Vectors) -> None:
        """Find candidates in one tile (longest first)."""
        q, width = self.rows, self.rows.vectors.shape[1]
        fits = _fits(q.largest, tile.largest, width)
        cuts = sorted({max(1, int(width * x)) for x in LEVELS})
        start = 0
        for first in range(0, len(tile.ids), CHUNK):
            part = slice(first, first + CHUNK)
            floors = np.where(self.floors == NO_FLOOR, -np.inf, self.floors)
            alive = np.flatnonzero(q.lengths * (tile.lengths[part].max() * (1 + 1e-9)) + 1 >= floors)
            if not len(alive):
                break
            least = floors[alive] / (q.scale[alive] * tile.scale[0])
            if not first:
                some = slice(None, None, 64)
                start = next((i for i, c in enumerate(cuts) if self._open(alive[some], least[some], tile, part, c)[2] <= SPARSE), len(cuts) - 1)
            for c in cuts[start:]:
                rows, open_, share = self._open(alive, least, tile, part, c)
                alive, least = alive[rows], least[rows]
                if share <= SPARSE:
                    break
            if share <= DENSE or not fits:
                self._by_pairs(alive, open_, tile, first, fits)
            else:
                self._by_products(alive, tile, part)
            if self.new > FOUND:
                self.settle()

    def _open(self, alive: np.ndarray, least: np.ndarray, tile: _Vectors, part: slice, c: int) -> tuple[np.ndarray, np.ndarray, float]:
        """Of ``alive`` the rows with pairs that may reach the floor by the first c directions, those pairs, and their share of all.

        Twice the error that single precision can make is allowed for.
        """
        rows, least = self.rows.level(c), (least - (c + 16) * 2.4e-7).astype(np.float32)
        bound = (rows if len(alive) == len(rows) else rows[alive]) @ tile.level(c)[part].T
        some = np.flatnonzero(bound.max(axis=1) >= least)
        open_ = bound[some] >= least[some, None]
        return some, open_, np.count_nonzero(open_) / max(1, bound.size)

    def _by_pairs(self, alive: np.ndarray, open_: np.ndarray, tile: _Vectors, first: int, fits: bool) -> None:
        hits = np.flatnonzero(open_)
        for at in range(0, len(hits), PAIRS):
            a, b = np.divmod(hits[at:at + PAIRS], open_.shape[1])
            a, b = alive[a], b + first
            other = self.rows.ids[a] != tile.ids[b]
            a, b = a[other], b[other]
            score = _sums(self.rows.values[a], tile.values[b]) if fits else _exact(self.rows.vectors[a], tile.vectors[b])
            self._keep(a, tile.ids[b], score)

    def _by_products(self, alive: np.ndarray, tile: _Vectors, part: slice) -> None:
        """All pairs by matrix products, of which a query's k best in the chunk, and their ties, are kept."""
        ids, t = tile.ids[part], tile.values[part]
        for at in range(0, len(alive), CHUNK):
            some = alive[at:at + CHUNK]
            score = self.rows.values[some] @ t.T
            score[self._own(some, ids)] = -np.inf
            enough = score >= np.partition(score, -min(self.k, len(ids)), axis=1)[:, -min(self.k, len(ids)), None]
            a, b = np.nonzero(enough & (score > -np.inf))
            self._keep(some[a], ids[b], score[a, b].astype(np.int64))

    def _own(self, some: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Of pairs of queries and candidates those of one id."""
        own = np.zeros((len(some), len(ids)), dtype=bool)
        place = np.searchsorted(self.rows.ids, ids, sorter=self.order)
        place = self.order[np.minimum(place, len(self.order) - 1)]
        row = np.full(len(self.order), -1)
        row[some] = np.arange(len(some))
        b = np.flatnonzero((self.rows.ids[place] == ids) & (row[place] >= 0))
        own[row[place[b]], b] = True
        return own

    def _keep(self, a: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        good = (score > self.floors[a]) | ((score == self.floors[a]) & (ids < self.last[a]))
        if good.any():
            self.found.append((a[good], ids[good], score[good]))
            self.new += int(good.sum())
            if self.new > 4 * FOUND:
                self.settle()

    def settle(self) -> None:
        """Only a query's k best stay; its floor rises to the k-th."""
        if not self.new:
            return
        a, ids, score = (np.concatenate(x) for x in zip(*self.found, strict=True))
        order = np.lexsort((ids, ~score, a))
        a, ids, score = a[order], ids[order], score[order]
        start = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
        rank = np.arange(len(a)) - np.repeat(start, np.diff(np.append(start, len(a))))
        top, kth = rank < self.k, rank == self.k - 1
        self.floors[a[kth]], self.last[a[kth]] = score[kth], ids[kth]
        self.found, self.new = [(a[top], ids[top], score[top])], 0

    def best(self) -> Iterator[pa.RecordBatch]:
        self.settle()
        for a, ids, score in self.found:
            yield pa.RecordBatch.from_arrays([pa.array(self.rows.ids[a]), pa.array(ids), pa.array(score)], names=["query_id", "vec_id", "score"])


def _tiles(rows: DataFrame, width: int, count: int) -> DataFrame:
    """Tiles of falling length: tile, longest, ids, vectors. A task sorts FILE_TILES tiles, fewer where all cores would not have work."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held = None
        for batch in batches:
            held = pa.concat_tables([held, pa.table(batch)]) if held is not None else pa.table(batch)
            while len(held) >= TILE_ROWS:
                yield tile(number, held.slice(0, TILE_ROWS))
                number, held = number + 1, held.slice(TILE_ROWS)
        if held is not None and len(held):
            yield tile(number, held)

    def tile(number: int, part: pa.Table) -> pa.RecordBatch:
        row = (number, part.column("length")[0].as_py(), _numbers(part, "__id").tobytes(), _packed(_column(part, "v"), width))
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int64(), pa.float64(), pa.binary(), pa.binary()), strict=True)], names=["tile", "longest", "ids", "vectors"])

    parts = max(-(-count // FILE_TILES), min(count, 2 * rows.sparkSession.sparkContext.defaultParallelism))
    ordered = rows.repartitionByRange(parts, F.desc("length"), "__id").sortWithinPartitions(F.desc("length"), "__id")
    return ordered.select("__id", "v", "length").mapInArrow(run, "tile long, longest double, ids binary, vectors binary")


def _blocks(queries: DataFrame, width: int, count: int) -> DataFrame:
    """Query blocks: block, q_ids, q_vectors, floors, reach (the least length that any of its queries still needs)."""

    def run(rows: pa.Table) -> pa.Table:
        floors = _column(rows, "floor").fill_null(NO_FLOOR).to_numpy(zero_copy_only=False)
        reach = float(np.where(floors <= 0, 0.0, floors / np.maximum(_numbers(rows, "length"), 1e-300)).min()) * (1 - 1e-9)
        row = (rows.column("block")[0].as_py(), _numbers(rows, "__id").tobytes(), _packed(_column(rows, "v"), width), floors.tobytes(), reach)
        return pa.table({n: pa.array([x], t) for n, x, t in zip(("block", "q_ids", "q_vectors", "floors", "reach"), row, (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.float64()), strict=True)})

    dealt = queries.select("floor", "__id", "v", "length", F.pmod(F.xxhash64("__id"), F.lit(count)).cast("int").alias("block"))
    return dealt.groupBy("block").applyInArrow(run, "block int, q_ids binary, q_vectors binary, floors binary, reach double")


def _score(tiles: DataFrame, blocks: DataFrame, count: int, k: int, width: int, basis: np.ndarray) -> DataFrame:
    """Best candidates of the blocks in the tiles within their reach: query_id, vec_id, score.

    A task reads some tiles and some blocks, whose pairs neither a shuffle nor a file holds, and gives the k best of what it read.
    """
    pairs = tiles.crossJoin(blocks.repartition(-(-count // TASK_BLOCKS)).hint("shuffle_replicate_nl")).where("longest >= reach")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, _Block] = {}
        number, tile = None, None
        for batch in batches:
            for row in range(batch.num_rows):
                at, block = batch.column("tile")[row].as_py(), batch.column("block")[row].as_py()
                read = lambda name, i=row, rows=batch: rows.column(name)[i].as_buffer()
                if block not in held:
                    ids = np.frombuffer(read("q_ids"), dtype=np.int64).copy()
                    held[block] = _Block(ids, _unpacked(read("q_vectors"), len(ids), width).copy(), np.frombuffer(read("floors"), dtype=np.int64), k, basis)
                if at != number:
                    ids = np.frombuffer(read("ids"), dtype=np.int64).copy()
                    number, tile = at, _Vectors(ids, _unpacked(read("vectors"), len(ids), width).copy(), basis, False)
                held[block].meet(tile)
        for block in held.values():
            yield from block.best()

    return pairs.select("tile", "ids", "vectors", "block", "q_ids", "q_vectors", "floors").mapInArrow(run, "query_id long, vec_id long, score long")


def _ranked(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Batches of the default 64 MB, which both sides hold, would be most of a task's memory."""
    before = spark.conf.get(BATCH_CONF)
    spark.conf.set(BATCH_CONF, BATCH)
    try:
        yield
    finally:
        spark.conf.set(BATCH_CONF, before)


def _sample(rows: DataFrame, n: int) -> list[list[int]]:
    """Vectors of the smallest hashes. Only about twice as many as are asked for are compared, or each partition would send all of them."""
    share, hashed = min(1.0, 2 * SAMPLE / max(1, n)), F.xxhash64("__id")
    near = rows if share == 1 else rows.where(hashed < F.lit(int(share * 2 ** 64) - 2 ** 63).cast("long"))
    return [r["v"] for r in near.orderBy(hashed, "__id").limit(SAMPLE).select("v").collect()]


def top_k(vectors: DataFrame, is_query: Column, id: str = "vec_id", vector: str = "embedding", k: int = 10, scale: int = SCALE) -> DataFrame:
    """The k highest inner products of every query with all other rows: query_id, rank, vec_id, score.

    * Components become floor(scale * x); scores are integer inner products, ties go to the smaller id. Shorter vectors
      count as padded with zeros. Sums beyond 64 bits are held at the ends.
    * Null vectors, those with null or non-finite components and null ids take no part. Rows of the query's own id are not
      its candidates; a repeated id is one query (of its smallest vector) and a candidate once per row. With fewer than k
      candidates all are returned; an empty table or no query gives an empty result. Other columns are not read.
    * The rotation is fitted on 4,096 vectors of the smallest hash; it decides on speed only. A task holds one tile and
      four blocks (4,096 vectors each).
    """
    rows = stage(quantised(vectors, id, vector, scale), "vectors")
    n, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    width = max(1, width)
    asked = rows.join(
        stage(vectors.where(is_query).select(F.col(id).cast("long").alias("__id")).distinct(), "asked"), "__id", "left_semi")
    asked = stage(asked.groupBy("__id").agg(F.min(F.struct("v", "length")).alias("first")).select("__id", "first.*"), "queries")
    count = -(-asked.count() // BLOCK_ROWS)
    if not n or not count:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    basis = rotation(_sample(rows, n), width)
    tiles = stage(_tiles(rows, width, -(-n // TILE_ROWS)), "tiles")
    longest, early, last = tiles.agg(F.min("tile"), F.percentile_approx("tile", EARLY), F.max("tile")).first()
    tile = F.col("tile")
    rounds = [stage(tiles.where(tile == F.lit(longest)), "longest-tile")]
    if early > longest:
        rounds.append(stage(tiles.where((tile > F.lit(longest)) & (tile <= F.lit(early))), "early-tiles"))
    if last > early:
        rounds.append(tiles.where(tile > F.lit(early)))
    found, floors = None, None
    for part in rounds:
        known = F.lit(None).cast("long").alias("floor")
        queries = asked.select("*", known) if found is None else asked.join(floors, "__id", "left")
        with _small_batches(rows.sparkSession):
            scored = stage(_score(part, _blocks(queries, width, count), count, k, width, basis), "scored")
        found = scored if found is None else found.unionByName(scored)
        floors = _ranked(found, k).where(F.col("rank") == k).select(F.col("query_id").alias("__id"), F.col("score").alias("floor"))
    return _ranked(found, k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")

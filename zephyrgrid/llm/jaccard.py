"""N-gram Jaccard join with several global token orders (operator 6).

1. Texts become sets of 64-bit shingle hashes; equal sets form classes.
2. Hash ranges are counted for the documents (classes) that hold each shingle. Shingles of one class go no further.
3. A class keeps, under every token order (rarest first, each order breaking ties in its own way), the shared shingles
   of its prefix: two sets above the threshold share a prefix token under each order. Stars over the prefix tokens give
   candidate groups per order; classes are compared only within the intersection of their groups under all orders.
4. Groups are cut into tiles of bounded size, pairs of tiles count intersections with matrix products and report links
   per class and a spanning forest, never pairs. Links give components.

Hashes stand for shingles: two unequal shingles of a pair coincide with a probability of about 2**-64 each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stage
from .components import components
from .text import bounded_batches

SHINGLE = 5
PERCENT = 75
ORDERS = 3
FLUSH_TOKENS = 1_000_000
TILE = 512
LIGHT = 12

U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
BASE_INVERSE = U(pow(int(BASE), -1, 1 << 64))
STEP = U(0xD6E8FEB86659FD93)
SPACES = np.isin(np.arange(256), [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
SEGMENT = 1 << 18


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Scrambles 64-bit values one to one."""
    x = x + U((seed * 0x9E3779B97F4A7C15 + 0x1234567) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _segments(raw: bytes) -> Iterator[tuple[int, bytes]]:
    """Parts of about a quarter megabyte, cut before white space."""
    at = 0
    while at < len(raw):
        end = at + SEGMENT
        while end < len(raw) and not SPACES[raw[end]]:
            end += 1
        yield at, raw[at:end]
        at = end


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of every word of a byte string: a polynomial of the word's bytes, shifted to the word's start."""
    hashes, starts = [], []
    for at, part in _segments(raw):
        data = np.frombuffer(part, dtype=np.uint8)
        space = SPACES[data]
        edge = np.diff(np.concatenate([[1], space.view(np.int8), [1]]))
        first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        powers = np.cumprod(np.full(len(data), BASE))
        sums = np.concatenate([np.zeros(1, dtype=U), np.cumsum((data.astype(U) + U(1)) * powers)])
        back = np.cumprod(np.full(len(data) + 1, BASE_INVERSE))
        hashes.append(mix((sums[last] - sums[first]) * back[first] + (last - first).astype(U)))
        starts.append(first + at)
    if not hashes:
        return np.zeros(0, dtype=U), np.zeros(0, dtype=np.int64)
    return np.concatenate(hashes), np.concatenate(starts)


def shingle_sets(texts: list[bytes], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of the distinct shingles of all texts (lower-cased bytes), sorted by both.

    A text with fewer words than a shingle has its whole sequence as one; without words it has none.
    """
    lengths = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    words, starts = word_hashes(b"\n".join(texts))
    owner = np.searchsorted(np.cumsum(lengths), starts, side="right")
    count = np.bincount(owner, minlength=len(texts))
    full = len(words) - size + 1
    docs, hashes = [], []
    if full > 0:
        total = np.zeros(full, dtype=U)
        for k in range(size):
            total = total * STEP + words[k:k + full]
        inside = owner[:full] == owner[size - 1:]
        docs.append(owner[:full][inside])
        hashes.append(mix(total[inside], size))
    first = np.concatenate([[0], np.cumsum(count)])
    for d in np.flatnonzero((count > 0) & (count < size)):
        total = np.zeros(1, dtype=U)
        for w in words[first[d]:first[d + 1]]:
            total = total * STEP + w
        docs.append(np.array([d]))
        hashes.append(mix(total, int(count[d])))
    if not docs:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=U)
    doc, h = np.concatenate(docs), np.concatenate(hashes)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    return doc[new], h[new]


def _lower(texts: list[str | None]) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]


def _slices(texts: list, limit: int = 1 << 19) -> Iterator[slice]:
    """Runs of texts of about half a megabyte."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= limit:
            yield slice(start, i + 1)
            start, held = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def _runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of the runs of equal values."""
    if not len(sorted_values):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    start = np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]]))
    return start, np.diff(np.append(start, len(sorted_values)))


def _fingerprints(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents with shingles, their set sizes and set hashes."""
    start, n = _runs(doc)
    return doc[start], n, (mix(np.add.reduceat(mix(h, 99), start) + n.astype(U), 7) if len(start) else h[:0])


def document_sets(docs: DataFrame, id: str, text: str, size: int = SHINGLE) -> DataFrame:
    """id, n_shingles, the hash of the shingle set (null without words) and text_hash of every row."""
    rows = docs.select(F.col(f"`{id}`").alias("__id"), F.col(f"`{text}`").alias("text"), F.xxhash64(f"`{text}`").alias("text_hash"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            n, key = np.zeros(len(texts), dtype=np.int64), np.full(len(texts), None, dtype=object)
            for part in _slices(texts):
                doc, count, fp = _fingerprints(*shingle_sets(_lower(texts[part]), size))
                n[part.start + doc] = count
                key[part.start + doc] = fp.view(np.int64)
            yield pd.DataFrame({"__id": batch["__id"], "n_shingles": n, "class": pd.array(key, dtype="Int64"), "text_hash": batch["text_hash"]})

    return rows.mapInPandas(run, T.StructType([rows.schema["__id"], *[T.StructField(c, T.LongType()) for c in ("n_shingles", "class", "text_hash")]]))


def _pack48(h: np.ndarray) -> bytes:
    return h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpack48(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8")


def _blobs(docs: DataFrame, text: str, parts: int, size: int) -> DataFrame:
    """Shingles by hash part: part, batch, classes, counts (shingles of each class), hashes (48 bits each)."""

    def flush(held: list, batch: int) -> pd.DataFrame:
        key = np.concatenate([np.repeat(fp, n) for fp, n, _ in held])
        h = np.concatenate([x for _, _, x in held])
        part = (h % U(parts)).astype(np.int64)
        order = np.lexsort((h, key, part))
        key, h, part = key[order], h[order] // U(parts), part[order]
        rows = []
        for start, n in zip(*_runs(part), strict=True):
            inner, own = _runs(key[start:start + n])
            rows.append((int(part[start]), batch, key[start + inner].tobytes(), own.astype("<u4").tobytes(), _pack48(h[start:start + n])))
        return pd.DataFrame(rows, columns=["part", "batch", "classes", "counts", "hashes"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext
        batch, held, seen, tokens = TaskContext.get().partitionId() << 32, [], set(), 0
        for frame in batches:
            texts = frame["text"].tolist()
            for part in _slices(texts):
                doc, h = shingle_sets(_lower(texts[part]), size)
                _, n, fp = _fingerprints(doc, h)
                fresh = np.zeros(len(fp), dtype=bool)
                for i, f in enumerate(fp.tolist()):
                    if f not in seen:
                        seen.add(f)
                        fresh[i] = True
                if fresh.any():
                    held.append((fp[fresh], n[fresh], h[np.repeat(fresh, n)]))
                    tokens += int(n[fresh].sum())
                if tokens >= FLUSH_TOKENS:
                    yield flush(held, batch)
                    batch, held, seen, tokens = batch + 1, [], set(), 0
        if held:
            yield flush(held, batch)

    return docs.select(F.col(text).alias("text")).mapInPandas(run, "part int, batch long, classes binary, counts binary, hashes binary")


def _shared(parts: int):
    """Of one hash part: the shingles that two or more classes hold, numbered, and their classes by batch."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("batch")
        part = int(frame["part"].iloc[0])
        key = [np.frombuffer(x, dtype=U) for x in frame["classes"]]
        own = [np.frombuffer(x, dtype="<u4").astype(np.int64) for x in frame["counts"]]
        batch = np.repeat(np.arange(len(frame)), [len(k) for k in key])
        key, own = np.concatenate(key), np.concatenate(own)
        once = np.zeros(len(key), dtype=bool)
        once[np.unique(key, return_index=True)[1]] = True  # copies of a class in later batches are left out
        h = np.concatenate([_unpack48(x) for x in frame["hashes"]])[np.repeat(once, own)]
        holder = np.repeat(np.flatnonzero(once), own[once])
        order = np.argsort(h, kind="stable")
        start, held = _runs(h[order])
        many = held > 1
        token = np.repeat(np.cumsum(many) - 1, held)[np.repeat(many, held)]
        degree = np.repeat(held, held)[np.repeat(many, held)]
        holder = holder[order][np.repeat(many, held)]
        order = np.lexsort((token, holder))
        token, degree, holder = token[order].astype("<u4"), degree[order].astype("<u4"), holder[order]
        rows = []
        numbers = frame["batch"].to_numpy()
        for s, n in zip(*_runs(batch[holder]), strict=True):
            inner, size = _runs(holder[s:s + n])
            rows.append((int(numbers[batch[holder[s]]]), part, key[holder[s + inner]].tobytes(), size.astype("<u4").tobytes(),
                         token[s:s + n].tobytes(), degree[s:s + n].tobytes()))
        return pd.DataFrame(rows, columns=["batch", "part", "classes", "counts", "tokens", "degrees"])

    return run


def prefix_tokens(n: int, tokens: np.ndarray, degrees: np.ndarray, percent: int, order: int) -> np.ndarray:
    """Shared tokens within a set's prefix under one order; the set's other tokens are unique and come first.

    Orders: by degree, ties by a scrambling of the token of the order's own; the last one compares degrees by their
    power of two only.
    """
    length = n - -(-percent * n // 100) + 1
    left = length - (n - len(tokens))
    if left <= 0:
        return tokens[:0]
    rank = degrees if order < ORDERS - 1 else np.floor(np.log2(degrees))
    return tokens[np.lexsort((mix(tokens, order + 11), rank))[:left]]


def _assemble(parts: int, sizes_percent: int):
    """Of one batch: every class's shared tokens and its prefixes under all orders."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        key, token, degree = [], [], []
        for row in frame.itertuples():
            count = np.frombuffer(row.counts, dtype="<u4")
            key.append(np.repeat(np.frombuffer(row.classes, dtype=U), count))
            token.append(np.frombuffer(row.tokens, dtype="<u4").astype(U) * U(parts) + U(row.part))
            degree.append(np.frombuffer(row.degrees, dtype="<u4").astype(np.int64))
        key, token, degree = np.concatenate(key), np.concatenate(token), np.concatenate(degree)
        order = np.lexsort((token, key))
        key, token, degree = key[order], token[order], degree[order]
        rows = [(int(key[s].view(np.int64)), token[s:s + n].tobytes(), degree[s:s + n].astype("<u4").tobytes()) for s, n in zip(*_runs(key), strict=True)]
        return pd.DataFrame(rows, columns=["class", "tokens", "degrees"])

    return run


def _postings(classes: DataFrame, percent: int, parts: int) -> DataFrame:
    """Prefix tokens of all classes by order and part: g (order), part, tokens, classes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            held: dict[int, list] = {k: [] for k in range(ORDERS)}
            for row in frame.itertuples(index=False):
                token, degree = np.frombuffer(row[2], dtype=U), np.frombuffer(row[3], dtype="<u4").astype(np.int64)
                for k in range(ORDERS):
                    pre = prefix_tokens(row[1], token, degree, percent, k)
                    if len(pre):
                        held[k].append((pre, np.full(len(pre), row[0], dtype=np.int64)))
            rows = []
            for k, pairs in held.items():
                if pairs:
                    token, key = np.concatenate([a for a, _ in pairs]), np.concatenate([b for _, b in pairs])
                    part = (mix(token, 5) % U(parts)).astype(np.int64)
                    order = np.argsort(part, kind="stable")
                    token, key = token[order], key[order]
                    rows += [(k, int(part[order[s]]), token[s:s + n].tobytes(), key[s:s + n].tobytes()) for s, n in zip(*_runs(part[order]), strict=True)]
            yield pd.DataFrame(rows, columns=["g", "part", "tokens", "classes"])

    return classes.select("class", "n_shingles", "tokens", "degrees").mapInPandas(run, "g int, part int, tokens binary, classes binary")


def _stars(frame: pd.DataFrame) -> pd.DataFrame:
    """Distinct edges from each token's smallest class to its other ones."""
    token = np.concatenate([np.frombuffer(x, dtype=U) for x in frame["tokens"]])
    key = np.concatenate([np.frombuffer(x, dtype=np.int64) for x in frame["classes"]])
    order = np.lexsort((key, token))
    token, key = token[order], key[order]
    start, n = _runs(token)
    edges = np.column_stack([np.repeat(key[start], n), key])
    edges = np.unique(edges[edges[:, 0] != edges[:, 1]], axis=0)
    return pd.DataFrame({"g": frame["g"].iloc[0], "a": edges[:, 0], "b": edges[:, 1]})


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets: rare tokens by shifted comparison, frequent ones by matrix product."""
    m = len(sets)
    member, token = np.repeat(np.arange(m), [len(s) for s in sets]), np.concatenate(sets)
    order = np.argsort(token, kind="stable")
    member, token = member[order], token[order]
    start, n = _runs(token)
    common = np.zeros((m, m), dtype=np.float32)
    rare = np.repeat(n <= LIGHT, n)
    a, t = member[rare], token[rare]
    for shift in range(1, min(LIGHT, len(t))):
        same = t[shift:] == t[:-shift]
        if not same.any():
            break
        common += np.bincount(a[:-shift][same] * m + a[shift:][same], minlength=m * m).reshape(m, m)
    common += common.T
    heavy = np.flatnonzero(n > LIGHT)
    for first in range(0, len(heavy), 4096):
        some = heavy[first:first + 4096]
        hold = np.zeros((m, len(some)), dtype=np.float32)
        for column, run in enumerate(some):
            hold[member[start[run]:start[run] + n[run]], column] = 1
        common += hold @ hold.T
    return common


def linked(sets: list[np.ndarray], sizes: np.ndarray, side: np.ndarray | None, percent: int) -> np.ndarray:
    """Matrix of links; ``side`` (0 or 1) restricts them to pairs across two tiles."""
    common = np.rint(intersections(sets)).astype(np.int64)
    link = 100 * common >= percent * (sizes[:, None] + sizes[None, :] - common)
    np.fill_diagonal(link, False)
    return link if side is None else link & (side[:, None] != side[None, :])


def _forest(link: np.ndarray) -> np.ndarray:
    """Of every member, the smallest member that it is linked with directly or through others (by repeated minima)."""
    label = np.arange(len(link))
    a, b = np.nonzero(link)
    while len(a):
        low = label.copy()
        np.minimum.at(low, a, label[b])
        low = low[low]
        if (low == label).all():
            break
        label = low
    return label


def _verify(percent: int):
    """Links within groups of rows that follow one another: class, root, links."""

    def one(rows: list[tuple]) -> Iterator[tuple]:
        if len(rows) < 2:
            return
        key, sizes, copies = np.array([r[3] for r in rows]), np.array([r[4] for r in rows]), np.array([r[5] for r in rows])
        side = None if rows[0][1] == rows[0][2] else np.array([int(r[7] == r[2]) for r in rows])
        link = linked([np.frombuffer(r[6], dtype=U) for r in rows], sizes, side, percent)
        root, links = _forest(link), link @ copies
        for i in np.flatnonzero(link.any(axis=1)):
            yield int(key[i]), int(key[root[i]]), int(links[i])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, now, out = [], None, []
        for frame in batches:
            for row in frame.itertuples(index=False, name=None):
                if row[:3] != now:
                    out += one(held)
                    held, now = [], row[:3]
                held.append(row)
            yield pd.DataFrame(out, columns=["class", "root", "links"])
            out = []
        yield pd.DataFrame(list(one(held)), columns=["class", "root", "links"])

    return run


def jaccard_join(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Near-duplicate components: id, n_shingles, component_id, n_links, class, label (smallest class in reach), text_hash.

    * Two rows are linked when 100 * intersection >= percent * union of their shingle sets. ``component_id`` is the
      smallest id within reach; ``n_links`` counts the linked rows, rows of the same set included.
    * Null texts and texts without words have no set, no links and themselves as component. Repeated rows and equal sets
      form one class (null id: counted, and never the smallest). An empty table gives an empty result; other columns are
      not read.
    * Bounds: a task holds one hash part (about a million shingles), one batch of as many, or two tiles of 512 classes.
      A group of copies travels once per batch; near copies are compared by tiles. Nothing but counters reaches the driver.
    """
    bounded_batches(docs)
    sets = stage(document_sets(docs, id, text, size), "sets")
    total = int(sets.agg(F.sum("n_shingles")).first()[0] or 0)
    parts = max(64, -(-total // FLUSH_TOKENS))
    classes = stage(sets.where(F.col("class").isNotNull()).groupBy("class").agg(
        F.min("__id").alias("first"), F.count("*").alias("copies"), F.first("n_shingles").alias("n_shingles")), "classes")
    shared = _blobs(docs, text, parts, size).groupBy("part").applyInPandas(
        _shared(parts), "batch long, part int, classes binary, counts binary, tokens binary, degrees binary")
    held = shared.groupBy("batch").applyInPandas(_assemble(parts, percent), "class long, tokens binary, degrees binary")
    held = stage(held.join(classes, "class"), "shared")
    edges = _postings(held, percent, max(16, parts // 8)).groupBy("g", "part").applyInPandas(_stars, "g int, a long, b long")
    labels = stage(components(edges), "candidates")
    groups = labels.groupBy(F.col("node").alias("class")).agg(
        F.count("*").alias("orders"), *[F.max(F.when(F.col("g") == k, F.col("label"))).alias(f"g{k}") for k in range(ORDERS)])
    groups = stage(groups.where(F.col("orders") == ORDERS).select("class", F.xxhash64(*[f"g{k}" for k in range(ORDERS)]).alias("group")), "groups")
    tiles = groups.groupBy("group").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"), F.count("*").alias("m")).where("m > 1")
    member = held.join(groups, "class").join(stage(tiles, "tiles"), "group").withColumn(
        "own", F.pmod(F.xxhash64("class"), F.col("tiles")).cast("int"))
    member = member.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(
        "group", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "class", "n_shingles", "copies", "tokens", "own")
    spread = member.repartition(F.col("group"), F.col("i"), F.col("j")).sortWithinPartitions("group", "i", "j", "class")
    links = stage(spread.mapInPandas(_verify(percent), "class long, root long, links long"), "links")
    joined = components(links.select(F.lit(0).alias("g"), F.col("class").alias("a"), F.col("root").alias("b")))
    degree = links.groupBy("class").agg(F.sum("links").alias("links"))
    placed = classes.join(joined.select(F.col("node").alias("class"), "label"), "class", "left").join(degree, "class", "left").withColumn(
        "label", F.coalesce("label", "class"))
    placed = stage(placed, "placed")
    firsts = placed.groupBy("label").agg(F.min("first").alias("component"))
    found = stage(placed.join(firsts, "label").select("class", "label", "component", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "found")
    return sets.join(found, "class", "left").select(
        F.col("__id").alias(id), "n_shingles", F.coalesce("component", "__id").alias("component_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "class", "label", "text_hash")


def keep_first(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row of each component, that of the smallest id (null ids last), and every text without words; all columns as they are.

    Of rows with equal id and text one stays.
    """
    found = jaccard_join(docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text")), "id", "text", size, percent)
    one = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("text_hash").alias("hash"))).alias("k")
    grouped = found.where(F.col("label").isNotNull()).groupBy("label").agg(one).select("k.id", "k.hash")
    bare = found.where(F.col("label").isNull()).select("id", F.col("text_hash").alias("hash")).distinct()
    keep = stage(grouped.union(bare).select(F.col("id").alias("__keep"), F.col("hash").alias("__hash")), "kept")
    columns = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*columns)
    key = F.col(columns[docs.columns.index(id)])
    plain = plain.withColumns({"key": key, "hash": F.xxhash64(columns[docs.columns.index(text)])})
    kept = plain.join(keep, plain["key"].eqNullSafe(keep["__keep"]) & (plain["hash"] == keep["__hash"]), "left_semi")
    return kept.dropDuplicates(["key", "hash"]).select(*columns).toDF(*docs.columns)

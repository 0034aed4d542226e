"""Language identification by compression (operator 1).

Each language gets a raw-content zstandard dictionary made of labelled texts. A text belongs to the language whose
dictionary compresses it smallest; it is rejected when the runner-up is nearly as small. A text is compressed in segments
of bounded size and the sizes are added up: a dictionary saves a bounded number of bytes a call, so over a whole long
text the saving, and with it the margin, would vanish.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .text import bounded_batches

NOT_LETTERS = re.compile(r"[\W\d_]+")
UNKNOWN = "und"
# Zeros after every text: without them zstandard stores a short text as it is, whatever the dictionary has.
PAD = bytes(64)
SEGMENT_BYTES = 4096


@dataclass(frozen=True)
class Model:
    """Dictionaries by language, the most frequent language first."""
    dictionaries: tuple[tuple[str, bytes], ...]
    level: int

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        out = []
        for _, content in self.dictionaries:
            data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(level=self.level)
            out.append(zstandard.ZstdCompressor(dict_data=data, level=self.level, write_content_size=False, write_checksum=False, write_dict_id=False))
        return out


def normal(text: str) -> bytes:
    """Lower-cased letters of a text in UTF-8, every other run one space; empty without a letter."""
    letters = NOT_LETTERS.sub(" ", text.lower()).strip()
    return f" {letters} ".encode("utf-8", "replace") if letters else b""


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", samples: int = 40, sample_chars: int = 1500, level: int = 6,
        max_languages: int = 200) -> Model:
    """Dictionaries from a bounded sample: per language ``samples`` distinct texts of the smallest hash, of each one
    window of ``sample_chars`` characters at a hashed place. Null texts and labels are left out; without any labelled
    text the model is empty. More than ``max_languages`` labels are refused.

    Rows are thinned by their hash before they are ranked, so ranking sees a few times ``samples`` rows per language
    however many there are, and a group of copies counts once.
    """
    value = F.col(text)
    rows = labelled.where(value.isNotNull() & F.col(lang).isNotNull()).select(
        F.col(lang).cast("string").alias("lang"), value.alias("text"), F.xxhash64(value).alias("h"))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("h", 0.02).alias("texts"))
    counts = [tuple(r) for r in counts.orderBy(F.desc("n"), "lang").limit(max_languages + 1).collect()]
    if len(counts) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    if not counts:
        return Model((), level)
    share = F.lit(0.0)
    for name, _, texts in counts:
        share = F.when(F.col("lang") == name, min(1.0, 4 * samples / max(1, texts))).otherwise(share)
    thin = rows.where(F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53)) < share)
    place = F.pmod(F.col("h"), F.greatest(F.length("text") - sample_chars + 1, F.lit(1)).cast("long")).cast("int") + 1
    cut = thin.select("lang", "h", F.substring(F.col("text"), place, F.lit(sample_chars)).alias("window")).dropDuplicates(["lang", "h"])
    ranked = cut.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("k") <= samples)
    parts: dict[str, list[bytes]] = {}
    for row in ranked.orderBy("lang", "k").collect():  # at most samples x languages windows
        parts.setdefault(row["lang"], []).append(normal(row["window"]))
    made = tuple((name, b"".join(parts.get(name, []))) for name, _, _ in counts)
    return Model(tuple((name, content) for name, content in made if content), level)


def segments(letters: bytes, most: int = SEGMENT_BYTES) -> list[bytes]:
    """Consecutive pieces of equal size, ``most`` bytes at most, that make up the whole."""
    n = -(-len(letters) // most)
    ends = [len(letters) * i // n for i in range(n + 1)]
    return [letters[a:b] for a, b in zip(ends, ends[1:])]


def _sizes(texts: list[str | None], compressors: list) -> tuple[np.ndarray, np.ndarray]:
    sizes, known = np.zeros((len(texts), len(compressors)), dtype=np.int64), np.zeros(len(texts), dtype=bool)
    for i, text in enumerate(texts):
        letters = normal(text) if text is not None else b""
        if letters:
            known[i] = True
            pieces = [piece + PAD for piece in segments(letters)]
            sizes[i] = [sum(len(c.compress(piece)) for piece in pieces) for c in compressors]
    return sizes, known


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text: str = "text", min_margin: float = 0.01) -> DataFrame:
    """Language of every whole text: the columns ``keep``, lang_pred, score (0 to 1: how much smaller the best size is
    than the second, both summed over all segments), rejected (no language, or a score under ``min_margin``).

    * A null text and a text without a letter give ``und`` with score 0; so does an empty model. Equal sizes go to the
      more frequent language with score 0. With one language the score is 1.
    * Repeated rows get equal results, each its own row; an empty table gives an empty result; other columns are not read.
    * Memory: one Arrow batch and the dictionaries (languages x samples x sample_chars bytes).
    """
    names = [name for name, _ in model.dictionaries]
    kept = [F.col(c).alias(f"__k{i}") for i, c in enumerate(keep)]
    source = f"__k{keep.index(text)}" if text in keep else "__text"  # a text that is kept travels once
    rows = bounded_batches(docs).select(*kept, *([] if text in keep else [F.col(text).alias("__text")]))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compressors = model.compressors()
        for batch in batches:
            texts = batch[source].tolist() if text in keep else batch.pop(source).tolist()
            label, score = np.full(len(texts), UNKNOWN, dtype=object), np.zeros(len(texts))
            if names:
                sizes, known = _sizes(texts, compressors)
                best = sizes.argmin(axis=1)
                label[known] = np.array(names, dtype=object)[best[known]]
                if len(names) > 1:
                    two = np.sort(sizes, axis=1)[:, :2]
                    score[known] = 1 - two[known, 0] / two[known, 1]
                else:
                    score[known] = 1.0
            batch["lang_pred"], batch["score"], batch["rejected"] = label, score, (label == UNKNOWN) | (score < min_margin)
            yield batch

    schema = ", ".join(f"`{c}` {t}" for c, t in rows.drop("__text").dtypes)
    judged = rows.mapInPandas(judge, f"{schema}{', ' if schema else ''}lang_pred string, score double, rejected boolean")
    return judged.withColumnsRenamed({f"__k{i}": c for i, c in enumerate(keep)})


def keep_known(docs: DataFrame, model: Model, text: str = "text", min_margin: float = 0.01) -> DataFrame:
    """The documents whose language is not rejected, with their own columns only, whatever their names."""
    columns = [f"c{i}" for i in range(len(docs.columns))]
    kept = predict(docs.toDF(*columns), model, tuple(columns), columns[docs.columns.index(text)], min_margin).where(~F.col("rejected"))
    return kept.select(*columns).toDF(*docs.columns)

"""Token ids of whole texts, batch by batch, for the packing operators.

Tokenizers that only normalise (NFC, white space, lower case) and split by a pattern that never crosses white space give a
text the ids of its words one after another. For those a batch is cut into words, its distinct words are looked up in one
table of known words, only words that are new to it are encoded, and the ids of all words are gathered with numpy. Any
other tokenizer encodes whole texts.
"""

from __future__ import annotations

import ctypes
import functools
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

# Visible characters that NFC leaves alone and that lower case maps one by one.
LATIN = re.compile("[\x21-\x7e\xa1-\xff]+")
TABLE_BYTES = 24 << 20
GATHER_WORDS = 200_000
# Stands for the end of a document in the table of words; no word has a space.
END = " "


def released(task: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task function that gives freed memory back to the system when it ends: workers are used again by other stages."""
    @functools.wraps(task)
    def run(batches: Iterator) -> Iterator:
        try:
            yield from task(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except AttributeError:  # a C library without it keeps its memory
                pass
    return run


@functools.lru_cache(maxsize=1)
def load(definition: str) -> WordModel:
    """The worker's tokenizer; one is kept, without any words."""
    return WordModel(definition)


class WordModel:
    """A tokenizer and how it spells single words. Its size does not depend on the texts."""

    def __init__(self, definition: str) -> None:
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel
        self.tokenizer = Tokenizer.from_str(definition)
        self.model = self.tokenizer.model
        self.pattern = self._word_pattern(json.loads(definition))
        spell = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.spelling = {c: spell(chr(c))[0][0] for c in range(0xA1, 0x100)}

    @staticmethod
    def _word_pattern(parts: dict) -> regex.Pattern | None:
        """The split pattern if the tokenizer works word by word as described."""
        steps = (parts.get("normalizer") or {}).get("normalizers", [])
        splits = (parts.get("pre_tokenizer") or {}).get("pretokenizers", [])
        added = [t["content"] for t in parts.get("added_tokens", [])]
        by_word = (
            [s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"] and steps[1].get("content") == " "
            and steps[1].get("pattern") == {"Regex": r"\s+"} and [s["type"] for s in splits] == ["Split", "ByteLevel"]
            and splits[0].get("behavior") == "Removed" and splits[0].get("invert") is True and r"[^\s" in splits[0].get("pattern", {}).get("Regex", "")
            and not splits[1].get("add_prefix_space") and not any(" " in t or "\n" in t for t in added))
        return regex.compile(splits[0]["pattern"]["Regex"]) if by_word else None

    def encode(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def words(self, words: list[str]) -> list[list[int]]:
        """Ids of each word. Words of visible Latin-1 characters are split by the tokenizer's own pattern and merged by
        its own model, each piece once a call; all others go through the whole tokenizer."""
        pieces: dict[str, list[int]] = {}

        def piece(part: str) -> list[int]:
            ids = pieces.get(part)
            if ids is None:
                ids = pieces[part] = [t.id for t in self.model.tokenize(part if part.isascii() else part.translate(self.spelling))]
            return ids

        out = []
        for word in words:
            if not word:
                out.append([])
            elif "<|" in word or not LATIN.fullmatch(word):
                out.append(self.encode(word))
            elif word.isalpha():
                out.append(piece(word.lower()))
            else:
                parts = self.pattern.findall(word.lower())
                out.append(piece(parts[0]) if len(parts) == 1 else [i for p in parts for i in piece(p)])
        return out


class BatchEncoder:
    """Ids of the texts of one task, each followed by ``end_id`` where there is one.

    ``self.table`` holds the words seen, with their ids in one flat array; when words and ids together pass ``limit``
    bytes it is cut to the words of the current batch, which the batch's own size bounds. It lives as long as the task.
    """

    def __init__(self, model: WordModel, end_id: int | None, limit: int = TABLE_BYTES) -> None:
        self.model, self.limit = model, limit
        self.end = [] if end_id is None else [int(end_id)]
        self._set(pa.array([END], pa.string()), np.array([len(self.end)], dtype=np.int32), np.array(self.end, dtype="<u4"))

    def _set(self, words: pa.Array, lengths: np.ndarray, ids: np.ndarray) -> None:
        self.table, self.lengths, self.ids = words, lengths, ids
        self.starts = np.concatenate([[0], np.cumsum(lengths[:-1], dtype=np.int64)])

    def _size(self) -> int:
        return self.table.nbytes + self.lengths.nbytes + self.starts.nbytes + self.ids.nbytes

    def _known(self, words: pa.Array) -> np.ndarray:
        """Place of each distinct word in the table; new ones are added."""
        at = pc.index_in(words, value_set=self.table)
        if at.null_count:
            new = words.filter(pc.is_null(at))
            made = self.model.words(new.to_pylist())
            lengths = np.fromiter(map(len, made), dtype=np.int32, count=len(made))
            flat = np.fromiter((i for ids in made for i in ids), dtype="<u4", count=int(lengths.sum()))
            self._set(pa.concat_arrays([self.table, new]), np.concatenate([self.lengths, lengths]), np.concatenate([self.ids, flat]))
            places = np.array(at.fill_null(-1))
            places[places < 0] = np.arange(len(self.table) - len(new), len(self.table))
            at = places
        at = np.array(at, dtype=np.int64)
        if self._size() > self.limit:
            keep = np.concatenate([[0], at])
            self._set(self.table.take(pa.array(keep)), self.lengths[keep], self._gather(keep))
            at = np.arange(1, len(keep), dtype=np.int64)
        return at

    def _gather(self, places: np.ndarray) -> np.ndarray:
        """Ids of the words at these places, one after another, some words at a time."""
        lengths = self.lengths[places]
        out, done = np.empty(int(lengths.sum(dtype=np.int64)), dtype="<u4"), 0
        for first in range(0, len(places), GATHER_WORDS):
            n = lengths[first:first + GATHER_WORDS]
            total = int(n.sum(dtype=np.int64))
            shift = self.starts[places[first:first + GATHER_WORDS]] - (np.cumsum(n, dtype=np.int64) - n)
            out[done:done + total] = self.ids[np.arange(total) + np.repeat(shift, n)]
            done += total
        return out

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order and the number of each text's; a null text is an empty one."""
        if self.model.pattern is None:
            made = [self.model.encode(t or "") + self.end for t in texts.to_pylist()]
            counts = np.fromiter(map(len, made), dtype=np.int64, count=len(made))
            return np.fromiter((i for ids in made for i in ids), dtype="<u4", count=int(counts.sum())), counts
        spaced = pc.replace_substring(texts.fill_null(""), "\n", " ")
        split = pc.split_pattern(spaced, " ")
        words = split.flatten().dictionary_encode()
        places = self._known(words.dictionary)
        per_text = np.diff(np.asarray(split.offsets))
        # The end of every text takes a place of its own after the text's words.
        ends = np.cumsum(per_text) + np.arange(len(per_text))
        every = np.zeros(len(words) + len(per_text), dtype=np.int64)
        inside = np.ones(len(every), dtype=bool)
        inside[ends] = False
        every[inside] = places[np.asarray(words.indices)]
        reach = np.cumsum(self.lengths[every], dtype=np.int64)[ends] if len(ends) else np.zeros(0, dtype=np.int64)
        return self._gather(every), np.diff(np.concatenate([[0], reach]))


def binary(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    """One little-endian byte string per row from flat 4-byte ids, without a copy."""
    offsets = np.concatenate([[0], np.cumsum(counts) * 4]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(ids))])

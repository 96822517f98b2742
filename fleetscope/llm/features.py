"""Hashed n-gram indicators of a text, computed inside a task."""

from __future__ import annotations

import string
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash

from fleetscope.llm.common import Lookup, mix

BITS = 20
WIDTH = 1 << BITS
EDGES = string.punctuation + "“”„«»…–—¿¡’‘"


def plain(word: str) -> str:
    """Lower case without the punctuation around it; a word of punctuation alone stays."""
    return word.strip(EDGES).lower() or word


def describe(word: str) -> tuple[int, tuple]:
    """Hash of the plain word, and its shape: letter case, marks around it and a rough length."""
    core = word.strip(EDGES)
    if not core:
        return xxhash.xxh3_64_intdigest(word), ("m", word[:3])
    low = core.lower()
    if low == core:
        case = "9" if core.isdigit() else "x"
    else:
        case = "X" if core.isupper() else "Xx" if core[0].isupper() else "?"
    marks = () if len(core) == len(word) else (word[: word.find(core[0])][:2], word[len(word.rstrip(EDGES)) :][:3])
    return xxhash.xxh3_64_intdigest(low), (case, min(len(core) // 4, 4), *marks)


class WordTable:
    """Numbers of words, with the hashes of the word and of its shape in arrays by number."""

    def __init__(self, start: int = 1 << 16):
        self.hashes, self.shapes = np.zeros(start, np.uint64), np.zeros(start, np.uint64)
        self.of_shape = Lookup(lambda kind: xxhash.xxh3_64_intdigest(repr(kind), 7))
        self.number = Lookup(self.add)

    def add(self, word: str) -> int:
        at = len(self.number)
        if at == len(self.hashes):
            self.hashes, self.shapes = np.resize(self.hashes, 2 * at), np.resize(self.shapes, 2 * at)
        self.hashes[at], kind = describe(word)
        self.shapes[at] = self.of_shape[kind]
        return at

    def __call__(self, tokens: list[str]) -> np.ndarray:
        self.number.trim()
        self.of_shape.trim()
        return np.fromiter(map(self.number.__getitem__, tokens), np.int64, len(tokens))


def pieces(word: str, size: int = 4) -> set[int]:
    """Buckets of the word and of its runs of bytes, its edges marked, so that inflected forms share features."""
    core = f"^{plain(word)}$".encode()
    found = {crc32(core[at : at + size]) >> (32 - BITS) for at in range(len(core) - size + 1)}
    found.add(crc32(core) >> (32 - BITS))
    return found


def all_pieces(text: str | None, of_word: Lookup) -> list[int]:
    """Distinct buckets of all words of a text."""
    of_word.trim()
    return sorted(set().union(*map(of_word.__getitem__, set((text or "").split()))))


def runs(hashes: np.ndarray, size: int) -> list[np.ndarray]:
    """Hashes of all runs of 1 to ``size`` neighbours."""
    found = [mix(hashes)]
    for _ in range(1, size):
        longer = found[-1][:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[len(found) :]
        found.append(mix(longer))
    return found


def distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    first = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=first[1:])
    return values[first]


class NGrams:
    """Distinct buckets of a text's n-grams: words up to ``words`` long, word shapes up to ``shapes`` long."""

    def __init__(self, words: int, shapes: int):
        self.words, self.shapes, self.table = words, shapes, WordTable()

    def __call__(self, text: str | None) -> np.ndarray:
        tokens = (text or "").split()
        if not tokens:
            return np.empty(0, np.int32)
        number = self.table(tokens)
        kinds = self.table.shapes[number]
        kinds[1:] += (number[1:] == number[:-1]).astype(np.uint64)  # a word that repeats the one before is another kind
        found = runs(self.table.hashes[number], self.words) + runs(kinds, self.shapes)
        return distinct((np.concatenate(found) >> np.uint64(64 - BITS)).astype(np.int32))


def list_rows(column) -> list[np.ndarray]:
    """The lists of an Arrow column as views of one array, without a Python number for each entry."""
    if not len(column):
        return []
    lists = column.combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.chunk(0)
    ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    values = lists.flatten().to_numpy(zero_copy_only=False)
    return [values[start:end] for start, end in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def sparse(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and buckets of all entries, row after row."""
    sizes = np.array([len(row) for row in rows], np.int64)
    columns = np.concatenate(rows).astype(np.int32) if rows else np.empty(0, np.int32)
    return np.repeat(np.arange(len(rows), dtype=np.int32), sizes), columns


def keep_frequent(row: np.ndarray, column: np.ndarray, least: int) -> np.ndarray:
    """Which entries belong to buckets of at least ``least`` rows."""
    return np.bincount(column, minlength=WIDTH)[column] >= least


def sigmoid(value):
    return 1.0 / (1.0 + np.exp(-np.clip(value, -60.0, 60.0)))

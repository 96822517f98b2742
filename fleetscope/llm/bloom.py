"""Bloom filters of 64-bit keys: built by tasks, combined in a tree, of a bounded size."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from fleetscope.llm.common import mix

HASHES = 3


def places(keys: np.ndarray, bits: int):
    for round_ in range(1, HASHES + 1):
        yield (mix(keys + np.uint64(round_ * 0x9E3779B97F4A7C15 % (1 << 64))) >> np.uint64(64 - bits)).astype(np.int64)


def build(rows: DataFrame, key: Callable[[pa.RecordBatch], np.ndarray], most_bits: int = 30) -> np.ndarray:
    """A filter with 16 bits a row, up to ``2**most_bits`` in all; beyond that it lets more keys through, never fewer."""
    bits = min(most_bits, max(16, math.ceil(math.log2(16 * rows.count() + 1))))

    def mark(batches):
        table = np.zeros(1 << (bits - 3), np.uint8)
        for batch in batches:
            for place in places(key(batch), bits):
                np.bitwise_or.at(table, place >> 3, (1 << (place & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_pydict({"table": pa.array([zstandard.ZstdCompressor(level=1).compress(table.tobytes())], pa.binary())})

    def either(tables):
        joined = np.zeros(1 << (bits - 3), np.uint8)
        for row in tables:
            joined |= np.frombuffer(zstandard.ZstdDecompressor().decompress(row.table), np.uint8)
        yield joined

    marked = rows.mapInArrow(mark, "table binary").rdd.mapPartitions(either)
    return marked.treeReduce(np.bitwise_or) if marked.getNumPartitions() else np.zeros(1 << (bits - 3), np.uint8)


def passes(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys may be in the filter."""
    bits = len(table).bit_length() + 2
    passed = np.ones(len(keys), bool)
    for place in places(keys, bits):
        passed &= (table[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
    return passed

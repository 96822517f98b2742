"""Operator 3: byte-level BPE by a global shuffle of distinct words.

Texts are read in blocks. A block is exploded into pre-tokens with their positions: its distinct words, and for
every position the number of its word. The words alone are dealt out by their hash, so that each distinct word of
the corpus meets in one task and is encoded there once; the ids go back to the blocks, and the positions of a block
turn them into the ids of its texts. Words and positions travel packed, a row for each block and word bucket: a word
that stands everywhere costs one entry for each block, however often it occurs.

Decoding joins ids with the table of token bytes (bounded by the vocabulary), in order.

Edge cases: a missing text counts as empty and has no ids. Rows are independent: repeated and missing ``doc_id``
values are allowed. A text longer than a block is a block of its own. An empty table gives no rows.

The two readings of ``docs`` must see the same rows in the same order, which holds for a table on disk; anything else
is written to the shared folder first (``on_disk=False``).
"""

from __future__ import annotations

from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
import tiktoken
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from fleetscope.llm.common import Lookup, bounded_batches, materialize, tidy
from fleetscope.llm.pretokens import load_ranks, split_text

BETWEEN = b"\xff"  # never part of UTF-8
PACKED = "block long, bucket int, n int, data binary"


def pack(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).tobytes())


def unpack(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def blocks(batches, most: int):
    """(block number, ids, texts) of the task's rows, about ``most`` characters each."""
    ids, texts, held, number = [], [], 0, 0
    for batch in batches:
        if batch.num_rows:
            base = batch.column("part")[0].as_py() << 32
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            ids.append(doc_id)
            texts.append(text or "")
            held += len(texts[-1])
            if held >= most:
                yield base + number, ids, texts
                ids, texts, held, number = [], [], 0, number + 1
    if ids:
        yield base + number, ids, texts


class Block:
    """Distinct pre-tokens of the texts of a block, numbered as they come."""

    def __init__(self, pattern):
        self.pattern, self.number = pattern, {}
        self.packed: tuple[dict[str, bytes], dict[str, bytes]] = {}, {}  # numbers by segment, and by segment without its blank

    def _meet(self, pieces, packed: dict[str, bytes], blank: str) -> None:
        """Cut the segments that are new. Those that begin with a blank are cut as one text, since that leaves the
        places between them as they are."""
        fresh = [piece for piece in dict.fromkeys(pieces) if piece not in packed]
        joined = fresh if blank else []
        for piece in [] if blank else fresh:
            packed[piece] = self._numbers(self.pattern.findall(piece)).tobytes()
        if joined:
            words = self.pattern.findall(blank + blank.join(joined))
            numbers = self._numbers(words).tobytes()
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
            lengths = np.fromiter(map(len, joined), np.int64, len(joined)) + 1
            splits = 4 * (np.searchsorted(ends, np.cumsum(lengths)) + 1)
            start = 0
            for piece, end in zip(joined, splits.tolist(), strict=True):
                packed[piece] = numbers[start:end]
                start = end

    def _numbers(self, words: list[str]) -> np.ndarray:
        number = self.number
        return np.array([number.setdefault(word, len(number)) for word in words], np.uint32)

    def numbers(self, text: str) -> bytes:
        """Numbers of the text's pre-tokens, in order."""
        first, rest = split_text(text)
        self._meet(first, self.packed[0], "")
        self._meet(rest, self.packed[1], " ")
        return b"".join([*map(self.packed[0].__getitem__, first), *map(self.packed[1].__getitem__, rest)])

    def dealt(self, buckets: int) -> tuple[list[list[bytes]], np.ndarray]:
        """The words by bucket and in order, and the place of every number in that order."""
        words = [word.encode() for word in self.number]
        keys = [(crc32(word) % buckets, word, at) for at, word in enumerate(words)]
        keys.sort()
        made: list[list[bytes]] = [[] for _ in range(buckets)]
        place = np.empty(len(words), np.uint32)
        for spot, (bucket, word, at) in enumerate(keys):
            made[bucket].append(word)
            place[at] = spot
        return made, place


def take(starts: np.ndarray, counts: np.ndarray, values: np.ndarray) -> np.ndarray:
    """``values[start : start + count]`` of all pairs, one after another."""
    ends = np.cumsum(counts)
    shift = np.repeat(starts - (ends - counts), counts)
    return values[shift + np.arange(ends[-1] if len(ends) else 0)]


def encode(docs: DataFrame, ranks_path: str, pattern: str, buckets: int | None = None, most: int = 12_000_000, on_disk: bool = True) -> DataFrame:
    """``doc_id``, ``n_tokens`` and ``ids`` (little-endian unsigned 32-bit integers), a row for each row of ``docs``.

    ``buckets`` deals out the distinct words (as many as shuffle partitions unless given), ``most`` bounds the
    characters of a block.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    count = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if not on_disk:
        rows = materialize(rows, "texts")
    rows = rows.withColumn("part", F.spark_partition_id())

    def words(batches):
        cut = regex.compile(pattern)
        for number, _, texts in blocks(batches, most):
            block = Block(cut)
            for text in texts:
                block.numbers(text)
            del texts
            dealt = block.dealt(count)[0]
            del block
            packer = zstandard.ZstdCompressor(level=3)
            filled = [bucket for bucket in range(count) if dealt[bucket]]
            yield pa.RecordBatch.from_pydict(
                {
                    "block": pa.array([number] * len(filled), pa.int64()),
                    "bucket": pa.array(filled, pa.int32()),
                    "n": pa.array([len(dealt[bucket]) for bucket in filled], pa.int32()),
                    "data": pa.array([packer.compress(BETWEEN.join(dealt[bucket])) for bucket in filled], pa.binary()),
                }
            )

    def positions(batches):
        cut = regex.compile(pattern)
        for number, ids, texts in blocks(batches, most):
            block = Block(cut)
            whole = [block.numbers(text) for text in texts]
            del texts
            known = np.array([doc_id is not None for doc_id in ids], np.uint8)
            head = np.array([(doc_id or 0, len(data) // 4) for doc_id, data in zip(ids, whole, strict=True)], np.int64)
            place = block.dealt(count)[1]
            del block
            numbers = place[np.frombuffer(b"".join(whole), np.uint32)]
            del whole
            data = zstandard.ZstdCompressor(level=1).compress(known.tobytes() + head.tobytes() + numbers.tobytes())
            yield pa.RecordBatch.from_pydict(
                {"block": pa.array([number], pa.int64()), "bucket": pa.array([-1], pa.int32()), "n": pa.array([len(ids)], pa.int32()), "data": pa.array([data], pa.binary())}
            )

    def encode_words(batches):
        coder = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=load_ranks(ranks_path), special_tokens={})
        known = Lookup(lambda word: coder.encode_ordinary(word.decode()))
        reader = zstandard.ZstdDecompressor()
        for batch in batches:
            packed = []
            for data in batch.column("data").to_pylist():
                found = [known[word] for word in reader.decompress(data).split(BETWEEN)]
                known.trim()
                sizes = np.array([len(ids) for ids in found], np.uint32)
                packed.append(pack(np.append(sizes, np.fromiter(chain.from_iterable(found), np.uint32))))
            yield batch.set_column(3, "data", pa.array(packed, pa.binary()))

    def assemble(table: pa.Table) -> pa.Table:
        order = table.sort_by("bucket").to_pylist()
        heads, tails = [], []
        for row in order[1:]:
            values = unpack(row["data"], np.uint32)
            heads.append(values[: row["n"]].astype(np.int64))
            tails.append(values[row["n"] :])
        sizes = np.concatenate(heads) if heads else np.empty(0, np.int64)
        values = np.concatenate(tails) if tails else np.empty(0, np.uint32)
        starts = np.cumsum(sizes) - sizes
        n, raw = order[0]["n"], zstandard.ZstdDecompressor().decompress(order[0]["data"])
        known = np.frombuffer(raw, np.uint8, n)
        doc_ids, lengths = np.frombuffer(raw[n : 17 * n], np.int64).reshape(-1, 2).T
        numbers = np.frombuffer(raw[17 * n :], np.uint32)
        made, counts, at = [], [], 0
        for length in lengths.tolist():
            number = numbers[at : at + length]
            at += length
            ids = take(starts[number], sizes[number], values)
            counts.append(len(ids))
            made.append(ids.astype("<u4").tobytes())
        return pa.Table.from_pydict(
            {
                "doc_id": pa.array(doc_ids, pa.int64(), mask=known == 0),
                "n_tokens": pa.array(counts, pa.int64()),
                "ids": pa.array(made, pa.binary()),
            }
        )

    encoded = rows.mapInArrow(tidy(words), PACKED).repartition(count, "bucket").mapInArrow(tidy(encode_words), PACKED)
    packed = encoded.unionByName(rows.mapInArrow(tidy(positions), PACKED))
    return packed.groupBy("block").applyInArrow(assemble, "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """``encoded`` with ``decoded``, the bytes of its ``ids`` by the table of token bytes."""
    if "decoded" in encoded.columns:
        encoded = encoded.drop("decoded")
    place = encoded.columns.index("ids")

    def work(batches):
        token = {rank: data for data, rank in load_ranks(ranks_path).items()}.__getitem__
        for batch in batches:
            texts = [None if ids is None else b"".join(map(token, np.frombuffer(ids, "<u4").tolist())) for ids in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], [*batch.schema.names, "decoded"])

    return encoded.mapInArrow(tidy(work), StructType([*encoded.schema.fields, StructField("decoded", BinaryType())]))

"""Operator 5: token ids in ORC files.

Rows are ranged and sorted by ``doc_id`` and written by Spark's ORC writer: integer columns are run-length encoded in
stripes, every ``stride`` rows get a row index, and a Bloom filter on ``doc_id`` lets a reader skip stripes. Readers
take stripes in parallel. ``part`` numbers the ranges, so that the offset of a document is the sum of the earlier
ranges (one row a range) plus a running sum inside its range; no task sees more than one range.

Edge cases: a missing text counts as empty and holds the end id alone. Rows without ``doc_id`` come first; rows with
equal ids keep one order, by the ids they hold. An empty table gives files without rows.
"""

from __future__ import annotations

from array import array
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fleetscope.llm.common import Lookup, bounded_batches, materialize, worker_cache
from fleetscope.llm.pretokens import PATTERN, split_text

SCHEMA = "part int, doc_id long, ids array<int>"


class SegmentCoder:
    """Ids of texts as little-endian 32-bit integers.

    A byte-level tokenizer without normalizer treats segments alike wherever they stand, so each is given to its model
    once and looked up after that; any other tokenizer gets whole texts.
    """

    def __init__(self, path: str, most: int = 1_000_000):
        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.known, self.behind_blank = Lookup(self.ids), Lookup(self.ids_behind_blank)
        parts = self.tokenizer.pre_tokenizer
        self.plain = self.tokenizer.normalizer is None and repr(parts).startswith("ByteLevel(add_prefix_space=False") and "use_regex=True" in repr(parts)
        self.special = {token.content: at for at, token in self.tokenizer.get_added_tokens_decoder().items()}
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [byte for byte in range(256) if byte not in set(printable)]
        letters = {byte: byte for byte in printable} | {byte: 256 + at for at, byte in enumerate(others)}
        self.letters = "".join(chr(letters[byte]) for byte in range(256))
        self.blank = self.letters[ord(" ")]
        self.cut, self.tokenize = regex.compile(PATTERN).findall, self.tokenizer.model.tokenize

    def shown(self, piece: str) -> str:
        """The piece with a letter for each of its bytes."""
        return piece.encode().decode("latin-1").translate(self.letters)

    def ids(self, segment: str) -> bytes:
        """Ids of a segment; letters alone are one pre-token."""
        if segment.isalpha():
            return array("I", [token.id for token in self.tokenize(segment if segment.isascii() else self.shown(segment))]).tobytes()
        return array("I", [token.id for piece in self.cut(segment) for token in self.tokenize(self.shown(piece))]).tobytes()

    def ids_behind_blank(self, segment: str) -> bytes:
        """Ids of a blank and the segment."""
        if segment.isalpha():
            return array("I", [token.id for token in self.tokenize(self.blank + (segment if segment.isascii() else self.shown(segment)))]).tobytes()
        return self.ids(" " + segment)

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.plain or any(token in text for token in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        known, behind = self.known, self.behind_blank
        if len(known) + len(behind) > self.most:
            known.clear()
            behind.clear()
        first, rest = split_text(text)
        return b"".join([*map(known.__getitem__, first), *map(behind.__getitem__, rest)])


def tokenize(docs: DataFrame, path: str, end: int = 2) -> DataFrame:
    """``doc_id`` and ``ids`` with the end id, by the tokenizer file at ``path``, which every machine has."""

    tail = np.array([end], "<u4").tobytes()

    def work(batches):
        code = worker_cache(f"segments {path}", lambda: SegmentCoder(path))
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                made = [code(text) + tail for text in part.column("text").to_pylist()]
                ends = np.cumsum([0, *[len(data) // 4 for data in made]]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(made), "<i4")))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, ids array<int>")


def write_tokens(docs: DataFrame, folder: str, path: str, end: int = 2, parts: int | None = None, stride: int = 1000) -> None:
    """Write ORC files in ascending order of ``doc_id``. Texts are tokenized after they are dealt out by range."""
    spark = docs.sparkSession
    bounded_batches(spark)
    count = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = docs.select("doc_id", "text").repartitionByRange(count, F.col("doc_id").asc_nulls_first())
    numbered = tokenize(ranged, path, end).select(F.spark_partition_id().alias("part"), "doc_id", "ids")
    (
        numbered.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "ids")
        .write.option("orc.compress", "ZSTD")
        .option("orc.row.index.stride", stride)
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", 0.01)
        .orc(folder)
    )


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(SCHEMA).orc(folder)


def token_index(tokens: DataFrame) -> DataFrame:
    """By document: ``start`` (ids of all documents before it), ``n_tokens`` and ``ids_crc32``."""

    def work(batches):
        for batch in batches:
            ids = batch.column("ids")
            flat, ends = ids.flatten().to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
            ends = ends - ends[0]
            sums = [crc32(np.ascontiguousarray(flat[a:b], "<i4").tobytes()) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("part"), batch.column("doc_id"), pa.array(np.diff(ends), pa.int64()), pa.array(sums, pa.int64())],
                ["part", "doc_id", "n_tokens", "ids_crc32"],
            )

    # The files are read once: sizes and sums are a small table, which totals and offsets are made of.
    sized = materialize(tokens.select("part", "doc_id", "ids").mapInArrow(work, "part int, doc_id long, n_tokens long, ids_crc32 long"), "sizes")
    order = [F.col("doc_id").asc_nulls_first(), "n_tokens", "ids_crc32"]
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    totals = sized.groupBy("part").agg(F.sum("n_tokens").alias("held"))
    totals = totals.select("part", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("earlier"))
    local = sized.withColumn("start", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return local.join(F.broadcast(totals), "part").select("doc_id", (F.col("earlier") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")

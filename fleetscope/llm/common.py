"""Small helpers of the operators: shared folder, tables, word and feature arrays inside tasks."""

from __future__ import annotations

import ctypes
import sys
import uuid
from contextlib import contextmanager
from contextvars import ContextVar
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetscope.functions.runtime import cut_lineage, delete, store

#: Words kept in a task's look-up table before it starts afresh; bounds the memory of a task, not its result.
CACHE_WORDS = 400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new folder below the one that all executors share (``spark.checkpoint.dir``)."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        cut_lineage(spark.range(1))
    return f"{context.getCheckpointDir()}/{kind}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, kind: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the work is done once and survives lost executors."""
    spark = df.sparkSession
    folder = shared_folder(spark, kind)
    store(df, folder)
    give_back()  # the driver's own
    for scope in _SCOPES.get()[-1:]:
        scope.add(folder)
    table = spark.read.schema(df.schema).parquet(folder)
    table._materialized_in = folder
    return table


_SCOPES: ContextVar[tuple[set[str], ...]] = ContextVar("scopes", default=())


@contextmanager
def scratch(spark: SparkSession):
    """What ``materialize`` writes inside is deleted at the end, except for what ``keep`` got; nothing may read it after that."""
    made: set[str] = set()
    outer = _SCOPES.set((*_SCOPES.get(), made))
    try:
        yield
    finally:
        _SCOPES.reset(outer)
        for folder in made:
            delete(spark, folder)


def keep(*tables: DataFrame) -> None:
    for scope in _SCOPES.get():
        scope -= {getattr(table, "_materialized_in", None) for table in tables}


def discard(table: DataFrame) -> None:
    """Delete what ``materialize`` has written for ``table``, as nothing reads it any more."""
    keep(table)
    delete(table.sparkSession, table._materialized_in)


def bounded_batches(spark: SparkSession, rows: int = 500) -> None:
    """Rows handed to Python at a time, for this session: a batch of long texts stays small on both sides."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def fold(column: str, parts: int):
    """``crc32`` of the id as text, modulo ``parts``; a missing id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % parts


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, parts: int, held: int, most: int) -> DataFrame:
    """Texts and labels of at most ``most`` labelled rows of the training folds.

    Rows are drawn by the hash of the id, so every label is as likely as another and a rerun draws the same.
    Ids without label or with several different labels are not used. The drawn ids are bounded by ``most``,
    so they are broadcast; the texts stay where they are read.
    """
    known = (
        labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("label"))
        .where(F.col("_id").isNotNull() & F.col("label").isin(0, 1))
        .groupBy("_id")
        .agg(F.min("label").alias("label"), F.max("label").alias("other"))
        .where((F.col("label") == F.col("other")) & (fold("_id", parts) != held))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(most)
        .select("_id", "label")
    )
    texts = docs.select(F.col("doc_id").alias("_id"), "text")
    return texts.join(F.broadcast(known), "_id").select("_id", "text", "label")


class Lookup(dict):
    """word -> value by ``make``, forgotten when it holds more than ``CACHE_WORDS`` words."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, word):
        value = self[word] = self.make(word)
        return value

    def trim(self, most: int = CACHE_WORDS) -> None:
        if len(self) > most:
            self.clear()


def worker_cache(name: str, make):
    """An object kept in a Python worker from task to task, such as a table of words seen before."""
    kept = sys.modules.setdefault("_fleetscope_worker", ModuleType("_fleetscope_worker")).__dict__
    if name not in kept:
        kept[name] = make()
    return kept[name]


def give_back() -> None:
    """Return free memory to the system: a Python worker lives on, and what it keeps for itself counts in the next stage."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(work):
    """``work`` over Arrow batches that leaves its worker small, and is not held up by what others left there."""

    def run(batches):
        give_back()
        yield from work(batches)
        give_back()

    return run


def mix(values: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash, element by element."""
    values = values ^ (values >> np.uint64(30))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values = values ^ (values >> np.uint64(27))
    values = values * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def ngram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of all runs of ``size`` words, given the words' 64-bit hashes."""
    count = len(words) - size + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    hashed = np.full(count, size, np.uint64)
    for at in range(size):
        hashed = mix((hashed + words[at : at + count]) * np.uint64(0x9E3779B97F4A7C15))
    return hashed

"""Session settings and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def tune(spark: SparkSession) -> SparkSession:
    """Let adaptive execution split a hot module or application, also below a later aggregation."""
    for key in (
        "spark.sql.adaptive.enabled",
        "spark.sql.adaptive.skewJoin.enabled",
        "spark.sql.adaptive.forceOptimizeSkewedJoin",
    ):
        spark.conf.set(key, "true")
    return spark


def bounded_batches(spark: SparkSession, files: int = 200) -> None:
    """Files handed to Python at a time, for this session, and about their bytes: both sides hold a batch of them, not ten thousand."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", files)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20)


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder of the cluster (``spark.checkpoint.dir``); a temporary one only in a local session without it."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
            folder = tempfile.mkdtemp(prefix="fleetscope-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def new_folder(spark: SparkSession, kind: str) -> str:
    """A new folder for files below the shared one."""
    return f"{checkpoint_folder(spark)}/{kind}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint to the shared folder, so that lost executors cost no earlier work."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


#: Bytes of a row group of a table written on the way: a task holds that of the file it writes, and reads whole columns of one.
ROW_GROUP = 16 << 20
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def store(df: DataFrame, folder: str) -> None:
    """Write ``df`` to ``folder``; its shuffle files go with the last row, not when the driver happens to collect garbage.

    A query of many such steps then needs disk for its tables and for the largest step, however long it runs.
    """
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, "false")
    conf.set(_CLEANUP, "true")
    try:
        df.write.option("parquet.block.size", ROW_GROUP).parquet(folder)
    finally:
        conf.set(_CLEANUP, before)


def delete(spark: SparkSession, folder: str) -> None:
    """Delete a folder of this query's own, in whatever store it is."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame) -> DataFrame:
    """A table in the shared folder in place of ``df``.

    Like a checkpoint, but nothing of the old plan is left: a checkpoint keeps what the optimizer knew of its columns, and
    in a loop that joins its own results this grows until planning takes longer than the work.
    """
    folder = new_folder(df.sparkSession, "round")
    store(df, folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` for joins that may not send it to the driver.

    Tables made of texts pack well, so that files of a few MB, for which Spark broadcasts, can be hundreds of MB of rows.
    """
    return df.hint("shuffle_hash")


def spillable(df: DataFrame) -> DataFrame:
    """Like ``shuffled`` for rows with texts: a task may hold more of them than its memory, and sorted rows spill, hash tables don't."""
    return df.hint("merge")

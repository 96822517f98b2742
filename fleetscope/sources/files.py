"""Artifact files: one row per file, (app_id, path, content)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TEST_MARK = "/src/test/"
#: Bytes of text that are worth a task of their own, and the most that a task should get.
SMALL_TASK, LARGE_TASK = 1 << 20, 128 << 20


_STORE = r"^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?"


def _qualified(spark: SparkSession, root: str) -> str:
    """``root`` as the file system names it, without scheme and host."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return re.sub(_STORE, "", store.makeQualified(path).toString()).rstrip("/")


def read_artifacts(spark: SparkSession, root: str, name_glob: str = "*") -> DataFrame:
    """Every text file below ``root``: (app_id, path, content).

    The first directory below ``root`` is the application, and ``path`` is relative to it; files
    directly in ``root`` belong to no application and are left out.
    """
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=name_glob)
    # File paths are percent-encoded; a plus sign stands for itself.
    path = F.try_url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    below = F.substring(F.regexp_replace(path, _STORE, ""), len(_qualified(spark, root)) + 2, 1 << 30)
    app = F.substring_index(below, "/", 1)
    inside = files.select(app.alias("app_id"), below.alias("below"), F.col("value").alias("content")).where(F.instr("below", "/") > 0)
    relative = F.substring("below", F.length("app_id") + 2, F.length("below"))
    return inside.select("app_id", relative.alias("path"), "content")


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def directory(path: Column) -> Column:
    """Path without the file name; the empty string for a bare name."""
    return F.regexp_extract(path, "(?s)^(.*)/[^/]*$", 1)


def scan_artifacts(files: DataFrame, name_part: str, path_part: str = "") -> DataFrame:
    """Files whose name contains ``name_part`` and whose directory contains ``path_part``."""
    return files.where(
        file_name(F.col("path")).contains(name_part) & directory(F.col("path")).contains(path_part)
    )


# Usual names: docker-compose.yml, docker-compose.prod.yaml, compose.yml, compose-dev.yaml and the like.
_COMPOSE_NAMES = r"(?i)(?:^|/)(?:[^/]*docker-compose[^/]*|compose(?:[.-][^/]*)?\.ya?ml)$"
CONFIG_NAMES = r"\.(?:yml|yaml|properties)$"


def compose_candidates(files: DataFrame) -> DataFrame:
    """Files named like compose files."""
    return files.where(F.col("path").rlike(_COMPOSE_NAMES))


def exclude_test_sources(files: DataFrame) -> DataFrame:
    return files.where(~F.col("path").contains(TEST_MARK))


def balanced(files: DataFrame) -> DataFrame:
    """Files dealt out by the bytes of their contents: parsing costs far more than moving them, so what makes a good
    shuffle partition, or comes from one small input file, is far too much for one task."""
    size = files.agg(F.sum(F.octet_length("content"))).first()[0] or 0
    cores = files.sparkSession.sparkContext.defaultParallelism
    tasks = max(size // LARGE_TASK, min(size // SMALL_TASK, 4 * cores))
    return files.repartition(int(tasks) + 1)


def text_lines(content: Column) -> Column:
    return F.split(content, "\r\n|\n|\r")


def discover_modules(containers: DataFrame, files: DataFrame) -> DataFrame:
    """Directories right below the application root that are named like a container.

    One row per module: its directory and, if the directory holds one, its build file. Paths are
    relative to the application root.
    """
    parts = F.split("path", "/")
    below = files.where(F.size(parts) > 1).select(
        "app_id",
        F.get(parts, F.lit(0)).alias("directory"),
        F.when((F.size(parts) == 2) & (file_name(F.col("path")) == "pom.xml"), F.col("path")).alias("build_file"),
    )
    directories = below.groupBy("app_id", "directory").agg(F.min("build_file").alias("build_file"))
    names = containers.select("app_id", F.col("name").alias("directory")).distinct()
    return directories.join(names, ["app_id", "directory"], "left_semi")


def validate_app_inputs(apps: DataFrame) -> DataFrame:
    """Adds ``reasons`` (empty when accepted).

    Expects name, root, output and the counts compose_files and module_dirs.
    """
    from fleetscope.rules import FORBIDDEN_NAME_CHARACTERS

    forbidden = "[" + "".join("\\" + mark for mark in FORBIDDEN_NAME_CHARACTERS) + "]"
    checks = (
        ("name is missing", _blank("name")),
        ("name has a forbidden character", F.coalesce(F.col("name").rlike(forbidden), F.lit(False))),
        ("root is missing", _blank("root")),
        ("no compose file", F.coalesce(F.col("compose_files"), F.lit(0)) < 1),
        ("no module directory", F.coalesce(F.col("module_dirs"), F.lit(0)) < 1),
        ("output is missing", _blank("output")),
    )
    return apps.withColumn(
        "reasons", F.array_compact(F.array(*[F.when(failed, F.lit(reason)) for reason, failed in checks]))
    )


def _blank(column: str) -> Column:
    return F.trim(F.coalesce(F.col(column), F.lit(""))) == ""

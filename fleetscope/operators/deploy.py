"""Containers of a fleet from compose rows and Dockerfiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetscope.functions.matching import join_contains
from fleetscope.functions.runtime import shuffled

CONTAINER = ["app_id", "container"]


def with_order(compose_rows: DataFrame) -> DataFrame:
    """Position over all compose files of an application: files by path, lines by position."""
    if "file_no" in compose_rows.columns:
        files = compose_rows
    else:
        files = compose_rows.withColumn("file_no", F.col("path"))
    return files.withColumn("ord", F.struct("file_no", "pos"))


def _non_empty(value):
    return F.when(F.coalesce(value, F.lit("")) != "", value)


def merge_containers(compose_rows: DataFrame) -> DataFrame:
    """One row per container name: first file, first non-empty image and build, any logging."""
    image = _non_empty(F.when((F.col("key") == "image") & F.col("sub").isNull(), F.col("value")))
    build = _non_empty(
        F.when((F.col("key") == "build") & (F.col("sub").isNull() | (F.col("sub") == "context")), F.col("value"))
    )
    ordered = with_order(compose_rows).withColumn("image", image).withColumn("build", build)
    return ordered.groupBy(*CONTAINER).agg(
        F.min("ord").alias("ord"),
        F.min_by("path", "ord").alias("artifact"),
        F.coalesce(F.min_by("image", F.when(F.col("image").isNotNull(), F.col("ord"))), F.lit("")).alias("image"),
        F.coalesce(F.min_by("build", F.when(F.col("build").isNotNull(), F.col("ord"))), F.lit("")).alias("build"),
        F.max(F.col("key").isin("logging", "log_opt")).alias("generates_logs"),
    )


def _listed(compose_rows: DataFrame, first: str, second: str, name: str) -> DataFrame:
    """Distinct entries of two list keys; per file the first key's entries go first."""
    flow = F.split(F.regexp_replace("value", r"^\[\s*|\s*\]$", ""), r"\s*,\s*")
    values = (
        F.when(F.col("item"), F.array("value"))
        .when(F.col("sub").isNotNull(), F.array("sub"))
        .when(F.col("value").startswith("["), flow)
        .otherwise(F.array().cast("array<string>"))
    )
    rows = (
        with_order(compose_rows)
        .where(F.col("key").isin(first, second))
        .select(
            *CONTAINER,
            F.col("ord.file_no").alias("file_no"),
            (F.col("key") == second).alias("second"),
            "pos",
            F.posexplode(values).alias("at", name),
        )
        .withColumn(name, F.regexp_replace(name, "^[\"']|[\"']$", ""))
    )
    order = F.struct("file_no", "second", "pos", "at")
    return rows.where(F.col(name) != "").groupBy(*CONTAINER, name).agg(F.min(order).alias("ord"))


def container_ports(compose_rows: DataFrame) -> DataFrame:
    return _listed(compose_rows, "ports", "expose", "port")


def container_links(compose_rows: DataFrame) -> DataFrame:
    """Distinct link targets, numbered from 1 in first-seen order.

    The window runs over the distinct targets of one container.
    """
    links = _listed(compose_rows, "links", "depends_on", "target")
    order = Window.partitionBy(*CONTAINER).orderBy("ord")
    return links.withColumn("dep_order", F.row_number().over(order))


def build_place(build: Column) -> Column:
    """What the directory of the Dockerfile has to contain: the build path without the steps in front of its first name.

    ``./``, ``../`` and stars of a path pattern are such steps, and slashes at the end say nothing. A path of steps alone keeps
    its last character: ``.`` is found in directories with a dot, ``./`` in none.
    """
    named = F.ltrim(build, F.lit("./*"))
    return F.rtrim(F.when(named != "", named).otherwise(F.right(build, F.lit(1))), F.lit("/"))


def dockerfile_overlay(containers: DataFrame, dockerfile_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Containers whose image is the last FROM of their Dockerfile, and the ports it exposes.

    The Dockerfile is the first one whose directory contains the build path without leading dots and
    slashes and without trailing slashes.
    """
    placed = containers.withColumn("place", build_place(F.col("build")))
    places = placed.where(F.col("place") != "").select("app_id", "place").distinct()
    directories = dockerfile_rows.select("app_id", "path", "directory").distinct()
    chosen = (
        join_contains(directories, "directory", places, "place", ["app_id"])
        .groupBy("app_id", "place")
        .agg(F.min("path").alias("dockerfile"))
    )
    images = dockerfile_rows.groupBy("app_id", F.col("path").alias("dockerfile")).agg(
        F.max_by("image", F.when(F.col("image").isNotNull(), F.col("line_no"))).alias("file_image")
    )
    found = placed.join(shuffled(chosen), ["app_id", "place"], "left").join(shuffled(images), ["app_id", "dockerfile"], "left")
    overlaid = found.withColumn("image", F.coalesce("file_image", "image")).drop("place", "file_image", "dockerfile")
    ports = (
        placed.join(shuffled(chosen), ["app_id", "place"])
        .join(
            dockerfile_rows.where(F.col("port").isNotNull()).select(
                "app_id", F.col("path").alias("dockerfile"), "line_no", "port"
            ),
            ["app_id", "dockerfile"],
        )
        .select(*CONTAINER, "line_no", "port")
    )
    return overlaid, ports

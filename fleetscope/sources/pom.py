"""Maven build files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

POM_SCHEMA = (
    "artifactId string, parent struct<artifactId:string>, "
    "dependencies struct<dependency:array<struct<groupId:string,artifactId:string,scope:string>>>"
)


def read_pom(files: DataFrame) -> DataFrame:
    """(app_id, path, artifact_id, parent_artifact_id, dependencies) of every ``pom.xml``."""
    parsed = files.where(F.col("path").endswith("pom.xml")).withColumn("pom", F.from_xml("content", POM_SCHEMA))
    return parsed.select(
        "app_id",
        "path",
        F.trim("pom.artifactId").alias("artifact_id"),
        F.trim("pom.parent.artifactId").alias("parent_artifact_id"),
        F.col("pom.dependencies.dependency").alias("dependencies"),
    )


def pom_dependencies(poms: DataFrame) -> DataFrame:
    """One row per declared dependency: pos, group_name, library_name, scope (upper case, default COMPILE)."""
    rows = poms.select("app_id", "path", F.posexplode("dependencies").alias("pos", "dependency"))
    return rows.select(
        "app_id",
        "path",
        "pos",
        F.trim("dependency.groupId").alias("group_name"),
        F.trim("dependency.artifactId").alias("library_name"),
        F.upper(F.coalesce(F.trim("dependency.scope"), F.lit("COMPILE"))).alias("scope"),
    )

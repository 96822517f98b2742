"""Queries over the sinks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog.derivation import ANNOTATION_COMPONENTS, CONTAINER_COMPONENTS, CONTAINER_ENDPOINTS, INFRA_IMAGE
from catalog.facts import FACT_SQL
from catalog.registry import query
from fleetscope import rules
from fleetscope.operators import components, dependencies, endpoints, services
from fleetscope.functions.runtime import new_folder
from fleetscope.schema import FACT_SCHEMAS, Facts, fact_schema
from fleetscope.sources import export


@query(
    "omit_defaults",
    f"""{ANNOTATION_COMPONENTS}, component AS (
  SELECT app_id, service, kind, nullif(category, '{rules.CATEGORIES[0]}') AS category, technology, environment FROM annotation_c)
SELECT *, count(*) AS hits FROM component GROUP BY ALL""",
    ("java_annotation",),
)
def omit_defaults(f):
    found = components.from_annotations(f.java_annotation)
    shown, _ = export.omit_defaults(found, found.select("app_id", F.lit(False).alias("wrapped")))
    keys = ["app_id", "service", "kind", "category", "technology", "environment"]
    return shown.groupBy(*keys).agg(F.count("*").alias("hits"))


LINES = f"""
{CONTAINER_COMPONENTS}, {CONTAINER_ENDPOINTS},
line AS (
  SELECT app_id, '<architecture ArchitectureName="' || project || '">' AS line FROM f_app_project
  UNION ALL SELECT app_id, '</architecture>' FROM f_app_project
  UNION ALL SELECT app_id, '<microservices' || CASE WHEN {INFRA_IMAGE}
    THEN ' xsi:type="PIM:InfrastructureMicroservice"' ELSE '' END || ' MicroserviceName="' || name || '">' FROM f_container
  UNION ALL SELECT app_id, '</microservices>' FROM f_container
  UNION ALL SELECT app_id, '<container ContainerName="' || name || '">' FROM f_container
  UNION ALL SELECT app_id, '</container>' FROM f_container
  UNION ALL SELECT app_id, '<interface ServerURL="[http|https]://' || name || ':&lt;port-number>">' FROM f_container
  UNION ALL SELECT app_id, '</interface>' FROM f_container
  UNION ALL SELECT app_id, '<components' || CASE kind WHEN 'Server' THEN ' xsi:type="PIM:InfrastructureServerComponent"' ELSE ''
    END || ' Category="' || category || '" Technology="' || technology || '">' FROM container_c
  UNION ALL SELECT app_id, '</components>' FROM container_c
  UNION ALL SELECT app_id, '<destinations xsi:type="PIM:Endpoint" RequestURI="' || uri || '">' FROM container_e
  UNION ALL SELECT app_id, '</destinations>' FROM container_e
  UNION ALL SELECT app_id, '<dependencies ProviderName="' || target || '">' FROM f_container_link
  UNION ALL SELECT app_id, '</dependencies>' FROM f_container_link)
SELECT app_id, line, count(*) AS hits FROM line GROUP BY ALL"""


@query("architecture_lines", LINES, ("application", "app_project", "container", "container_link"))
def architecture_lines(f):
    """The document lines of everything that comes from compose files."""
    spark = f._spark
    no_modules = spark.createDataFrame([], fact_schema("module", "bigint"))
    rows = services.merge_services(f.container, no_modules).rows
    lines = export.architecture_lines(
        {
            "architecture": services.architecture(f.application, f.app_project).rows,
            "microservice": rows,
            "pim_container": services.pim_containers(rows),
            "service_interface": services.service_interfaces(rows),
            "component": components.merge_components(components.from_containers(f.container)).rows,
            "endpoint": endpoints.merge_endpoints(endpoints.from_containers(f.container)).rows,
            "queue_listener": spark.createDataFrame(
                [], "app_id bigint, service string, queue string, operation_name string, environment string"
            ),
            "dependency": dependencies.merge_dependencies(
                dependencies.from_links(f.container_link, f.container)
            ).rows,
        }
    )
    return lines.groupBy("app_id", "line").agg(F.count("*").alias("hits"))


# Every table as (app_id, fact, row): the columns in the order of the schema, a mark for what is missing.
_COLUMNS = {name: ["app_id", *[column.split()[0] for column in FACT_SCHEMAS[name].split(", ")]] for name in FACT_SQL}
_FACT_ROWS = " UNION ALL ".join(
    f"SELECT app_id, '{name}' AS fact, concat_ws('|', {', '.join(f"coalesce(CAST({column} AS VARCHAR), '-')" for column in columns)}) AS row FROM f_{name}"
    for name, columns in _COLUMNS.items()
)


@query("write_facts", _FACT_ROWS, tuple(FACT_SQL))
def write_facts(f):
    """All fact tables written in buckets of applications and read again."""
    f.share_lines()
    spark = f._spark
    folder = new_folder(spark, "facts")
    export.write_facts(Facts.of(spark, {name: getattr(f, name) for name in FACT_SQL}, "bigint"), folder)
    stored = export.read_facts(spark, folder, "bigint").tables()
    parts = [
        stored[name].select(
            "app_id", F.lit(name).alias("fact"),
            F.concat_ws("|", *[F.coalesce(F.col(column).cast("string"), F.lit("-")) for column in columns]).alias("row"),
        )
        for name, columns in _COLUMNS.items()
    ]
    return reduce(DataFrame.unionByName, parts)

"""Sinks: fact and result tables as Parquet, and the architecture as XML text.

An architecture is written as sorted lines, not as nested values: every element gives an opening and
a closing line whose ``place`` sorts it below its owner. So an application with very many services
is spread over tasks and files, and the files read in order are the document.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetscope import rules
from fleetscope.schema import FACT_SCHEMAS, Facts, fact_schema

APP_FILES = "app_id"
BUCKET = "bucket"
# Sorts behind every other place below the same owner.
_LAST = "~"


def write_tables(
    tables: dict[str, DataFrame], folder: str, by_app: bool = False, buckets: int = 64, mode: str = "overwrite"
) -> None:
    """One Parquet folder per table, with a partition per bucket of applications.

    Buckets keep the number of folders fixed however many applications there are; ``by_app`` gives a
    folder per application instead, for few big ones.
    """
    for name, df in tables.items():
        if by_app:
            df.write.mode(mode).partitionBy(APP_FILES).parquet(f"{folder}/{name}")
        else:
            bucket = F.pmod(F.xxhash64(APP_FILES), F.lit(buckets)).cast("int")
            df.withColumn(BUCKET, bucket).write.mode(mode).partitionBy(BUCKET).parquet(f"{folder}/{name}")


def write_facts(facts: Facts, folder: str, by_app: bool = False, buckets: int = 64) -> None:
    """Every fact table, with the columns and types of its schema whatever expressions it came from."""
    tables = facts.tables()
    for name, df in tables.items():
        columns = fact_schema(name, df.schema["app_id"].dataType.simpleString()).fields
        tables[name] = df.select(*[F.col(column.name).cast(column.dataType) for column in columns])
    write_tables(tables, folder, by_app, buckets)


def read_facts(spark: SparkSession, folder: str, app_type: str = "string") -> Facts:
    tables = {}
    for name, columns in FACT_SCHEMAS.items():
        rows = spark.read.schema(f"{columns}, app_id {app_type}").parquet(f"{folder}/{name}")
        tables[name] = rows.drop(BUCKET)
    return Facts.of(spark, tables, app_type)


def omit_defaults(components: DataFrame, dependencies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What the serialiser leaves out: the first category, and a false circuit breaker mark."""
    return (
        components.withColumn("category", F.nullif("category", F.lit(rules.CATEGORIES[0]))),
        dependencies.withColumn("wrapped", F.when(F.col("wrapped"), True)),
    )


def _escaped(text: Column) -> Column:
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(mark), F.lit(name))
    return text


def _tag(name: str, attributes: dict[str, Column]) -> Column:
    shown = [
        F.when(value.isNotNull(), F.concat(F.lit(f' {key}="'), _escaped(value.cast("string")), F.lit('"')))
        for key, value in attributes.items()
    ]
    return F.concat(F.lit(f"<{name}"), *[F.coalesce(text, F.lit("")) for text in shown], F.lit(">"))


def _element(df: DataFrame, place: Column, name: str, attributes: dict[str, Column]) -> DataFrame:
    """Opening and closing line of every row."""
    lines = F.array(
        F.struct(place.alias("place"), _tag(name, attributes).alias("line")),
        F.struct(F.concat(place, F.lit(_LAST)).alias("place"), F.lit(f"</{name}>").alias("line")),
    )
    return df.select("app_id", F.inline(lines))


def _step(*parts: Column | str) -> Column:
    """One level of a place. A control character below every printable one separates levels."""
    return F.concat(F.lit("\u0001"), F.concat_ws("\u0002", *[F.coalesce(p if isinstance(p, Column) else F.col(p), F.lit("")) for p in parts]))


def _ord(column: str = "ord") -> Column:
    return F.lpad(F.col(column).cast("string"), 19, "0")


def _evidence_lines(rows: DataFrame, place: Column) -> DataFrame:
    """A line per fact behind the element at ``place``, after everything else inside it."""
    line = F.concat(F.lit("<GeneratingPSM>"), _escaped(F.col("evidence")), F.lit("</GeneratingPSM>"))
    return rows.select("app_id", F.concat(place, _step(F.lit("z"), _ord(), "evidence")).alias("place"), line.alias("line"))


def _placed_evidence(links: DataFrame, places: DataFrame, keys: list[str]) -> DataFrame:
    """Evidence lines of elements whose place is looked up by ``keys``; a missing key equals an empty one."""
    left = links.select("app_id", *[F.coalesce(key, F.lit("")).alias(key) for key in keys], "evidence", "ord")
    right = places.select("app_id", *[F.coalesce(key, F.lit("")).alias(key) for key in keys], "owner")
    return _evidence_lines(left.join(right, ["app_id", *keys]), F.col("owner"))


def architecture_lines(derived: dict[str, DataFrame]) -> DataFrame:
    """(app_id, place, line): sorted by place, the lines of one application form its document.

    ``derived`` has the tables of ``plans.derive``; messages, operations and evidence tables may be left out.
    """
    service = _step("service")
    interface = F.concat(service, _step(F.lit("3")))
    kinds = {"Microservice": None, "Functional": "PIM:FunctionalMicroservice", "Infrastructure": "PIM:InfrastructureMicroservice"}
    component_kinds = {rules.PATTERN: None, rules.SERVER: "PIM:InfrastructureServerComponent", rules.CLIENT: "PIM:InfrastructureClientComponent"}

    def typed(names: dict[str, str | None]) -> Column:
        return F.coalesce(*[F.when(F.col("kind") == kind, F.lit(text)) for kind, text in names.items() if text])

    component_place = F.concat(service, _step(F.lit("2"), _ord(), "kind", F.coalesce("category", F.lit("")), "technology"))
    components, dependencies = omit_defaults(derived["component"].withColumn("owner", component_place), derived["dependency"])
    endpoints = derived["endpoint"]
    if "forwarded" not in endpoints.columns:
        endpoints = endpoints.withColumn("forwarded", F.lit(False))
    endpoint_place = F.concat(interface, _step(F.lit("e"), "uri", F.col("forwarded").cast("string"), "environment"))
    listener_place = F.concat(interface, _step(F.lit("q"), "queue", "operation_name"))
    dependency_place = F.concat(service, _step(F.lit("4"), "provider", "destination", F.col("wrapped").cast("string")))
    endpoints = endpoints.withColumn("owner", endpoint_place)
    listeners = derived["queue_listener"].withColumn("owner", listener_place)
    placed = dependencies.withColumn("owner", dependency_place)
    parts = [
        _element(derived["architecture"], F.lit(""), "architecture", {"ArchitectureName": F.col("name")}),
        _element(
            derived["microservice"], service, "microservices",
            {"xsi:type": typed(kinds), "MicroserviceName": F.col("service")},
        ),
        _element(
            derived["pim_container"], F.concat(service, _step(F.lit("1"))), "container",
            {"ContainerName": F.col("container_name")},
        ),
        _element(
            components, F.col("owner"), "components",
            {"xsi:type": typed(component_kinds), "Category": F.col("category"), "Technology": F.col("technology"),
             "Environment": F.col("environment")},
        ),
        _element(derived["service_interface"], interface, "interface", {"ServerURL": F.col("server_url")}),
        _element(
            endpoints, F.col("owner"), "destinations",
            {"xsi:type": F.lit("PIM:Endpoint"), "Environment": F.col("environment"), "RequestURI": F.col("uri")},
        ),
        _element(
            listeners, F.col("owner"), "destinations",
            {"xsi:type": F.lit("PIM:QueueListener"), "Environment": F.col("environment"), "QueueName": F.col("queue")},
        ),
        _element(
            placed, F.col("owner"), "dependencies",
            {"ConsumerOperation": F.col("operation"), "ProviderName": F.col("provider"),
             "ProviderDestination": F.col("destination"), "isWrappedByCircuitBreaker": F.col("wrapped"),
             "Environment": F.col("environment")},
        ),
    ]
    # What belongs to a destination stands in the one of that name that the service declares itself.
    own = endpoints.where(~F.col("forwarded")).select("app_id", "service", F.col("uri").alias("destination"), "owner")
    queues = listeners.select("app_id", "service", F.col("queue").alias("destination"), "owner")
    held = own.unionByName(queues).groupBy("app_id", "service", "destination").agg(F.min("owner").alias("holder"))
    at_destination = ["app_id", "service", "destination"]
    if "message" in derived:
        message_place = F.concat("holder", _step(F.lit("m"), _ord(), "message_type", "body_schema", "schema_format"))
        messages = derived["message"].join(held, at_destination).withColumn("owner", message_place)
        shown = {"MessageType": F.col("message_type"), "BodySchema": F.col("body_schema"), "SchemaFormat": F.col("schema_format")}
        parts.append(_element(messages, F.col("owner"), "messages", shown))
        parts += _listed(derived, "message_evidence", messages, ["service", "destination", "message_type", "body_schema", "schema_format"])
    if "operation" in derived:
        operation_place = F.concat("holder", _step(F.lit("o"), _ord(), "name", "description"))
        operations = derived["operation"].join(held, at_destination).withColumn("owner", operation_place)
        shown = {"OperationName": F.col("name"), "OperationDescription": F.col("description")}
        parts.append(_element(operations, F.col("owner"), "operation", shown))
        parts += _listed(derived, "operation_evidence", operations, ["service", "name", "description"])
    if "architecture_evidence" in derived:
        parts.append(_evidence_lines(derived["architecture_evidence"], F.lit("")))
    if "microservice_evidence" in derived:
        ordered = derived["microservice_evidence"].withColumn("ord", F.col("phase") * F.lit(1 << 54) + F.col("seq"))
        # Service, container and interface have the same facts behind them.
        parts += [_evidence_lines(ordered, place) for place in (service, F.concat(service, _step(F.lit("1"))), interface)]
    parts += _listed(derived, "component_evidence", derived["component"].withColumn("owner", component_place), ["service", "kind", "category", "technology"])
    parts += _listed(derived, "endpoint_evidence", endpoints, ["service", "uri"])
    parts += _listed(derived, "queue_listener_evidence", listeners, ["service", "queue", "operation_name"])
    parts += _listed(derived, "dependency_evidence", placed, ["service", "provider", "destination"])
    return reduce(DataFrame.unionByName, parts)


def _listed(derived: dict[str, DataFrame], name: str, places: DataFrame, keys: list[str]) -> list[DataFrame]:
    return [_placed_evidence(derived[name], places, keys)] if name in derived else []


def write_architecture(lines: DataFrame, folder: str, mode: str = "overwrite") -> None:
    """Text files per application; their lines in file order are the document."""
    ordered = lines.repartitionByRange("app_id", "place").sortWithinPartitions("app_id", "place")
    ordered.select("app_id", "line").write.mode(mode).partitionBy(APP_FILES).text(folder)

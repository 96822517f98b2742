"""Endpoints, their messages and operations, and the keyed merges of destinations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetscope import rules
from fleetscope.functions import order_key
from fleetscope.functions.ordering import ANNOTATION, CONTAINER, LIBRARY, PROPERTY, REGISTRY_PAIR, TYPE
from fleetscope.operators import evidence
from fleetscope.operators import java_endpoints as java
from fleetscope.operators.components import Merged
from fleetscope.operators.flags import gate, matched_test, registry_pair, value_passes

COLUMNS = ["app_id", "service", "uri", "environment", "overwrites", "evidence", "ord"]
_RAW = ["app_id", "project", "verb", "path", "environment", "overwrites", "evidence", "ord"]
ENDPOINT = ["app_id", "service", "uri"]
MESSAGE = ["app_id", "service", "destination", "message_type", "body_schema", "schema_format"]


def endpoint_prefixes(properties: DataFrame) -> DataFrame:
    """The first context path property of every module."""
    return (
        properties.where(F.col("name").isin(*rules.CONTEXT_PATH_PROPERTIES))
        .groupBy("app_id", "project")
        .agg(F.min_by("value", "seq").alias("prefix"))
    )


def from_containers(containers: DataFrame) -> DataFrame:
    image_rules = rules.table(
        containers.sparkSession, rules.IMAGE_ENDPOINTS, "rule int, image_part string, verb string, path string"
    )
    return containers.join(image_rules, F.instr(F.col("image"), F.col("image_part")) > 0).select(
        "app_id",
        F.col("name").alias("service"),
        F.concat("verb", F.lit(" "), "path").alias("uri"),
        F.lit(None).cast("string").alias("environment"),
        F.lit(False).alias("overwrites"),
        evidence.container_evidence(F.col("name"), F.col("image"), F.col("generates_logs")).alias("evidence"),
        order_key(CONTAINER, F.col("seq"), F.col("rule")).alias("ord"),
    )


def with_prefix(raw: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Put the module's context path in front; equal hits of a module are folded before the join."""
    keys = [column for column in _RAW if column != "ord"]
    folded = raw.groupBy(*keys).agg(F.min("ord").alias("ord"), F.max("ord").alias("last_ord"))
    return folded.join(prefixes, ["app_id", "project"], "left").select(
        "app_id",
        F.col("project").alias("service"),
        F.concat("verb", F.lit(" "), F.coalesce("prefix", F.lit("")), "path").alias("uri"),
        "environment",
        "overwrites",
        "evidence",
        "ord",
        "last_ord",
    )


def from_libraries(libraries: DataFrame, flags: DataFrame) -> DataFrame:
    library_rules = rules.table(
        libraries.sparkSession,
        rules.library_endpoint_rows(),
        "rule int, library_name string, needs string, verb string, path string",
    )
    hits = libraries.join(library_rules, "library_name").select(
        "app_id", "project", "verb", "path",
        F.col("scope").alias("environment"),
        F.lit(True).alias("overwrites"),
        evidence.library_evidence(F.col("library_name")).alias("evidence"),
        order_key(LIBRARY, F.col("seq"), F.col("rule")).alias("ord"),
        "needs",
        F.lit(None).cast("string").alias("unless"),
    )
    return gate(hits, flags)


def from_properties(properties: DataFrame, flags: DataFrame) -> DataFrame:
    property_rules = rules.table(
        properties.sparkSession,
        rules.property_endpoint_rows(),
        "rule int, match string, test string, value_test string, needs string, verb string, path string",
    )
    hits = (
        properties.withColumn(
            "test", matched_test("name", [(row[0], row[1]) for row in rules.PROPERTY_ENDPOINTS])
        )
        .where(F.col("test").isNotNull())
        .join(property_rules, "test")
        .where(value_passes(F.col("value_test"), F.col("value")))
        .select(
            "app_id", "project", "verb", "path",
            F.col("profile").alias("environment"),
            F.lit(True).alias("overwrites"),
            evidence.property_evidence(F.col("name")).alias("evidence"),
            order_key(PROPERTY, F.col("seq"), F.col("rule")).alias("ord"),
            "needs",
            F.lit(None).cast("string").alias("unless"),
        )
    )
    return gate(hits, flags).unionByName(from_registry_pair(properties))


def from_registry_pair(properties: DataFrame) -> DataFrame:
    three = F.array(
        *[
            F.struct(F.lit(number).alias("rule"), F.lit(verb).alias("verb"), F.lit(path).alias("path"))
            for number, (verb, path) in enumerate(rules.EUREKA_ENDPOINTS)
        ]
    )
    return registry_pair(properties).select("*", F.inline(three)).select(
        "app_id", "project", "verb", "path",
        F.col("profile").alias("environment"),
        F.lit(True).alias("overwrites"),
        evidence.property_evidence(F.col("name")).alias("evidence"),
        order_key(REGISTRY_PAIR, F.col("seq"), F.col("rule")).alias("ord"),
    )


def from_imports(supertypes: DataFrame) -> DataFrame:
    import_rules = rules.table(
        supertypes.sparkSession,
        [
            (number, name, rules.OAUTH_PACKAGE, verb, path)
            for name in rules.OAUTH_TYPES
            for number, (verb, path) in enumerate(rules.OAUTH_ENDPOINTS)
        ],
        "rule int, target_id string, target_package string, verb string, path string",
    )
    return (
        supertypes.where(F.col("relation") == "imports")
        .join(import_rules, ["target_id", "target_package"])
        .select(
            "app_id", "project", "verb", "path",
            F.col("profile").alias("environment"),
            F.lit(False).alias("overwrites"),
            evidence.type_evidence(F.col("target_id")).alias("evidence"),
            order_key(TYPE, F.col("seq"), F.col("rule")).alias("ord"),
        )
    )


def from_annotations(annotations: DataFrame, flags: DataFrame) -> DataFrame:
    annotation_rules = rules.table(
        annotations.sparkSession,
        rules.annotation_endpoint_rows(),
        "rule int, annotation_name string, needs string, verb string, path string",
    )
    hits = (
        annotations.where(F.col("owner_kind") == "type")
        .join(annotation_rules, "annotation_name")
        .select(
            "app_id", "project", "verb", "path",
            F.col("profile").alias("environment"),
            F.lit(False).alias("overwrites"),
            evidence.annotation_evidence(F.col("annotation_name")).alias("evidence"),
            order_key(ANNOTATION, F.col("seq"), F.col("rule")).alias("ord"),
            "needs",
            F.lit(None).cast("string").alias("unless"),
        )
    )
    return gate(hits, flags)


def of_methods(endpoint_methods: DataFrame) -> DataFrame:
    """Endpoint contributions of methods that already carry their ``uri``."""
    return endpoint_methods.select(
        "app_id",
        F.col("project").alias("service"),
        "uri",
        F.col("profile").alias("environment"),
        F.lit(False).alias("overwrites"),
        evidence.method_evidence(F.col("method_name")).alias("evidence"),
        "ord",
    )


def merge_endpoints(contributed: DataFrame) -> Merged:
    """One endpoint per (service, uri); library and property hits overwrite the environment."""
    if "last_ord" not in contributed.columns:
        contributed = contributed.withColumn("last_ord", F.col("ord"))
    folded = contributed.groupBy(*ENDPOINT, "environment", "overwrites", "evidence").agg(
        F.min("ord").alias("ord"), F.max("last_ord").alias("last_ord")
    )
    rows = folded.groupBy(*ENDPOINT).agg(
        F.max("overwrites").alias("overwritten"),
        F.max_by("environment", F.when(F.col("overwrites"), F.col("last_ord"))).alias("last_environment"),
        F.min_by("environment", "ord").alias("first_environment"),
        F.min("ord").alias("ord"),
    )
    rows = rows.select(
        *ENDPOINT,
        F.when(F.col("overwritten"), F.col("last_environment"))
        .otherwise(F.col("first_environment"))
        .alias("environment"),
        "ord",
    )
    return Merged(rows, folded.groupBy(*ENDPOINT, "evidence").agg(F.min("ord").alias("ord")))


def merge_listeners(listeners: DataFrame) -> Merged:
    """One listener per (service, queue, operation name)."""
    key = ["app_id", "service", "queue", "operation_name"]
    folded = listeners.select(
        "app_id",
        F.col("project").alias("service"),
        "queue",
        "operation_name",
        F.col("profile").alias("environment"),
        evidence.method_evidence(F.col("method_name")).alias("evidence"),
        "ord",
    )
    rows = folded.groupBy(*key).agg(
        F.min_by("environment", "ord").alias("environment"), F.min("ord").alias("ord")
    )
    return Merged(rows, folded.groupBy(*key, "evidence").agg(F.min("ord").alias("ord")))


def container_messages(container_endpoints: DataFrame) -> DataFrame:
    message_rules = rules.table(
        container_endpoints.sparkSession,
        [(number, *row) for number, row in enumerate(rules.CONTAINER_MESSAGES)],
        "rule int, uri string, message_type string, body_schema string",
    )
    return _as_messages(container_endpoints.join(message_rules, "uri"))


def module_messages(module_endpoints: DataFrame) -> DataFrame:
    """Messages of endpoints born from libraries and properties, by what the URI contains."""
    message_rules = rules.table(
        module_endpoints.sparkSession,
        [(number, *row) for number, row in enumerate(rules.MODULE_MESSAGES)],
        "rule int, verb_part string, path_part string, message_type string, body_schema string",
    )
    # A position test with an empty text is true, like a rule without verb.
    fits = (F.instr(F.col("uri"), F.col("path_part")) > 0) & (
        (F.col("verb_part") == "") | (F.instr(F.col("uri"), F.col("verb_part")) > 0)
    )
    return _as_messages(module_endpoints.join(message_rules, fits))


def _as_messages(joined: DataFrame) -> DataFrame:
    return joined.select(
        "app_id",
        "service",
        F.col("uri").alias("destination"),
        "message_type",
        "body_schema",
        F.lit("JSON").alias("schema_format"),
        "evidence",
        "ord",
    )


def merge_messages(contributed: DataFrame) -> Merged:
    links = contributed.groupBy(*MESSAGE, "evidence").agg(F.min("ord").alias("ord"))
    return Merged(links.groupBy(*MESSAGE).agg(F.min("ord").alias("ord")), links)


def merge_operations(contributed: DataFrame) -> Merged:
    """One operation per (service, name, description), held by the last destination that asked for it."""
    key = ["app_id", "service", "name", "description"]
    folded = contributed.groupBy(*key, "destination", "evidence").agg(
        F.min("ord").alias("ord"), F.max("ord").alias("last_ord")
    )
    rows = folded.groupBy(*key).agg(
        F.max_by("destination", "last_ord").alias("destination"), F.min("ord").alias("ord")
    )
    return Merged(rows, folded.groupBy(*key, "evidence").agg(F.min("ord").alias("ord")))


def module_born(facts, flags: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Library- and property-born endpoint contributions (the ones that carry messages)."""
    raw = from_libraries(facts.library, flags).unionByName(from_properties(facts.property, flags))
    return with_prefix(raw, prefixes)


def type_born(facts, flags: DataFrame, prefixes: DataFrame) -> DataFrame:
    raw = from_imports(facts.java_supertype).unionByName(from_annotations(facts.java_annotation, flags))
    return with_prefix(raw, prefixes)


def method_born(facts, prefixes: DataFrame, repositories: DataFrame) -> DataFrame:
    """Methods that are endpoints: controller methods and repository searches, with their ``uri``."""
    searches = java.repository_searches(
        repositories, facts.java_method, facts.method_param, facts.java_annotation
    )
    controllers = java.controller_endpoints(
        facts.java_method, facts.java_annotation, facts.annotation_param, prefixes
    )
    return searches.select(*controllers.columns).unionByName(controllers)


def all_contributions(
    of_containers: DataFrame,
    of_modules: DataFrame,
    of_types: DataFrame,
    repositories: DataFrame,
    endpoint_methods: DataFrame,
) -> DataFrame:
    parts = (of_containers, java.repository_collections(repositories), of_methods(endpoint_methods))
    single = [part.withColumn("last_ord", F.col("ord")) for part in parts]
    return reduce(DataFrame.unionByName, [of_modules, of_types, *single])

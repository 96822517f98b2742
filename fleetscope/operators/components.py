"""Which infrastructure patterns the facts of a service point to, and their keyed merge."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetscope import rules
from fleetscope.functions import order_key
from fleetscope.functions.ordering import ANNOTATION, CONTAINER, LIBRARY, METHOD, PROPERTY, REGISTRY_PAIR, TYPE
from fleetscope.operators import evidence
from fleetscope.operators.flags import gate, matched_test, registry_pair, value_passes

COLUMNS = ["app_id", "service", "kind", "category", "technology", "environment", "evidence", "ord"]
ELEMENT = ["app_id", "service", "kind", "category"]


class Merged(NamedTuple):
    """Merged rows, and one row per (merged row, fact it comes from) with the fact's first position.

    Evidence stays a long table: it grows with the facts of a service, so it is never one array.
    """

    rows: DataFrame
    evidence: DataFrame


def from_containers(containers: DataFrame) -> DataFrame:
    spark = containers.sparkSession
    image_rules = rules.table(
        spark, rules.IMAGE_COMPONENTS, "rule int, image_part string, category string, technology string"
    )
    source = containers.select(
        "app_id",
        F.col("name").alias("service"),
        "image",
        "generates_logs",
        "seq",
        evidence.container_evidence(F.col("name"), F.col("image"), F.col("generates_logs")).alias("evidence"),
    )
    servers = source.join(image_rules, F.instr(F.col("image"), F.col("image_part")) > 0).withColumn(
        "kind", F.lit(rules.SERVER)
    )
    loggers = source.where("generates_logs").select(
        "*",
        F.lit(1).alias("rule"),
        F.lit(rules.METRICS_GENERATION).alias("category"),
        F.lit("Logging").alias("technology"),
        F.lit(rules.PATTERN).alias("kind"),
    )
    return (
        servers.drop("image_part")
        .unionByName(loggers)
        .withColumn("environment", F.lit(None).cast("string"))
        .withColumn("ord", order_key(CONTAINER, F.col("seq"), F.col("rule")))
        .select(*COLUMNS)
    )


def from_libraries(libraries: DataFrame, flags: DataFrame) -> DataFrame:
    library_rules = rules.table(
        libraries.sparkSession,
        rules.library_component_rows(),
        "rule int, library_name string, scope_test string, kind string, category string, technology string, "
        "needs string",
    )
    hits = (
        libraries.join(library_rules, "library_name")
        .where(
            (F.col("scope_test") == rules.ANY_SCOPE)
            | ((F.col("scope_test") == rules.ONLY_RUNTIME) & (F.col("scope") == "RUNTIME"))
            | ((F.col("scope_test") == rules.NOT_RUNTIME) & (F.col("scope") != "RUNTIME"))
        )
        .select(
            "app_id", "project", "kind", "category", "technology",
            F.col("scope").alias("environment"),
            evidence.library_evidence(F.col("library_name")).alias("evidence"),
            order_key(LIBRARY, F.col("seq"), F.col("rule")).alias("ord"),
            "needs",
            F.lit(None).cast("string").alias("unless"),
        )
    )
    return gate(hits, flags).withColumnRenamed("project", "service").select(*COLUMNS)


def from_properties(properties: DataFrame, flags: DataFrame) -> DataFrame:
    property_rules = rules.table(
        properties.sparkSession,
        rules.property_component_rows(),
        "rule int, match string, test string, value_test string, kind string, category string, technology string, "
        "needs string, unless string",
    )
    hits = (
        properties.withColumn(
            "test", matched_test("name", [(row[0], row[1]) for row in rules.PROPERTY_COMPONENTS])
        )
        .where(F.col("test").isNotNull())
        .join(property_rules, "test")
        .where(value_passes(F.col("value_test"), F.col("value")))
        .select(
            "app_id", "project", "kind", "category", "technology",
            F.col("profile").alias("environment"),
            evidence.property_evidence(F.col("name")).alias("evidence"),
            order_key(PROPERTY, F.col("seq"), F.col("rule")).alias("ord"),
            "needs",
            "unless",
        )
    )
    return (
        gate(hits, flags)
        .withColumnRenamed("project", "service")
        .select(*COLUMNS)
        .unionByName(from_registry_pair(properties))
    )


def from_registry_pair(properties: DataFrame) -> DataFrame:
    return registry_pair(properties).select(
        "app_id",
        F.col("project").alias("service"),
        F.lit(rules.SERVER).alias("kind"),
        F.lit(rules.REGISTRY).alias("category"),
        F.lit("Eureka").alias("technology"),
        F.col("profile").alias("environment"),
        evidence.property_evidence(F.col("name")).alias("evidence"),
        order_key(REGISTRY_PAIR, F.col("seq")).alias("ord"),
    )


def from_imports(supertypes: DataFrame) -> DataFrame:
    import_rules = rules.table(
        supertypes.sparkSession,
        rules.IMPORT_COMPONENTS,
        "target_id string, target_package string, kind string, category string, technology string",
    )
    return (
        supertypes.where(F.col("relation") == "imports")
        .join(import_rules, ["target_id", "target_package"])
        .select(
            "app_id", F.col("project").alias("service"), "kind", "category", "technology",
            F.col("profile").alias("environment"),
            evidence.type_evidence(F.col("target_id")).alias("evidence"),
            order_key(TYPE, F.col("seq")).alias("ord"),
        )
    )


def from_annotations(annotations: DataFrame) -> DataFrame:
    annotation_rules = rules.table(
        annotations.sparkSession,
        [(number, *row) for number, row in enumerate(rules.ANNOTATION_COMPONENTS)],
        "rule int, annotation_name string, kind string, category string, technology string",
    )
    return (
        annotations.where(F.col("owner_kind") == "type")
        .join(annotation_rules, "annotation_name")
        .select(
            "app_id", F.col("project").alias("service"), "kind", "category", "technology",
            F.col("profile").alias("environment"),
            evidence.annotation_evidence(F.col("annotation_name")).alias("evidence"),
            order_key(ANNOTATION, F.col("seq"), F.col("rule")).alias("ord"),
        )
    )


def from_invocations(invocations: DataFrame) -> DataFrame:
    invocation_rules = rules.table(
        invocations.sparkSession,
        rules.INVOCATION_COMPONENTS,
        "callee string, receiver_type string, receiver_package string, kind string, category string, "
        "technology string",
    )
    return invocations.join(invocation_rules, ["callee", "receiver_type", "receiver_package"]).select(
        "app_id", F.col("project").alias("service"), "kind", "category", "technology",
        F.col("profile").alias("environment"),
        evidence.method_evidence(F.col("callee")).alias("evidence"),
        order_key(METHOD, F.col("seq")).alias("ord"),
    )


def contributions(facts, flags: DataFrame) -> DataFrame:
    return reduce(
        DataFrame.unionByName,
        (
            from_containers(facts.container),
            from_libraries(facts.library, flags),
            from_properties(facts.property, flags),
            from_imports(facts.java_supertype),
            from_annotations(facts.java_annotation),
            from_invocations(facts.java_invocation),
        ),
    )


def merge_components(contributed: DataFrame) -> Merged:
    """One component per (service, kind, category, technology).

    A contribution without technology joins the first component of its group and is upgraded by the
    first technology that arrives; so it belongs to the first technology of the group, wherever that
    comes. A component keeps the environment of its first contribution.
    """
    distinct = contributed.groupBy(*ELEMENT, "technology", "environment", "evidence").agg(F.min("ord").alias("ord"))
    by_technology = distinct.groupBy(*ELEMENT, "technology").agg(
        F.min("ord").alias("ord"), F.min_by("environment", "ord").alias("environment")
    )
    # At most one row per technology of a rule table: a window over a handful of rows.
    group = Window.partitionBy(*ELEMENT)
    first_technology = F.min_by("technology", F.when(F.col("technology") != "", F.col("ord"))).over(group)
    resolved = by_technology.withColumn(
        "resolved", F.when(F.col("technology") == "", first_technology).otherwise(F.col("technology"))
    )
    merged = resolved.groupBy(*ELEMENT, "resolved").agg(
        F.min_by("environment", "ord").alias("environment"), F.min("ord").alias("ord")
    )
    links = (
        distinct.groupBy(*ELEMENT, "technology", "evidence")
        .agg(F.min("ord").alias("ord"))
        .join(resolved.select(*ELEMENT, "technology", "resolved"), [*ELEMENT, "technology"])
        .groupBy(*ELEMENT, "resolved", "evidence")
        .agg(F.min("ord").alias("ord"))
    )
    columns = [*ELEMENT, F.col("resolved").alias("technology")]
    return Merged(merged.select(*columns, "environment", "ord"), links.select(*columns, "evidence", "ord"))

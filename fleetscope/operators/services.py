"""Architectures, services, containers and service interfaces."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetscope import rules
from fleetscope.functions import contains_lit
from fleetscope.operators import evidence
from fleetscope.operators.components import Merged

UNTYPED, FUNCTIONAL, INFRASTRUCTURE = "Microservice", "Functional", "Infrastructure"
SPRING_KINDS = ("SpringMVC", "SpringWebFlux")


def architecture(applications: DataFrame, app_projects: DataFrame) -> Merged:
    """One architecture per application; the project's parent name wins over the application's name."""
    named = applications.select(
        "app_id", F.lit(0).alias("ord"), F.col("app_name").alias("name"),
        F.concat(F.lit("DistributedApplicationProject[ApplicationName:"), "app_name", F.lit("]")).alias("evidence"),
    ).unionByName(
        app_projects.select(
            "app_id", F.lit(1).alias("ord"), F.col("project").alias("name"),
            F.concat(F.lit("ApplicationProject[ProjectArtifactId:"), "artifact_id", F.lit("]")).alias("evidence"),
        )
    )
    rows = named.groupBy("app_id").agg(F.max_by("name", "ord").alias("name"))
    return Merged(rows, named.select("app_id", "evidence", "ord"))


def is_infrastructure_image(image: str = "image"):
    marks = [contains_lit(F.col(image), part) for part in rules.INFRASTRUCTURE_IMAGES]
    return reduce(lambda one, other: one | other, marks)


def services_from_containers(containers: DataFrame) -> DataFrame:
    return containers.select(
        "app_id",
        F.col("name").alias("service"),
        F.when(is_infrastructure_image(), INFRASTRUCTURE).otherwise(UNTYPED).alias("kind"),
        F.lit(False).alias("spring"),
        evidence.container_evidence(F.col("name"), F.col("image"), F.col("generates_logs")).alias("evidence"),
        F.lit(0).alias("phase"),
        "seq",
    )


def services_from_modules(modules: DataFrame) -> DataFrame:
    return modules.select(
        "app_id",
        F.col("artifact_id").alias("service"),
        F.lit(UNTYPED).alias("kind"),
        F.col("kind").isin(*SPRING_KINDS).alias("spring"),
        evidence.module_evidence(F.col("artifact_id")).alias("evidence"),
        F.lit(1).alias("phase"),
        "seq",
    )


def merge_services(containers: DataFrame, modules: DataFrame) -> Merged:
    """Service, its container and its interface share one key and one list of evidence."""
    both = services_from_containers(containers).unionByName(services_from_modules(modules))
    rows = both.groupBy("app_id", "service").agg(
        F.when(F.max(F.col("kind") == INFRASTRUCTURE), INFRASTRUCTURE).otherwise(UNTYPED).alias("kind"),
        F.max("spring").alias("spring"),
        F.min(F.col("phase")).alias("phase"),
        F.min("seq").alias("seq"),
    )
    links = both.groupBy("app_id", "service", "evidence").agg(F.min("phase").alias("phase"), F.min("seq").alias("seq"))
    return Merged(rows, links)


def pim_containers(services: DataFrame) -> DataFrame:
    return services.select("app_id", "service", F.col("service").alias("container_name"))


def service_interfaces(services: DataFrame) -> DataFrame:
    return services.select(
        "app_id",
        "service",
        F.concat(F.lit("[http|https]://"), "service", F.lit(":<port-number>")).alias("server_url"),
    )


def classify_services(services: DataFrame, components: DataFrame) -> DataFrame:
    """An untyped service of a Spring module is infrastructure if it holds a server component, else functional."""
    servers = (
        components.where(F.col("kind") == rules.SERVER)
        .groupBy("app_id", "service")
        .agg(F.lit(True).alias("has_server"))
    )
    derived = F.when(F.col("has_server"), INFRASTRUCTURE).otherwise(FUNCTIONAL)
    return services.join(servers, ["app_id", "service"], "left").select(
        "app_id",
        "service",
        F.when((F.col("kind") == UNTYPED) & F.col("spring"), derived).otherwise(F.col("kind")).alias("kind"),
        "phase",
        "seq",
    )

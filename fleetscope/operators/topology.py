"""Rules over the recovered services of one application: circuit breaker streams and gateway routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetscope import rules
from fleetscope.functions import after, before, between, contains_lit
from fleetscope.functions.matching import join_prefix

ROUTE_PREFIX, PATH_SUFFIX, ID_SUFFIX = "zuul.routes.", ".path", ".serviceId"


def endpoint_destination(uri: Column) -> Column:
    return F.concat(F.lit("Endpoint[RequestURI:"), uri, F.lit("]"))


def breaker_consumers(components: DataFrame) -> DataFrame:
    monitoring = (F.col("kind") == rules.SERVER) & (F.col("category") == rules.BREAKER_MONITORING)
    return (
        components.where(monitoring | (F.col("category") == rules.BREAKER_AGGREGATION))
        .select("app_id", "service")
        .distinct()
    )


def circuit_breaker_dependencies(components: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Every stream consumer depends on every stream of its application, its own included."""
    streams = endpoints.where(F.col("uri").endswith("hystrix.stream")).select(
        "app_id", F.col("service").alias("provider"), "uri", "environment"
    )
    return (
        breaker_consumers(components)
        .join(streams, "app_id")
        .select(
            "app_id",
            "service",
            "provider",
            endpoint_destination(F.col("uri")).alias("destination"),
            F.lit(False).alias("wrapped"),
            "environment",
        )
    )


def gateways(components: DataFrame) -> DataFrame:
    return (
        components.where((F.col("kind") == rules.SERVER) & (F.col("category") == rules.API_GATEWAY))
        .select("app_id", F.col("service").alias("gateway"))
        .distinct()
    )


def route_table(gateway_services: DataFrame, properties: DataFrame) -> DataFrame:
    """Configured routes of every gateway: (app_id, gateway, seq, target, prefix).

    The id in a path property is replaced by the one of the first service-id property that starts with it.
    """
    own = properties.join(
        gateway_services.withColumnRenamed("gateway", "project"), ["app_id", "project"], "left_semi"
    )
    name = F.col("name")
    paths = own.where(name.startswith(ROUTE_PREFIX) & name.endswith(PATH_SUFFIX)).select(
        "app_id",
        "project",
        "seq",
        between(name, ROUTE_PREFIX, PATH_SUFFIX).alias("route_id"),
        before(F.col("value"), "/*").alias("prefix"),
    )
    id_names = own.where(name.startswith(ROUTE_PREFIX) & name.endswith(ID_SUFFIX)).select(
        "app_id", "project", F.col("seq").alias("id_seq"), "name"
    )
    wanted = paths.select("app_id", "project", F.concat(F.lit(ROUTE_PREFIX), "route_id").alias("start")).distinct()
    renamed = (
        join_prefix(id_names, "name", wanted, "start", ["app_id", "project"])
        .groupBy("app_id", "project", "start")
        .agg(F.min_by("name", "id_seq").alias("id_name"))
        .select(
            "app_id",
            "project",
            F.substring("start", F.lit(len(ROUTE_PREFIX) + 1), F.length("start")).alias("route_id"),
            between(F.col("id_name"), ROUTE_PREFIX, ID_SUFFIX).alias("real_id"),
        )
    )
    return paths.join(renamed, ["app_id", "project", "route_id"], "left").select(
        "app_id",
        F.col("project").alias("gateway"),
        "seq",
        F.coalesce("real_id", "route_id").alias("target"),
        "prefix",
    )


def _forwarded(targets: DataFrame, endpoints: DataFrame, default_route: bool) -> DataFrame:
    """Endpoints of the target services, re-published below ``prefix``."""
    published = endpoints.select(
        "app_id", F.col("service").alias("target"), F.col("uri").alias("target_uri"), "environment"
    )
    uri = F.concat(before(F.col("target_uri"), " "), F.lit(" "), "prefix", after(F.col("target_uri"), " "))
    return targets.join(published, ["app_id", "target"]).select(
        "app_id",
        F.col("gateway").alias("service"),
        uri.alias("uri"),
        "environment",
        F.col("target").alias("provider"),
        "target_uri",
        F.lit(default_route).alias("default_route"),
        "seq",
    )


def gateway_routes(routes: DataFrame, endpoints: DataFrame) -> DataFrame:
    return _forwarded(routes, endpoints, default_route=False)


def gateway_default_routes(
    gateway_services: DataFrame,
    routes: DataFrame,
    properties: DataFrame,
    components: DataFrame,
    endpoints: DataFrame,
) -> DataFrame:
    """Registered services that no configured route names, unless the gateway ignores them."""
    ignoring = (
        properties.where((F.col("name") == "zuul.ignoredServices") & contains_lit(F.col("value"), "*"))
        .select("app_id", F.col("project").alias("gateway"))
        .distinct()
    )
    clients = (
        components.where(
            (F.col("kind") == rules.CLIENT)
            & (F.col("category") == rules.REGISTRY)
            & (F.col("technology") == "Eureka")
        )
        .select("app_id", F.col("service").alias("target"))
        .distinct()
    )
    targets = (
        gateway_services.join(ignoring, ["app_id", "gateway"], "left_anti")
        .join(clients, "app_id")
        .where(F.col("target") != F.col("gateway"))
        .join(routes, ["app_id", "gateway", "target"], "left_anti")
        .withColumn("prefix", F.concat(F.lit("/"), "target"))
        .withColumn("seq", F.lit(0).cast("long"))
    )
    return _forwarded(targets, endpoints, default_route=True)


def gateway_dependencies(forwarded: DataFrame, dependencies: DataFrame) -> DataFrame:
    """One wrapped dependency per forwarded endpoint the gateway does not depend on yet."""
    key = ["app_id", "service", "provider", "destination"]
    wrapped = (
        forwarded.withColumn("destination", endpoint_destination(F.col("target_uri")))
        .groupBy(*key)
        .agg(F.min_by("environment", F.struct("default_route", "seq")).alias("environment"))
    )
    known = dependencies.where(F.col("destination").isNotNull()).select(*key)
    return wrapped.join(known, key, "left_anti").select(*key, F.lit(True).alias("wrapped"), "environment")

"""From fact tables to the recovered architecture, as one plan over all applications."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetscope.functions.runtime import tune
from fleetscope.operators import components, dependencies, endpoints, services, topology
from fleetscope.operators import java_endpoints as java
from fleetscope.operators.flags import module_flags
from fleetscope.schema import Facts

DEPENDENCY_COLUMNS = ["app_id", "service", "provider", "destination", "operation", "wrapped", "environment"]


def derive(facts: Facts, materialize: Callable[[DataFrame], DataFrame] = lambda df: df) -> dict[str, DataFrame]:
    """All derived tables.

    ``materialize`` is applied to the tables that several rules read; pass
    ``fleetscope.functions.runtime.written`` for big runs so that they are computed once.
    """
    tune(facts.container.sparkSession)
    flags = materialize(module_flags(facts.library, facts.property, facts.java_annotation))
    prefixes = materialize(endpoints.endpoint_prefixes(facts.property))
    listeners = materialize(
        java.queue_listeners(facts.java_method, facts.java_annotation, facts.annotation_param)
    )

    architecture = services.architecture(facts.application, facts.app_project)
    service = services.merge_services(facts.container, facts.module)
    component = components.merge_components(materialize(components.contributions(facts, flags)))
    repositories = java.repository_types(
        facts.java_type, facts.java_annotation, facts.annotation_param, prefixes
    )
    endpoint_methods = materialize(endpoints.method_born(facts, prefixes, repositories))
    of_containers = endpoints.from_containers(facts.container)
    of_modules = materialize(endpoints.module_born(facts, flags, prefixes))
    of_types = endpoints.type_born(facts, flags, prefixes)
    endpoint = endpoints.merge_endpoints(
        materialize(
            endpoints.all_contributions(of_containers, of_modules, of_types, repositories, endpoint_methods)
        )
    )
    listener = endpoints.merge_listeners(listeners)
    queues = listener.rows.select("app_id", "service", "queue")
    dependency = dependencies.merge_dependencies(
        materialize(dependencies.contributions(facts, flags, queues, materialize))
    )

    component_rows = materialize(component.rows)
    endpoint_rows = materialize(endpoint.rows)
    typed = services.classify_services(service.rows, component_rows)

    bodies = java.body_params(facts.method_param, facts.java_annotation)
    statuses = java.response_statuses(facts.java_annotation, facts.annotation_param)
    firsts = java.first_params(facts.method_param)
    message = endpoints.merge_messages(
        reduce(
            DataFrame.unionByName,
            (
                endpoints.container_messages(of_containers),
                endpoints.module_messages(of_modules),
                java.method_messages(endpoint_methods, bodies),
                java.listener_messages(listeners, firsts),
            ),
        )
    )
    operation = endpoints.merge_operations(
        java.endpoint_operations(endpoint_methods, bodies, statuses).unionByName(
            java.listener_operations(listeners, firsts)
        )
    )

    gateway_services = topology.gateways(component_rows)
    routes = topology.route_table(gateway_services, facts.property)
    forwarded = topology.gateway_routes(routes, endpoint_rows).unionByName(
        topology.gateway_default_routes(gateway_services, routes, facts.property, component_rows, endpoint_rows)
    )
    dependency_rows = materialize(dependency.rows.select(*DEPENDENCY_COLUMNS))
    streams = topology.circuit_breaker_dependencies(component_rows, endpoint_rows)
    direct = dependency_rows.unionByName(streams, allowMissingColumns=True)
    wrapped = topology.gateway_dependencies(forwarded, direct)
    every_dependency = direct.unionByName(wrapped, allowMissingColumns=True)
    every_endpoint = endpoint_rows.select("app_id", "service", "uri", "environment", F.lit(False).alias("forwarded")).unionByName(
        forwarded.select("app_id", "service", "uri", "environment", F.lit(True).alias("forwarded"))
    )
    # What topology adds to a service has the facts of that service behind it.
    behind = service.evidence.select("app_id", "service", "evidence", (F.col("phase") * F.lit(1 << 54) + F.col("seq")).alias("ord"))
    key = ["app_id", "service", "provider", "destination"]
    added_evidence = streams.select(*key).unionByName(wrapped.select(*key)).distinct().join(behind, ["app_id", "service"])
    forwarded_evidence = forwarded.select("app_id", "service", "uri").distinct().join(behind, ["app_id", "service"])
    return {
        "architecture": architecture.rows,
        "architecture_evidence": architecture.evidence,
        "microservice": typed,
        "microservice_evidence": service.evidence,
        "pim_container": services.pim_containers(service.rows),
        "service_interface": services.service_interfaces(service.rows),
        "component": component_rows,
        "component_evidence": component.evidence,
        "endpoint": every_endpoint,
        "endpoint_evidence": endpoint.evidence.unionByName(forwarded_evidence),
        "queue_listener": listener.rows,
        "queue_listener_evidence": listener.evidence,
        "message": message.rows,
        "message_evidence": message.evidence,
        "operation": operation.rows,
        "operation_evidence": operation.evidence,
        "dependency": every_dependency,
        "dependency_evidence": dependency.evidence.unionByName(added_evidence),
    }


def service_overview(derived: dict[str, DataFrame]) -> DataFrame:
    """Which infrastructure does every service of the fleet use, and who depends on whom."""
    used = derived["component"].groupBy("app_id", "service").agg(
        F.count("*").alias("components"), F.countDistinct("category").alias("categories")
    )
    edges = dependencies.dependency_graph(derived["dependency"])
    outgoing = edges.groupBy("app_id", F.col("consumer").alias("service")).agg(F.count("*").alias("providers"))
    incoming = edges.groupBy("app_id", F.col("provider").alias("service")).agg(F.count("*").alias("consumers"))
    key = ["app_id", "service"]
    joined = derived["microservice"].select(*key, "kind")
    for part in (used, outgoing, incoming):
        joined = joined.join(part, key, "left")
    return joined.na.fill(0, ["components", "categories", "providers", "consumers"])

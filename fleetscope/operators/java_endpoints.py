"""Facts of annotated Java methods: mapped methods, listeners, repositories, messages and operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetscope import rules
from fleetscope.functions import after, before, contains_lit, order_key
from fleetscope.functions.ordering import LISTENER, METHOD, TYPE
from fleetscope.functions.runtime import shuffled
from fleetscope.functions.text import quoted
from fleetscope.operators import evidence

# What differs most stands first: sorts compare it first.
OWNER = ["owner_key", "app_id"]
PATH_PARAMS = ("value", "path", rules.NOT_AVAILABLE)


def first_annotation(annotations: DataFrame, owner_kind: str, wanted: Column) -> DataFrame:
    """The first annotation of every owner that meets ``wanted``."""
    return (
        annotations.where((F.col("owner_kind") == owner_kind) & wanted)
        .groupBy(*OWNER)
        .agg(
            F.min_by("annotation_key", "seq").alias("annotation_key"),
            F.min_by("annotation_name", "seq").alias("annotation_name"),
        )
    )


def picked_param(params: DataFrame, names: tuple[str, ...], last: bool) -> Column:
    pick = F.max_by if last else F.min_by
    return pick("param_value", F.when(F.col("param_name").isin(*names), F.col("seq")))


def type_param(
    annotations: DataFrame, params: DataFrame, annotation: str, names: tuple[str, ...], last: bool = True
) -> DataFrame:
    """(app_id, type_key, param_value) of one annotation of a type; no row without such a parameter."""
    found = first_annotation(annotations, "type", F.col("annotation_name") == annotation)
    return (
        found.join(params.where(F.col("param_name").isin(*names)), ["annotation_key", "app_id"])
        .groupBy(*OWNER)
        .agg(picked_param(params, names, last).alias("param_value"))
        .withColumnRenamed("owner_key", "type_key")
    )


def mapped_methods(methods: DataFrame, annotations: DataFrame, params: DataFrame) -> DataFrame:
    """Methods with a ``*Mapping`` annotation, with verb and path of the first such annotation."""
    mapping = first_annotation(annotations, "method", F.col("annotation_name").endswith("Mapping"))
    values = params.groupBy("annotation_key", "app_id").agg(
        picked_param(params, ("method",), last=True).alias("method_param"),
        picked_param(params, PATH_PARAMS, last=True).alias("path_param"),
    )
    named = F.substring_index("annotation_name", "Mapping", 1)
    verb = F.when(F.col("method_param").isNotNull(), after(F.col("method_param"), "RequestMethod.")).otherwise(
        F.when(named == "Request", F.lit("GET")).otherwise(named)
    )
    return (
        methods.join(mapping.withColumnRenamed("owner_key", "method_key"), ["method_key", "app_id"])
        .join(values, ["annotation_key", "app_id"], "left")
        .withColumn("verb", verb)
        .withColumn("path", F.coalesce(quoted(F.col("path_param")), F.lit("")))
        .drop("annotation_key", "annotation_name", "method_param", "path_param")
    )


def _controllers(annotations: DataFrame) -> DataFrame:
    return (
        annotations.where((F.col("owner_kind") == "type") & F.col("annotation_name").endswith("Controller"))
        .select("app_id", F.col("owner_key").alias("type_key"))
        .distinct()
    )


def controller_endpoints(
    methods: DataFrame, annotations: DataFrame, params: DataFrame, prefixes: DataFrame
) -> DataFrame:
    """Mapped methods of controller types. The service prefix counts only below a type-level mapping."""
    type_paths = type_param(annotations, params, "RequestMapping", ("value", rules.NOT_AVAILABLE))
    type_prefix = F.when(
        F.col("param_value").isNotNull(), F.concat(F.coalesce("prefix", F.lit("")), quoted(F.col("param_value")))
    ).otherwise("")
    return (
        mapped_methods(methods, annotations, params)
        .where(F.col("verb") != "")
        .join(_controllers(annotations), ["type_key", "app_id"], "left_semi")
        .join(type_paths, ["type_key", "app_id"], "left")
        .join(prefixes, ["app_id", "project"], "left")
        .withColumn("uri", F.concat(F.upper("verb"), F.lit(" "), type_prefix, "path"))
        .withColumn("ord", order_key(METHOD, F.col("seq")))
        .drop("verb", "path", "param_value", "prefix")
    )


def repository_types(
    types: DataFrame, annotations: DataFrame, params: DataFrame, prefixes: DataFrame
) -> DataFrame:
    """Types exported as REST repositories, with the path of their collection."""
    found = first_annotation(annotations, "type", F.col("annotation_name") == "RepositoryRestResource")
    paths = (
        found.join(params.where(F.col("param_name") == "path"), ["annotation_key", "app_id"])
        .groupBy(*OWNER)
        .agg(F.min_by("param_value", "seq").alias("param_value"))
        .withColumnRenamed("owner_key", "type_key")
    )
    return (
        types.select("app_id", "project", "type_key", "seq", "profile")
        .join(paths, ["type_key", "app_id"])
        .join(prefixes, ["app_id", "project"], "left")
        .withColumn(
            "collection", F.concat(F.coalesce("prefix", F.lit("")), F.lit("/"), quoted(F.col("param_value")))
        )
        .drop("param_value", "prefix")
    )


def repository_collections(repositories: DataFrame) -> DataFrame:
    return repositories.select(
        "app_id",
        F.col("project").alias("service"),
        F.concat(F.lit("GET "), "collection").alias("uri"),
        F.col("profile").alias("environment"),
        F.lit(False).alias("overwrites"),
        evidence.annotation_evidence(F.lit("RepositoryRestResource")).alias("evidence"),
        order_key(TYPE, F.col("seq"), 8).alias("ord"),
    )


def repository_searches(
    repositories: DataFrame, methods: DataFrame, method_params: DataFrame, annotations: DataFrame
) -> DataFrame:
    """One search endpoint per finder method, with its named parameters in order."""
    named = (
        annotations.where((F.col("owner_kind") == "parameter") & (F.col("annotation_name") == "Param"))
        .select("app_id", F.col("owner_key").alias("param_key"))
    )
    finders = methods.where(F.col("method_name").startswith("find"))
    # The parameters of one method: a list bounded by the declaration itself.
    lists = (
        method_params.join(shuffled(named), ["param_key", "app_id"], "left_semi")
        .groupBy("method_key", "app_id")
        .agg(F.sort_array(F.collect_list(F.struct("param_order", "param_name"))).alias("found"))
        .select(
            "app_id",
            "method_key",
            F.concat(F.lit("{?"), F.array_join(F.col("found.param_name"), ","), F.lit("}")).alias("query"),
        )
    )
    return (
        finders.join(repositories.select("app_id", "type_key", "collection"), ["type_key", "app_id"])
        .join(lists, ["method_key", "app_id"], "left")
        .withColumn(
            "uri",
            F.concat(
                F.lit("GET "), "collection", F.lit("/search/"), "method_name", F.coalesce("query", F.lit(""))
            ),
        )
        .withColumn("ord", order_key(TYPE, F.col("seq"), 9))
        .drop("collection", "query")
    )


def queue_listeners(methods: DataFrame, annotations: DataFrame, params: DataFrame) -> DataFrame:
    """Methods listening on a queue: quoted queue name, or the raw expression without operation name."""
    found = first_annotation(annotations, "method", F.col("annotation_name") == "RabbitListener")
    queues = (
        found.join(params.where(F.col("param_name") == "queues"), ["annotation_key", "app_id"])
        .groupBy(*OWNER)
        .agg(F.max_by("param_value", "seq").alias("queues"))
        .withColumnRenamed("owner_key", "method_key")
    )
    is_quoted = contains_lit(F.col("queues"), '"')
    return (
        methods.join(queues, ["method_key", "app_id"])
        .withColumn("queue", F.when(is_quoted, quoted(F.col("queues"))).otherwise(F.col("queues")))
        .withColumn(
            "operation_name", F.when(is_quoted, F.concat("method_name", F.lit("()"))).otherwise("")
        )
        .where(F.col("queue") != "")
        .withColumn("ord", order_key(LISTENER, F.col("seq")))
        .drop("queues")
    )


def body_params(method_params: DataFrame, annotations: DataFrame) -> DataFrame:
    """The first parameter of every method that is annotated as request body."""
    bodies = (
        annotations.where((F.col("owner_kind") == "parameter") & (F.col("annotation_name") == "RequestBody"))
        .select("app_id", F.col("owner_key").alias("param_key"))
    )
    return (
        method_params.join(shuffled(bodies), ["param_key", "app_id"], "left_semi")
        .groupBy("method_key", "app_id")
        .agg(
            F.min_by("type_name", "param_order").alias("body_type"),
            F.min_by("json_schema", "param_order").alias("body_schema"),
        )
    )


def first_params(method_params: DataFrame) -> DataFrame:
    return method_params.where(F.col("param_order") == 1).select(
        "app_id", "method_key", F.col("type_name").alias("body_type"), F.col("json_schema").alias("body_schema")
    )


def response_statuses(annotations: DataFrame, params: DataFrame) -> DataFrame:
    found = first_annotation(annotations, "method", F.col("annotation_name") == "ResponseStatus")
    return (
        found.join(params.where(F.col("param_name") == "value"), ["annotation_key", "app_id"])
        .groupBy(*OWNER)
        .agg(F.min_by("param_value", "seq").alias("status"))
        .withColumnRenamed("owner_key", "method_key")
    )


def _messages(methods: DataFrame, destination: str, kind: Column | str, schema: str, rule: int) -> DataFrame:
    return methods.select(
        "app_id",
        F.col("project").alias("service"),
        F.col(destination).alias("destination"),
        F.lit(kind).alias("message_type"),
        F.col(schema).alias("body_schema"),
        F.lit("JSON").alias("schema_format"),
        evidence.method_evidence(F.col("method_name")).alias("evidence"),
        (F.col("ord") + rule).alias("ord"),
    )


def method_messages(endpoint_methods: DataFrame, bodies: DataFrame) -> DataFrame:
    """Request message of the body parameter, response message of the declared return type."""
    requests = endpoint_methods.join(bodies, ["method_key", "app_id"])
    responses = endpoint_methods.where(F.col("return_type").isNotNull())
    return _messages(requests, "uri", rules.REQUEST, "body_schema", 1).unionByName(
        _messages(responses, "uri", rules.RESPONSE, "return_schema", 2)
    )


def listener_messages(listeners: DataFrame, firsts: DataFrame) -> DataFrame:
    return _messages(listeners.join(firsts, ["method_key", "app_id"]), "queue", rules.INBOUND, "body_schema", 1)


def _operations(methods: DataFrame, destination: str, description: Column) -> DataFrame:
    return methods.select(
        "app_id",
        F.col("project").alias("service"),
        F.col(destination).alias("destination"),
        F.concat("method_name", F.lit("()")).alias("name"),
        F.concat(F.lit("An operation with name "), "method_name", F.lit("()"), description).alias("description"),
        evidence.method_evidence(F.col("method_name")).alias("evidence"),
        "ord",
    )


def endpoint_operations(endpoint_methods: DataFrame, bodies: DataFrame, statuses: DataFrame) -> DataFrame:
    request = F.concat(F.lit(" requests object "), "body_type")
    response = F.when(
        F.col("return_type").isNotNull(), F.concat(F.lit(" responds with object "), "return_type")
    ).when(F.col("status").isNotNull(), F.concat(F.lit(" responds with "), "status"))
    parts = F.array_compact(F.array(request, response))
    description = F.when(F.size(parts) > 0, F.concat(F.lit(" that"), F.array_join(parts, " and"))).otherwise("")
    joined = endpoint_methods.join(bodies, ["method_key", "app_id"], "left").join(
        statuses, ["method_key", "app_id"], "left"
    )
    return _operations(joined, "uri", description)


def listener_operations(listeners: DataFrame, firsts: DataFrame) -> DataFrame:
    joined = listeners.join(firsts, ["method_key", "app_id"], "left")
    description = F.coalesce(F.concat(F.lit(" that reads object "), "body_type"), F.lit(""))
    return _operations(joined, "queue", description)

"""Which service calls which, from links, properties, declared clients and calls; and the keyed merge."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetscope import rules
from fleetscope.functions import after, before, contains_lit, order_key
from fleetscope.functions.matching import join_contains
from fleetscope.functions.ordering import ASYNC, CONTAINER, METHOD, PROPERTY, REST_TEMPLATE
from fleetscope.functions.runtime import shuffled
from fleetscope.functions.text import quoted
from fleetscope.operators import evidence
from fleetscope.operators.components import Merged
from fleetscope.operators.flags import matched_test
from fleetscope.operators.java_endpoints import mapped_methods, type_param

COLUMNS = [
    "app_id", "service", "provider", "destination", "operation", "environment", "overwrites", "from_method",
    "evidence", "ord",
]
PAIR = ["app_id", "service", "provider"]
# What differs most stands first: sorts compare it first.
CALL = ["invocation_key", "app_id"]
EXCHANGE = "callee = 'exchange' AND receiver_type = 'RestTemplate' AND receiver_package = 'org.springframework.web.client'"
SEND = "callee = 'convertAndSend'"
EXCHANGE_OR_SEND = f"({EXCHANGE}) OR ({SEND})"

_BLOCK_BITS = 20


def _contribution(facts: DataFrame, provider: Column, destination: Column, **columns: Column) -> DataFrame:
    defaults = {
        "operation": F.lit(None).cast("string"),
        "environment": F.lit(None).cast("string"),
        "overwrites": F.lit(False),
        "from_method": F.lit(False),
    }
    named = {"provider": provider, "destination": destination, **defaults, **columns}
    return facts.select(*[named[name].alias(name) if name in named else name for name in COLUMNS])


def from_links(links: DataFrame, containers: DataFrame) -> DataFrame:
    """A link is evidenced by its container and by itself."""
    owner = containers.select(
        "app_id",
        F.col("name").alias("service"),
        F.col("seq").alias("container_seq"),
        evidence.container_evidence(F.col("name"), F.col("image"), F.col("generates_logs")).alias("owner_evidence"),
    )
    joined = links.withColumnRenamed("container", "service").join(owner, ["app_id", "service"])
    texts = F.array("owner_evidence", evidence.link_evidence(F.col("target")))
    exploded = joined.select("app_id", "service", "target", "dep_order", F.posexplode(texts).alias("at", "evidence"))
    return _contribution(
        exploded,
        F.col("target"),
        F.lit(None).cast("string"),
        ord=order_key(CONTAINER, F.col("dep_order"), F.col("at")),
    )


def _provider_of_url(url: Column) -> Column:
    """Host of a URL: up to a colon, then up to a closing brace, or without one up to a slash."""
    host = F.regexp_extract(url, "(?s)^.*?://([^:]*)", 1)
    return F.regexp_replace(host, r"(?s)^(?:([^}]*)\}.*|([^}/]*)/[^}]*)$", "$1$2")


def _behind_provider(url: Column, provider: Column) -> Column:
    """URL text behind the provider, and behind the next slash; empty when either is missing."""
    at = F.instr(url, provider)
    rest = F.when(at > 0, F.substring(url, at + F.length(provider), F.length(url))).otherwise("")
    return after(rest, "/")


def from_properties(properties: DataFrame, flags: DataFrame) -> DataFrame:
    own = list(rules.OWN_HOSTS)
    source = properties.select(
        "app_id",
        F.col("project").alias("service"),
        "name",
        "value",
        F.col("profile").alias("environment"),
        F.lit(True).alias("overwrites"),
        evidence.property_evidence(F.col("name")).alias("evidence"),
        order_key(PROPERTY, F.col("seq")).alias("ord"),
    )
    hosts = source.where(matched_test("name", rules.HOST_DEPENDENCIES).isNotNull()).withColumn(
        "provider", F.lower("value")
    )
    host_rows = _contribution(
        hosts.where(~F.col("provider").isin(own)),
        F.col("provider"),
        F.lit(""),
        environment=F.col("environment"),
        overwrites=F.col("overwrites"),
    )

    url_rules = rules.table(
        properties.sparkSession,
        rules.URL_DEPENDENCIES,
        "match string, test string, unless string, head string, middle string, tail string",
    )
    provider = _provider_of_url(F.col("value"))
    urls = (
        source.withColumn("test", matched_test("name", [(row[0], row[1]) for row in rules.URL_DEPENDENCIES]))
        .where(F.col("test").isNotNull())
        .join(url_rules, "test")
        .withColumn("provider", provider)
        .where((F.col("provider") != "") & ~F.col("provider").isin(own))
        .withColumn(
            "destination",
            F.concat(
                "head",
                F.when(F.col("middle") == rules.SERVICE_NAME, F.col("service"))
                .when(F.col("middle") == rules.URL_PATH, _behind_provider(F.col("value"), F.col("provider")))
                .otherwise(""),
                "tail",
            ),
        )
    )
    # The registry veto counts server annotations too: dependencies are read after all components.
    registry_servers = flags.where(
        F.col("first_eureka").isNotNull() | F.col("eureka_annotation").isNotNull()
    ).select("app_id", F.col("project").alias("service"))
    registered = urls.where(F.col("unless").isNotNull()).join(registry_servers, ["app_id", "service"], "left_anti")
    url_rows = urls.where(F.col("unless").isNull()).unionByName(registered.select(*urls.columns))
    return host_rows.unionByName(
        _contribution(
            url_rows,
            F.col("provider"),
            F.col("destination"),
            environment=F.col("environment"),
            overwrites=F.col("overwrites"),
        )
    )


def from_feign(methods: DataFrame, annotations: DataFrame, params: DataFrame) -> DataFrame:
    """Mapped methods of a type annotated as declared client."""
    clients = type_param(annotations, params, "FeignClient", ("name",), last=False)
    joined = mapped_methods(methods, annotations, params).join(clients, ["type_key", "app_id"])
    return _contribution(
        joined.withColumn("service", F.col("project"))
        .withColumn("provider", quoted(F.col("param_value")))
        .where(F.col("provider") != "")
        .withColumn("evidence", evidence.method_evidence(F.col("method_name")))
        .withColumn("ord", order_key(METHOD, F.col("seq"))),
        F.col("provider"),
        F.concat(F.lit("Endpoint[RequestURI:"), F.upper("verb"), F.lit(" "), "path", F.lit("]")),
        operation=F.concat("method_name", F.lit("()")),
        environment=F.col("profile"),
        from_method=F.lit(True),
    )


def calls_with_args(invocations: DataFrame, args: DataFrame, wanted: str) -> DataFrame:
    """Calls that meet ``wanted``, with what the rules read of their arguments.

    Arguments of other calls are dropped before they are sorted: the largest of texts takes a sort.
    """
    calls = invocations.where(wanted).select(
        *CALL, "project", "callee", "receiver_type", "receiver_package", "root_method", "profile", "seq"
    )
    picked = (
        args.join(shuffled(calls.select(*CALL)), CALL, "left_semi")
        .groupBy(*CALL)
        .agg(
            F.count("*").alias("arg_count"),
            F.max(F.when(F.col("arg_order") == 1, F.col("arg_value"))).alias("url"),
            F.max(F.when(F.col("arg_order") == 2, F.col("arg_name"))).alias("verb_name"),
            F.max(
                F.when((F.col("arg_order") == 2) & (F.col("arg_value") != rules.NOT_AVAILABLE), F.col("arg_value"))
            ).alias("key_text"),
        )
    )
    return calls.join(picked, CALL)


def from_rest_template(invocations: DataFrame, args: DataFrame) -> DataFrame:
    """``exchange`` on a RestTemplate: provider and path from argument 1, verb from argument 2."""
    return rest_template_rows(calls_with_args(invocations, args, EXCHANGE))


def rest_template_rows(calls: DataFrame) -> DataFrame:
    full_host = before(after(F.col("url"), "//"), "/")
    at = F.instr(F.col("url"), F.col("full_host"))
    path = F.substring(F.col("url"), at + F.length("full_host"), F.length("url"))
    verb = F.when(
        contains_lit(F.col("verb_name"), "HttpMethod."), after(F.col("verb_name"), "HttpMethod.")
    ).otherwise("HTTP_REQUEST")
    joined = (
        calls.where(F.col("url") != rules.NOT_AVAILABLE)
        .withColumn("full_host", full_host)
        .withColumn(
            "provider",
            F.when(contains_lit(F.col("full_host"), ":"), before(F.col("full_host"), ":")).otherwise(
                F.col("full_host")
            ),
        )
        .withColumn("service", F.col("project"))
        .withColumn("evidence", evidence.method_evidence(F.col("callee")))
        .withColumn("ord", order_key(REST_TEMPLATE, F.col("seq")))
        .where(F.col("provider") != "")
    )
    return _contribution(
        joined,
        F.col("provider"),
        F.concat(F.lit("Endpoint[RequestURI:"), verb, F.lit(" "), path, F.lit("]")),
        operation=F.col("root_method"),
        environment=F.col("profile"),
        from_method=F.lit(True),
    )


def routing_key(value: Column, strict: bool = False) -> Column:
    """Text between the first quote and the star; without a star up to the closing quote.

    ``strict`` gives the empty key without a star, which would match every queue; such a key is dropped.
    """
    behind = after(value, '"')
    starless = F.lit("") if strict else F.when(contains_lit(behind, '"'), before(behind, '"')).otherwise(behind)
    return F.when(contains_lit(behind, "*"), before(behind, "*")).otherwise(starless)


def from_async(invocations: DataFrame, args: DataFrame, queues: DataFrame, strict: bool = False) -> DataFrame:
    """``convertAndSend`` with two arguments or more: every queue whose name contains the routing key."""
    return async_rows(calls_with_args(invocations, args, SEND), queues, strict)


def async_rows(calls: DataFrame, queues: DataFrame, strict: bool = False) -> DataFrame:
    sends = (
        calls.where("arg_count >= 2")
        .withColumn("routing", routing_key(F.col("key_text"), strict))
        .where(F.col("routing") != "")
    )
    # Of equal sends only the first and the last position count; fewer keys meet the queues.
    keys = (
        sends.groupBy("app_id", "project", "routing", "root_method", "profile", "callee")
        .agg(F.array_distinct(F.array(F.min("seq"), F.max("seq"))).alias("ends"))
        .withColumn("seq", F.explode("ends"))
    )
    listeners = queues.select("app_id", F.col("service").alias("provider"), "queue").distinct()
    wanted = keys.select("app_id", "routing").distinct()
    pairs = join_contains(listeners, "queue", wanted, "routing", ["app_id"])
    joined = keys.join(pairs, ["app_id", "routing"])
    return _contribution(
        joined.withColumn("service", F.col("project"))
        .withColumn("evidence", evidence.method_evidence(F.col("callee")))
        .withColumn("ord", order_key(ASYNC, F.col("seq"))),
        F.col("provider"),
        F.concat(F.lit("QueueListener[QueueName:"), "queue", F.lit("]")),
        operation=F.col("root_method"),
        environment=F.col("profile"),
        from_method=F.lit(True),
    )


def _next_first_use(open_rows: DataFrame, first_uses: DataFrame) -> DataFrame:
    """For every unspecified contribution the next first use of a destination in its (service, provider).

    Looked up in blocks of the reading order: windows run over one block of one pair, and over one
    summary row per block, so a pair with very many contributions is split.
    """
    block = F.shiftright("ord", _BLOCK_BITS).alias("block")
    opens = open_rows.select(*PAIR, block, "ord", F.lit(None).cast("long").alias("use"), "evidence", "environment",
                             "overwrites", "from_method", "operation", "destination")
    uses = first_uses.select(*PAIR, block, "ord", F.col("ord").alias("use"))
    inside = Window.partitionBy(*PAIR, "block").orderBy("ord").rowsBetween(1, Window.unboundedFollowing)
    later = Window.partitionBy(*PAIR).orderBy("block").rowsBetween(1, Window.unboundedFollowing)
    events = opens.unionByName(uses, allowMissingColumns=True)
    per_block = events.groupBy(*PAIR, "block").agg(F.min("use").alias("first_use"))
    carried = per_block.select(*PAIR, "block", F.min("first_use").over(later).alias("carried"))
    return (
        events.withColumn("next_use", F.min("use").over(inside))
        .where(F.col("use").isNull())
        .join(carried, [*PAIR, "block"])
        .withColumn("next_use", F.coalesce("next_use", "carried"))
        .drop("use", "block", "carried")
    )


def merge_dependencies(contributed: DataFrame) -> Merged:
    """One row per (service, provider, destination); unspecified contributions join the next destination.

    Reading in order, a contribution without destination opens an unspecified row (or joins the open
    one), and the first contribution with a new destination takes the open row over. So every
    unspecified contribution belongs to the first destination that is new after it, and what is left
    forms one unspecified row. Property hits overwrite the environment, others set it on creation.
    """
    specified = (F.col("destination").isNotNull()) & (F.col("destination") != "")
    keys = [*PAIR, "destination", "operation", "environment", "overwrites", "from_method", "evidence"]
    settled = (
        contributed.where(specified)
        .groupBy(*keys)
        .agg(F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord"))
    )
    first_uses = settled.groupBy(*PAIR, "destination").agg(F.min("first_ord").alias("ord"))
    taken = _next_first_use(contributed.where(F.coalesce(F.col("destination"), F.lit("")) == ""), first_uses)
    joined = taken.join(
        first_uses.select(*PAIR, F.col("destination").alias("taker"), F.col("ord").alias("next_use")),
        [*PAIR, "next_use"],
        "left",
    )
    absorbed = (
        joined.withColumn("destination", F.coalesce("taker", "destination"))
        .withColumn("left_over", F.col("taker").isNull())
        .groupBy(*keys, "left_over")
        .agg(F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord"))
    )
    members = settled.withColumn("left_over", F.lit(False)).unionByName(absorbed)
    # Left-over rows of one pair are one row, whether their destination is null or empty.
    row_key = [*PAIR, "row_destination"]
    members = members.withColumn("row_destination", F.when(~F.col("left_over"), F.col("destination")).otherwise(""))
    rows = members.groupBy(*row_key).agg(
        F.max("destination").alias("destination"),
        F.max_by("operation", F.when(F.col("from_method"), F.col("last_ord"))).alias("operation"),
        F.max("overwrites").alias("overwritten"),
        F.max_by("environment", F.when(F.col("overwrites"), F.col("last_ord"))).alias("last_environment"),
        F.min_by("environment", "first_ord").alias("first_environment"),
        F.min("first_ord").alias("ord"),
    )
    rows = rows.select(
        *PAIR,
        "destination",
        "operation",
        F.lit(False).alias("wrapped"),
        F.when(F.col("overwritten"), F.col("last_environment"))
        .otherwise(F.col("first_environment"))
        .alias("environment"),
        "ord",
    )
    links = members.groupBy(*row_key, "evidence").agg(F.min("first_ord").alias("ord"))
    return Merged(rows, links.select(*PAIR, F.col("row_destination").alias("destination"), "evidence", "ord"))


def contributions(
    facts, flags: DataFrame, queues: DataFrame | None = None, materialize: Callable[[DataFrame], DataFrame] = lambda df: df
) -> DataFrame:
    """``materialize`` is applied to the calls with their arguments, which two rules read."""
    wanted = EXCHANGE if queues is None else EXCHANGE_OR_SEND
    calls = materialize(calls_with_args(facts.java_invocation, facts.invocation_arg, wanted))
    parts = [
        from_links(facts.container_link, facts.container),
        from_properties(facts.property, flags),
        from_feign(facts.java_method, facts.java_annotation, facts.annotation_param),
        rest_template_rows(calls.where(EXCHANGE)),
    ]
    if queues is not None:
        parts.append(async_rows(calls.where(SEND), queues))
    return reduce(DataFrame.unionByName, parts)


def dependency_graph(dependencies: DataFrame) -> DataFrame:
    """Distinct consumer -> provider edges."""
    return dependencies.select("app_id", F.col("service").alias("consumer"), "provider").distinct()

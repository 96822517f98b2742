"""Fact tables projected from the star-schema test tables, in SQL that Spark and DuckDB both run.

Every row of a source table yields a fact. ``seq`` orders the facts of one owner.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fleetscope import rules
from fleetscope.functions.runtime import tune, written

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)

SERVICES = "(SELECT count(*) FROM supplier)"


def div(value: str, by: int) -> str:
    return f"CAST(floor({value} / {by}) AS BIGINT)"


def cases(index: str, slots, other: str) -> str:
    whens = " ".join(f"WHEN {number} THEN {text}" for number, text in enumerate(slots))
    return f"CASE {index} {whens} ELSE {other} END"


def names(slots):
    return [f"'{slot}'" for slot in slots]


def text(value: str) -> str:
    return f"CAST({value} AS STRING)"


IMAGES = (
    "mongo:4", "mysql:5.7", "acme/rabbitmq", "consul", "kibana:7", "elasticsearch:7", "logstash:7", "redis",
    "weaveworks/scope", "openzipkin/zipkin", "prom/mysqld-exporter", "acme/mongo-mysql",
)

CONTAINER = f"""
SELECT {div('s_suppkey', 10)} AS app_id, s_suppkey AS seq, 'fleet' AS project, 'docker-compose.yml' AS artifact,
  'svc-' || {text('s_suppkey')} AS name,
  {cases('s_suppkey % 32', names(IMAGES), "'base AS final'")} AS image,
  './services/svc-' || {text('s_suppkey')} AS build, s_acctbal < 0 AS generates_logs
FROM supplier
UNION ALL
SELECT {div('p_partkey', 200)}, 100000000 + p_partkey, 'fleet', 'docker-compose.yml',
  'part-' || {text('p_partkey')},
  {cases('p_partkey % 16', names(IMAGES), "'acme/' || p_brand")}, '', p_size < 5
FROM part"""

LINK = f"""
SELECT app_id, min(seq) AS seq, 'fleet' AS project, 'docker-compose.yml' AS artifact, container,
  CAST(row_number() OVER (PARTITION BY app_id, container ORDER BY min(seq), target) AS INT) AS dep_order, target
FROM (
  SELECT {div('l_suppkey', 10)} AS app_id, l_orderkey * 8 + l_linenumber AS seq,
    'svc-' || {text('l_suppkey')} AS container,
    CASE WHEN l_partkey % 5 = 0
      THEN 'part-' || {text(f"{div('l_suppkey', 10)} * 200 + l_partkey % 200")}
      ELSE 'svc-' || {text(f"{div('l_suppkey', 10)} * 10 + l_partkey % 10")} END AS target
  FROM lineitem
) linked
GROUP BY app_id, container, target"""

MODULE = f"""
SELECT {div('s_suppkey', 10)} AS app_id, s_suppkey AS seq, 'fleet' AS project, 'pom.xml' AS artifact,
  'svc-' || {text('s_suppkey')} AS artifact_id,
  {cases('s_suppkey % 3', names(('Microservice', 'SpringMVC')), "'SpringWebFlux'")} AS kind
FROM supplier"""

APPLICATION = f"""
SELECT {div('s_suppkey', 10)} AS app_id, min(s_suppkey) AS seq, 'app-' || {text(div('min(s_suppkey)', 10))} AS app_name,
  '/src' AS package_url
FROM supplier GROUP BY {div('s_suppkey', 10)}"""

APP_PROJECT = f"""
SELECT {div('s_suppkey', 10)} AS app_id, min(s_suppkey) AS seq,
  'project-' || {text(div('min(s_suppkey)', 10))} AS project, 'pom.xml' AS artifact,
  'parent-' || {text('count(*)')} AS artifact_id
FROM supplier GROUP BY {div('s_suppkey', 10)}"""

_USER = f"(user_id % {SERVICES})"
_PEER = f"({div(_USER, 10)} * 10 + event_id % 10)"
_URL = (
    f"CASE event_id % 7 WHEN 0 THEN 'http://localhost:8080/p/' || event_type "
    f"WHEN 1 THEN 'http://svc-' || {text(_PEER)} || '/p/' || event_type "
    f"WHEN 2 THEN 'http://svc-' || {text(_PEER)} || '}}/p:1/' || event_type "
    f"WHEN 3 THEN event_type "
    f"ELSE 'http://svc-' || {text(_PEER)} || ':80/p/' || event_type END"
)
_HOST = (
    f"CASE event_id % 4 WHEN 0 THEN 'localhost' WHEN 1 THEN 'SVC-' || {text(_PEER)} "
    f"ELSE 'part-' || {text(f'{div(_USER, 10)} * 200 + event_id % 200')} END"
)
PLAIN, URL, HOST, DIGIT, FLAG, IGNORED, ROUTE = range(7)
# (name, text behind the peer service's name or null, value kind, plain value); the position is the
# remainder of the event id, other remainders give names no rule knows.
PROPERTY_SLOTS = (
    ("eureka.client.registerWithEureka", None, FLAG, ""),
    ("eureka.client.fetchRegistry", None, PLAIN, "false"),
    ("management.endpoints.actuator.exposure.include", None, PLAIN, "*"),
    ("management.endpoints.actuator.base-path", None, PLAIN, "/a"),
    ("hystrix.command.default.circuitBreaker.requestVolumeThreshold", None, DIGIT, ""),
    ("hystrix.command.default.execution.isolation.thread.timeoutInMilliseconds", None, DIGIT, ""),
    ("spring.cloud.config.uri", None, URL, ""),
    ("eureka.client.serviceUrl.defaultZone", None, URL, ""),
    ("management.tracing.exporter.zipkin.endpoint", None, URL, ""),
    ("management.tracing.sampler", None, PLAIN, "1"),
    ("management.tracing.exporterEndpoint", None, URL, ""),
    ("spring.data.mongodb.host", None, HOST, ""),
    ("spring.data.mongodb.uri", None, URL, ""),
    ("spring.cloud.config.server.native.searchLocations", None, PLAIN, "file"),
    ("spring.cloud.config.server.git.uri", None, PLAIN, "git"),
    ("security.oauth2.resource.user-info-uri", None, URL, ""),
    ("security.user.password", None, PLAIN, "p"),
    ("spring.rabbitmq.host", None, HOST, ""),
    ("ribbon.ReadTimeout", None, DIGIT, ""),
    ("ribbon.ConnectTimeout", None, PLAIN, "0"),
    ("zuul.ignoredServices", None, IGNORED, ""),
    ("zuul.routes.svc-", ".path", ROUTE, ""),
    ("zuul.routes.svc-", ".serviceId", PLAIN, "unused"),
    ("mysql.client.server", None, HOST, ""),
    ("mysql.client.database", None, PLAIN, "main"),
    ("redis.client.host", None, HOST, ""),
    ("logging.level.root", None, PLAIN, "INFO"),
    ("server.contextPath", None, PLAIN, "/ctx"),
    ("server.servlet.context-path", None, PLAIN, "/uaa"),
    ("security.oauth2.resource.jwt.keyUri", None, URL, ""),
    ("client.oauth2.client.accessTokenUri", None, URL, ""),
    ("client.oauth2.client.userAuthorizationUri", None, URL, ""),
    ("server.port", None, PLAIN, "8080"),
)


def rows(items) -> str:
    return ", ".join("(" + ", ".join("NULL" if v is None else repr(v) for v in item) + ")" for item in items)


PROPERTY = f"""
SELECT {div(_USER, 10)} AS app_id, event_id AS seq, 'svc-' || {text(_USER)} AS project,
  'application.yml' AS artifact,
  CASE WHEN slot IS NULL THEN 'app.setting.' || {text('event_id % 97')}
    WHEN behind IS NULL THEN head ELSE head || {text(_PEER)} || behind END AS name,
  CASE kind WHEN {URL} THEN {_URL} WHEN {HOST} THEN {_HOST} WHEN {DIGIT} THEN {text('event_id % 3')}
    WHEN {FLAG} THEN CASE WHEN event_id % 3 = 0 THEN 'true' ELSE 'false' END
    WHEN {IGNORED} THEN CASE WHEN event_id % 4 = 0 THEN 'none' ELSE '*' END
    WHEN {ROUTE} THEN '/r' || event_type || '/**' WHEN {PLAIN} THEN plain ELSE event_type END AS value,
  CASE WHEN event_type IN ('error', 'view') THEN 'DOCKER' ELSE 'COMPILE' END AS profile
FROM events LEFT JOIN (VALUES {rows((number, *slot) for number, slot in enumerate(PROPERTY_SLOTS))})
  slots(slot, head, behind, kind, plain) ON event_id % 97 = slot"""

LIBRARY_SLOTS = (
    "spring-boot-starter-actuator", "spring-cloud-starter-netflix-hystrix", "spring-cloud-starter-hystrix",
    "spring-cloud-starter-config", "spring-cloud-config-client", "spring-boot-starter-security",
    "spring-cloud-starter-security", "spring-security-oauth2", "spring-boot-starter-data-mongodb",
    "de.flapdoodle.embed.mongo", "spring-cloud-starter-turbine", "hsqldb", "mysql-connector-java",
    "spring-boot-starter-amqp", "spring-cloud-config-server", "spring-cloud-starter-eureka-server",
    "spring-cloud-starter-netflix-eureka-server", "spring-cloud-starter-netflix-eureka-client",
    "spring-cloud-starter-eureka", "spring-cloud-starter-netflix-zuul", "spring-cloud-starter-zuul",
    "spring-cloud-starter-sleuth", "spring-cloud-starter-hystrix-dashboard", "spring-boot-starter-webflux",
)
LINE_SEQ = "((l_orderkey * 8 + l_linenumber) * 32768 + l_partkey) * 64 + CAST(l_quantity AS BIGINT)"

LIBRARY = f"""
SELECT {div('l_suppkey', 10)} AS app_id, {LINE_SEQ} AS seq, 'svc-' || {text('l_suppkey')} AS project,
  'pom.xml' AS artifact, 'org.group' || {text('l_partkey % 3')} AS group_name,
  coalesce(library, 'lib-' || {text('l_partkey % 911')}) AS library_name,
  CASE l_returnflag WHEN 'A' THEN 'COMPILE' WHEN 'N' THEN 'RUNTIME' ELSE 'TEST' END AS scope
FROM lineitem LEFT JOIN (VALUES {rows(enumerate(LIBRARY_SLOTS))}) slots(slot, library) ON l_partkey % 911 = slot"""

_TYPE_OWNER = f"(c_custkey % {SERVICES})"
_TYPE_SLOT = f"{div('abs(c_acctbal)', 1)} % 37"

JAVA_TYPE = f"""
SELECT {div(_TYPE_OWNER, 10)} AS app_id, c_custkey AS seq, 'svc-' || {text(_TYPE_OWNER)} AS project,
  'T' || {text('c_custkey')} || '.java' AS artifact, 'T' || {text('c_custkey')} AS type_key,
  'T' || {text('c_custkey')} AS type_id, 'com.acme' AS package,
  CASE WHEN c_nationkey % 4 = 1 THEN 'Interface' ELSE 'Class' END AS kind, 'COMPILE' AS profile, '' AS json_schema
FROM customer"""

IMPORTS = (
    ("EnableAuthorizationServer", rules.OAUTH_PACKAGE),
    ("AuthorizationServerConfigurerAdapter", rules.OAUTH_PACKAGE),
    ("Logger", "org.slf4j"),
    ("LoggerFactory", "org.slf4j"),
    ("Logger", "java.util.logging"),
)
JAVA_SUPERTYPE = f"""
SELECT {div(_TYPE_OWNER, 10)} AS app_id, c_custkey AS seq, 'svc-' || {text(_TYPE_OWNER)} AS project,
  'T' || {text('c_custkey')} || '.java' AS artifact, 'T' || {text('c_custkey')} AS type_key,
  CASE WHEN c_nationkey % 2 = 0 THEN 'imports' ELSE 'extends' END AS relation,
  {cases(f"{div('abs(c_acctbal)', 1)} % 11", names(name for name, _ in IMPORTS), "'Other'")} AS target_id,
  {cases(f"{div('abs(c_acctbal)', 1)} % 11", names(package for _, package in IMPORTS), "'com.other'")}
    AS target_package,
  'COMPILE' AS profile
FROM customer"""

STEREOTYPES = ("RestController", "RepositoryRestResource", "FeignClient", "Component")
TYPE_ANNOTATIONS = (
    "EnableConfigServer", "EnableZuulProxy", "EnableEurekaServer", "EnableDiscoveryClient", "EnableWebSecurity",
    "EnableResourceServer", "EnableAuthorizationServer", "EnableHystrixDashboard", "EnableTurbineStream", "Slf4j",
)
METHOD_ANNOTATIONS = ("GetMapping", "PostMapping", "RequestMapping", "RabbitListener", "ResponseStatus")

_METHOD_OWNER = f"(o_custkey % {SERVICES})"
_METHOD_SLOT = f"{div('o_totalprice', 1)} % 6"
# Line numbers of an order repeat; this one doesn't.
LINE_NUMBER = (
    "row_number() OVER (PARTITION BY l_orderkey "
    "ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag, l_linestatus)"
)
_PARAM = f"""
  SELECT l_orderkey, {LINE_NUMBER} AS l_linenumber, l_partkey AS partkey, l_returnflag AS flag FROM lineitem"""
_PARAM_KEY = f"{text('l_orderkey')} || '#' || {text('l_linenumber')}"

JAVA_ANNOTATION = f"""
SELECT {div(_TYPE_OWNER, 10)} AS app_id, c_custkey * 2 AS seq, 'svc-' || {text(_TYPE_OWNER)} AS project,
  'T.java' AS artifact, 'type' AS owner_kind, 'T' || {text('c_custkey')} AS owner_key,
  'a' || {text('c_custkey')} AS annotation_key,
  {cases('c_nationkey % 4', names(STEREOTYPES[:3]), f"'{STEREOTYPES[3]}'")} AS annotation_name,
  'COMPILE' AS profile
FROM customer
UNION ALL
SELECT {div(_TYPE_OWNER, 10)}, c_custkey * 2 + 1, 'svc-' || {text(_TYPE_OWNER)}, 'T.java', 'type',
  'T' || {text('c_custkey')}, 'b' || {text('c_custkey')},
  {cases(_TYPE_SLOT, names(TYPE_ANNOTATIONS), "'RequestMapping'")},
  CASE WHEN c_nationkey % 3 = 0 THEN 'TEST' ELSE 'COMPILE' END
FROM customer
UNION ALL
SELECT {div(_METHOD_OWNER, 10)}, o_orderkey, 'svc-' || {text(_METHOD_OWNER)}, 'T.java', 'method',
  {text('o_orderkey')}, 'm' || {text('o_orderkey')},
  {cases(_METHOD_SLOT, names(METHOD_ANNOTATIONS), "'Override'")}, 'COMPILE'
FROM orders
UNION ALL
SELECT {div(_METHOD_OWNER, 10)}, o_orderkey * 64 + l_linenumber, 'svc-' || {text(_METHOD_OWNER)}, 'T.java',
  'parameter', {_PARAM_KEY}, 'p' || {_PARAM_KEY},
  CASE flag WHEN 'A' THEN 'Param' WHEN 'N' THEN 'RequestBody' ELSE 'PathVariable' END, 'COMPILE'
FROM ({_PARAM}) param JOIN orders ON o_orderkey = l_orderkey"""

ANNOTATION_PARAM = f"""
SELECT {div(_TYPE_OWNER, 10)} AS app_id, CAST(0 AS BIGINT) AS seq, 'a' || {text('c_custkey')} AS annotation_key,
  CASE c_nationkey % 4 WHEN 1 THEN 'path' WHEN 2 THEN 'name' ELSE 'NOT_AVAILABLE' END AS param_name,
  CASE WHEN c_nationkey % 4 = 2
    THEN '"svc-' || {text(f'{div(_TYPE_OWNER, 10)} * 10 + c_custkey % 7')} || '"'
    ELSE '"p' || {text('c_custkey')} || '"' END AS param_value
FROM customer
UNION ALL
SELECT {div(_TYPE_OWNER, 10)}, CAST(0 AS BIGINT), 'b' || {text('c_custkey')},
  CASE c_nationkey % 3 WHEN 0 THEN 'value' WHEN 1 THEN 'produces' ELSE 'NOT_AVAILABLE' END,
  '"/r/' || {text('c_custkey')} || '"'
FROM customer
UNION ALL
SELECT {div(_METHOD_OWNER, 10)}, CAST(0 AS BIGINT), 'm' || {text('o_orderkey')},
  CASE {_METHOD_SLOT} WHEN 0 THEN 'value' WHEN 1 THEN 'NOT_AVAILABLE' WHEN 2 THEN 'path' WHEN 3 THEN 'queues'
    ELSE 'value' END,
  CASE {_METHOD_SLOT}
    WHEN 3 THEN CASE WHEN o_orderkey % 3 = 0 THEN 'Queues.EVENTS' ELSE '"q.' || {text('o_orderkey % 50')} || '.ev"' END
    WHEN 4 THEN 'HttpStatus.CREATED' ELSE '"/m/' || {text('o_orderkey % 20')} || '"' END
FROM orders
UNION ALL
SELECT {div(_METHOD_OWNER, 10)}, CAST(1 AS BIGINT), 'm' || {text('o_orderkey')}, 'method',
  'RequestMethod.' || CASE WHEN o_orderkey % 2 = 0 THEN 'put' ELSE 'DELETE' END
FROM orders"""

JAVA_METHOD = f"""
SELECT {div(_METHOD_OWNER, 10)} AS app_id, o_orderkey AS seq, 'svc-' || {text(_METHOD_OWNER)} AS project,
  'T.java' AS artifact, 'T' || {text('o_custkey')} AS type_key, {text('o_orderkey')} AS method_key,
  CASE WHEN o_orderkey % 5 = 0 THEN 'findBy' ELSE 'm' END || {text('o_orderkey % 100')} AS method_name,
  CASE WHEN o_orderstatus = 'F' THEN CAST(NULL AS STRING) ELSE 'Page<' || o_orderstatus || '>' END AS return_type,
  'com.acme' AS return_package, '' AS return_schema, 'COMPILE' AS profile
FROM orders"""

METHOD_PARAM = f"""
SELECT {div(_METHOD_OWNER, 10)} AS app_id, CAST(l_linenumber AS BIGINT) AS seq, {text('l_orderkey')} AS method_key,
  {_PARAM_KEY} AS param_key, CAST(l_linenumber AS INT) AS param_order, 'arg' || {text('l_linenumber')} AS param_name,
  'Item' || {text('partkey % 9')} AS type_name, 'com.acme' AS type_package, '' AS json_schema
FROM ({_PARAM}) param JOIN orders ON o_orderkey = l_orderkey"""

_CALL_KEY = text(LINE_SEQ)
_CALL = "l_partkey % 5"
JAVA_INVOCATION = f"""
SELECT {div(_METHOD_OWNER, 10)} AS app_id, {LINE_SEQ} AS seq, 'svc-' || {text(_METHOD_OWNER)} AS project,
  'T.java' AS artifact, {text('l_orderkey')} AS method_key, {_CALL_KEY} AS invocation_key,
  'm' || {text('l_orderkey % 100')} || '()' AS root_method,
  CASE {_CALL} WHEN 0 THEN 'exchange' WHEN 1 THEN 'convertAndSend' WHEN 2 THEN 'authenticate' ELSE 'other' END AS callee,
  CASE {_CALL} WHEN 0 THEN 'RestTemplate' WHEN 2 THEN 'AuthenticationManager' ELSE 'Some' END AS receiver_type,
  CASE {_CALL} WHEN 0 THEN 'org.springframework.web.client'
    WHEN 2 THEN CASE WHEN l_partkey % 400 = 2 THEN 'org.springframework.security.authentication' ELSE 'com.acme' END
    ELSE 'com.acme' END AS receiver_package,
  'COMPILE' AS profile
FROM lineitem JOIN orders ON o_orderkey = l_orderkey"""

INVOCATION_ARG = f"""
SELECT {div(_METHOD_OWNER, 10)} AS app_id, CAST(1 AS BIGINT) AS seq, {_CALL_KEY} AS invocation_key, 1 AS arg_order,
  'NOT_AVAILABLE' AS arg_name,
  CASE WHEN {_CALL} = 0
    THEN 'http://svc-' || {text(f'{div(_METHOD_OWNER, 10)} * 10 + l_partkey % 10')} || ':8080/x/' || {text('l_partkey % 6')}
    ELSE 'NOT_AVAILABLE' END AS arg_value
FROM lineitem JOIN orders ON o_orderkey = l_orderkey
UNION ALL
SELECT {div(_METHOD_OWNER, 10)}, CAST(2 AS BIGINT), {_CALL_KEY}, 2,
  CASE WHEN {_CALL} = 0 AND l_partkey % 2 = 0 THEN 'HttpMethod.POST' ELSE 'NOT_AVAILABLE' END,
  CASE WHEN {_CALL} = 1 AND l_partkey % 3 = 0 THEN '"q.' || {text('l_partkey % 50')} || '.*"'
    WHEN {_CALL} = 1 AND l_partkey % 3 = 1 THEN '"EVENTS"' ELSE 'NOT_AVAILABLE' END
FROM lineitem JOIN orders ON o_orderkey = l_orderkey"""

FACT_SQL = {
    "application": APPLICATION,
    "app_project": APP_PROJECT,
    "container": CONTAINER,
    "container_link": LINK,
    "module": MODULE,
    "library": LIBRARY,
    "property": PROPERTY,
    "java_type": JAVA_TYPE,
    "java_supertype": JAVA_SUPERTYPE,
    "java_annotation": JAVA_ANNOTATION,
    "annotation_param": ANNOTATION_PARAM,
    "java_method": JAVA_METHOD,
    "method_param": METHOD_PARAM,
    "java_invocation": JAVA_INVOCATION,
    "invocation_arg": INVOCATION_ARG,
}

# Lines with their positions and orders: what the facts of calls and parameters are made of.
_ORDERED_LINE = f"""
SELECT o_orderkey, o_custkey, l_orderkey, l_linenumber, l_position, l_partkey, l_quantity, l_returnflag
FROM (SELECT l_orderkey, l_linenumber, {LINE_NUMBER} AS l_position, l_partkey, l_quantity, l_returnflag FROM lineitem) line
JOIN orders ON o_orderkey = l_orderkey"""
_FROM_ORDERED_LINE = {
    f"({_PARAM}) param JOIN orders ON o_orderkey = l_orderkey": """(SELECT o_orderkey, o_custkey, l_orderkey,
  l_position AS l_linenumber, l_partkey AS partkey, l_returnflag AS flag FROM ordered_line) param""",
    "FROM lineitem JOIN orders ON o_orderkey = l_orderkey": "FROM ordered_line",
}


def register(spark: SparkSession, sf_dir: str) -> None:
    tune(spark)
    for table in TABLES:
        spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)


class LazyFacts:
    """Fact tables by attribute; only the ones a query reads are projected."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark = spark
        self._seen: dict[str, DataFrame] = {}
        self._flags: DataFrame | None = None
        self._lines_shared = False
        register(spark, sf_dir)
        # Counted once: as a subquery it would stand in the plan once for every use of an owner.
        self._services = str(spark.table("supplier").count())

    def _sql(self, statement: str) -> DataFrame:
        return self._spark.sql(statement.replace(SERVICES, self._services))

    def share_lines(self) -> None:
        """Join lines with their orders once, into the shared folder, for a query that makes several facts of them."""
        if not self._lines_shared:
            written(self._spark.sql(_ORDERED_LINE)).createOrReplaceTempView("ordered_line")
            self._lines_shared = True
            self._seen.clear()

    def _fact(self, name: str) -> str:
        statement = FACT_SQL[name]
        for join, shared in _FROM_ORDERED_LINE.items() if self._lines_shared else ():
            statement = statement.replace(join, shared)
        return statement

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._seen:
            self._seen[name] = self._sql(self._fact(name))
        return self._seen[name]


def with_facts(query: str, *used: str) -> str:
    """Put the used fact tables in front of an oracle query as ``f_<name>``."""
    parts = ", ".join(f"f_{name} AS ({FACT_SQL[name]})" for name in used)
    return f"WITH {parts}{', ' if parts else ''}{query.strip()}"

"""Rule catalogue: which fact yields which component, endpoint, message or dependency.

Fixed values. Every table has a fixed number of rows (all far below 100), which is what makes
broadcasting them safe at any data size.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

# --- Fixed values: infrastructure categories, in their declared order (0-20) ---
API_GATEWAY = "Service_Routing_Pattern_API_Gateway_and_Proxy"
REGISTRY = "Service_Routing_Pattern_Registry_and_Discovery"
CONFIGURATION = "Development_Pattern_Centralized_Configuration"
PERSISTENCE = "Development_Pattern_Data_Persistence"
CACHE = "Development_Pattern_Data_Cache"
BROKER = "Development_Pattern_Asynchronous_Message_Brokering"
LOAD_BALANCER = "Client_Resiliency_Pattern_Load_Balancer"
CIRCUIT_BREAKER = "Client_Resiliency_Pattern_Circuit_Breaker"
WEB_SECURITY = "Security_Pattern_Web_Security"
AUTHORIZATION = "Security_Pattern_Authorization_and_Authentication"
LOGGING = "Observability_Pattern_Application_Metrics_Logging"
METRICS_GENERATION = "Observability_Pattern_Application_Metrics_Generation"
METRICS_AGGREGATION = "Observability_Pattern_Application_Metrics_Aggregation"
METRICS_ANALYSIS = "Observability_Pattern_Application_Metrics_Analysis"
METRICS_MONITORING = "Observability_Pattern_Application_Metrics_Monitoring"
BREAKER_GENERATION = "Observability_Pattern_Circuit_Breaker_Metrics_Generation"
BREAKER_AGGREGATION = "Observability_Pattern_Circuit_Breaker_Metrics_Aggregation"
BREAKER_MONITORING = "Observability_Pattern_Circuit_Breaker_Metrics_Monitoring"
LOG_CORRELATION = "Observability_Pattern_Log_Correlation"
TRACING = "Observability_Pattern_Distributed_Tracing"
TRACING_MONITORING = "Observability_Pattern_Distributed_Tracing_and_Monitoring"

CATEGORIES = (
    API_GATEWAY, REGISTRY, CONFIGURATION, PERSISTENCE, CACHE, BROKER, LOAD_BALANCER,
    CIRCUIT_BREAKER, WEB_SECURITY, AUTHORIZATION, LOGGING, METRICS_GENERATION,
    METRICS_AGGREGATION, METRICS_ANALYSIS, METRICS_MONITORING, BREAKER_GENERATION,
    BREAKER_AGGREGATION, BREAKER_MONITORING, LOG_CORRELATION, TRACING, TRACING_MONITORING,
)

PATTERN, SERVER, CLIENT = "Pattern", "Server", "Client"

# Running flags of one module.
ACTUATOR, HYSTRIX, CONFIG_CLIENT, ZUUL, EUREKA = "actuator", "hystrix", "config_client", "zuul", "eureka"

# --- Fixed values: image text that marks an infrastructure service ---
INFRASTRUCTURE_IMAGES = (
    "mongo", "mysql", "rabbitmq", "consul", "kibana", "elasticsearch", "logstash", "redis", "zipkin",
)

# --- Fixed values: image text -> server component (rule number, text, category, technology) ---
IMAGE_COMPONENTS = (
    (2, "mongo", PERSISTENCE, "MongoDB"),
    (3, "mysql", PERSISTENCE, "MySQL"),
    (4, "rabbitmq", BROKER, "RabbitMQ"),
    (5, "consul", BROKER, "Consul"),
    (6, "consul", REGISTRY, "Consul"),
    (7, "consul", CONFIGURATION, "Consul"),
    (8, "kibana", METRICS_MONITORING, "Logging"),
    (9, "elasticsearch", METRICS_ANALYSIS, "Logging"),
    (10, "logstash", METRICS_AGGREGATION, "Logging"),
    (11, "redis", CACHE, "Redis"),
    (12, "scope", METRICS_MONITORING, "Scope"),
    (13, "zipkin", TRACING_MONITORING, "Zipkin"),
)

# --- Fixed values: image text -> endpoint ---
IMAGE_ENDPOINTS = (
    (1, "consul", "PUT", "/catalog/register"),
    (2, "zipkin", "GET", "/api/v2/spans"),
    (3, "zipkin", "POST", "/api/v2/spans"),
)

ACTUATOR_LIBRARIES = ("spring-boot-starter-actuator",)
HYSTRIX_LIBRARIES = ("spring-cloud-starter-netflix-hystrix", "spring-cloud-starter-hystrix")
CONFIG_CLIENT_LIBRARIES = ("spring-cloud-starter-config", "spring-cloud-config-client")
EUREKA_SERVER_LIBRARIES = ("spring-cloud-starter-eureka-server", "spring-cloud-starter-netflix-eureka-server")
EUREKA_CLIENT_LIBRARIES = ("spring-cloud-starter-netflix-eureka-client", "spring-cloud-starter-eureka")
ZUUL_LIBRARIES = ("spring-cloud-starter-netflix-zuul", "spring-cloud-starter-zuul")
SECURITY_LIBRARIES = ("spring-boot-starter-security", "spring-cloud-starter-security")

ANY_SCOPE, ONLY_RUNTIME, NOT_RUNTIME = "any", "runtime", "not_runtime"

# --- Fixed values: library name -> component (names, scope test, kind, category, technology, needed flag) ---
LIBRARY_COMPONENTS = (
    (ACTUATOR_LIBRARIES, ANY_SCOPE, PATTERN, METRICS_GENERATION, "Actuator", None),
    (ACTUATOR_LIBRARIES, ANY_SCOPE, PATTERN, BREAKER_GENERATION, "Hystrix", HYSTRIX),
    (HYSTRIX_LIBRARIES, ANY_SCOPE, PATTERN, CIRCUIT_BREAKER, "Hystrix", None),
    (HYSTRIX_LIBRARIES, ANY_SCOPE, PATTERN, BREAKER_GENERATION, "Hystrix", ACTUATOR),
    (CONFIG_CLIENT_LIBRARIES, ANY_SCOPE, CLIENT, CONFIGURATION, "Spring Cloud Config", None),
    (SECURITY_LIBRARIES, ANY_SCOPE, PATTERN, WEB_SECURITY, "Spring Security", None),
    (("spring-security-oauth2",), ANY_SCOPE, PATTERN, AUTHORIZATION, "Spring Cloud OAuth2", None),
    (("spring-boot-starter-data-mongodb",), ANY_SCOPE, CLIENT, PERSISTENCE, "MongoDB", None),
    (("de.flapdoodle.embed.mongo",), ANY_SCOPE, PATTERN, PERSISTENCE, "MongoDB", None),
    (("spring-cloud-starter-turbine",), ANY_SCOPE, PATTERN, BREAKER_AGGREGATION, "Turbine", None),
    (("hsqldb",), ONLY_RUNTIME, PATTERN, PERSISTENCE, "HSQLDB", None),
    (("mysql-connector-java",), NOT_RUNTIME, CLIENT, PERSISTENCE, "MySQL", None),
    (("spring-boot-starter-amqp",), NOT_RUNTIME, CLIENT, BROKER, "RabbitMQ", None),
    (("spring-cloud-config-server",), ANY_SCOPE, SERVER, CONFIGURATION, "Spring Cloud Config", None),
    (EUREKA_SERVER_LIBRARIES, ANY_SCOPE, SERVER, REGISTRY, "Eureka", None),
    (EUREKA_SERVER_LIBRARIES, ANY_SCOPE, PATTERN, LOAD_BALANCER, "Ribbon", None),
    (EUREKA_CLIENT_LIBRARIES, ANY_SCOPE, CLIENT, REGISTRY, "Eureka", None),
    (EUREKA_CLIENT_LIBRARIES, ANY_SCOPE, PATTERN, LOAD_BALANCER, "Ribbon", None),
    (ZUUL_LIBRARIES, ANY_SCOPE, SERVER, API_GATEWAY, "Zuul", None),
    # The spelling of the technology is part of the expected output.
    (("spring-cloud-starter-sleuth",), ANY_SCOPE, PATTERN, TRACING, "Spring Cloud Slueth", None),
    (("spring-cloud-starter-hystrix-dashboard",), ANY_SCOPE, SERVER, BREAKER_MONITORING, "Hystrix", None),
)

EXACT, PREFIX, SUFFIX = "exact", "prefix", "suffix"
ANY_VALUE, NOT_ZERO = "any", "not_zero"

BREAKER_PROPERTIES = (
    "hystrix.command.default.circuitBreaker.requestVolumeThreshold",
    "hystrix.command.default.execution.isolation.thread.timeoutInMilliseconds",
)
ACTUATOR_PROPERTY_PREFIX = "management.endpoints.actuator."
CONFIG_URI_PROPERTY = "spring.cloud.config.uri"
CONFIG_SERVER_PREFIXES = ("spring.cloud.config.server.native.", "spring.cloud.config.server.git.")
ZIPKIN_PROPERTY = "management.tracing.exporter.zipkin.endpoint"
TRACING_PREFIX = "management.tracing"
REGISTRY_URL_PREFIX = "eureka.client.serviceUrl"
NO_REGISTER_PROPERTY = "eureka.client.registerWithEureka"
NO_FETCH_PROPERTY = "eureka.client.fetchRegistry"

# --- Fixed values: property test -> component
#     (match, text, value test, kind, category, technology, needed flag, vetoing flag) ---
PROPERTY_COMPONENTS = (
    (PREFIX, ACTUATOR_PROPERTY_PREFIX, ANY_VALUE, PATTERN, METRICS_GENERATION, "Actuator", None, None),
    (PREFIX, ACTUATOR_PROPERTY_PREFIX, ANY_VALUE, PATTERN, BREAKER_GENERATION, "Hystrix", HYSTRIX, None),
    (EXACT, BREAKER_PROPERTIES[0], NOT_ZERO, PATTERN, CIRCUIT_BREAKER, "Hystrix", None, None),
    (EXACT, BREAKER_PROPERTIES[1], NOT_ZERO, PATTERN, CIRCUIT_BREAKER, "Hystrix", None, None),
    (EXACT, BREAKER_PROPERTIES[0], NOT_ZERO, PATTERN, BREAKER_GENERATION, "Hystrix", ACTUATOR, None),
    (EXACT, BREAKER_PROPERTIES[1], NOT_ZERO, PATTERN, BREAKER_GENERATION, "Hystrix", ACTUATOR, None),
    (EXACT, CONFIG_URI_PROPERTY, ANY_VALUE, CLIENT, CONFIGURATION, "Spring Cloud Config", None, None),
    (PREFIX, REGISTRY_URL_PREFIX, ANY_VALUE, CLIENT, REGISTRY, "Eureka", None, EUREKA),
    (PREFIX, REGISTRY_URL_PREFIX, ANY_VALUE, PATTERN, LOAD_BALANCER, "Ribbon", None, EUREKA),
    (EXACT, ZIPKIN_PROPERTY, ANY_VALUE, CLIENT, TRACING_MONITORING, "Zipkin", None, None),
    # The prefix rule skips the Zipkin property itself, see property_components().
    (PREFIX, TRACING_PREFIX, ANY_VALUE, CLIENT, TRACING_MONITORING, "", None, None),
    (PREFIX, "spring.data.mongodb.", ANY_VALUE, CLIENT, PERSISTENCE, "MongoDB", None, None),
    (PREFIX, CONFIG_SERVER_PREFIXES[0], ANY_VALUE, SERVER, CONFIGURATION, "Spring Cloud Config", None, None),
    (PREFIX, CONFIG_SERVER_PREFIXES[1], ANY_VALUE, SERVER, CONFIGURATION, "Spring Cloud Config", None, None),
    (PREFIX, "security.oauth2.resource.", ANY_VALUE, CLIENT, AUTHORIZATION, "Spring Cloud OAuth2", None, None),
    (EXACT, "security.user.password", ANY_VALUE, PATTERN, WEB_SECURITY, "Spring Security", None, None),
    (PREFIX, "spring.rabbitmq.", ANY_VALUE, CLIENT, BROKER, "RabbitMQ", None, None),
    (EXACT, "ribbon.ReadTimeout", NOT_ZERO, PATTERN, LOAD_BALANCER, "Ribbon", None, None),
    (EXACT, "ribbon.ConnectTimeout", NOT_ZERO, PATTERN, LOAD_BALANCER, "Ribbon", None, None),
    (EXACT, "zuul.ignoredServices", ANY_VALUE, SERVER, API_GATEWAY, "Zuul", None, None),
    (PREFIX, "zuul.routes.", ANY_VALUE, SERVER, API_GATEWAY, "Zuul", None, None),
    (PREFIX, "mysql.client.", ANY_VALUE, CLIENT, PERSISTENCE, "MySQL", None, None),
    (PREFIX, "redis.client.", ANY_VALUE, CLIENT, CACHE, "Redis", None, None),
    (PREFIX, "logging.level", ANY_VALUE, PATTERN, LOGGING, "", None, None),
)

OAUTH_PACKAGE = "org.springframework.security.oauth2.config.annotation.web.configuration"
OAUTH_TYPES = ("EnableAuthorizationServer", "AuthorizationServerConfigurerAdapter")

# --- Fixed values: imported type -> component (type, package, kind, category, technology) ---
IMPORT_COMPONENTS = (
    (OAUTH_TYPES[0], OAUTH_PACKAGE, SERVER, AUTHORIZATION, "Spring Cloud OAuth2"),
    (OAUTH_TYPES[1], OAUTH_PACKAGE, SERVER, AUTHORIZATION, "Spring Cloud OAuth2"),
    ("Logger", "org.slf4j", PATTERN, LOGGING, "Slf4j"),
    ("LoggerFactory", "org.slf4j", PATTERN, LOGGING, "Slf4j"),
)

# --- Fixed values: type annotation -> component (annotation, kind, category, technology) ---
ANNOTATION_COMPONENTS = (
    ("EnableConfigServer", SERVER, CONFIGURATION, "Spring Cloud Config"),
    ("EnableZuulProxy", SERVER, API_GATEWAY, "Zuul"),
    ("EnableEurekaServer", SERVER, REGISTRY, "Eureka"),
    ("EnableEurekaServer", PATTERN, LOAD_BALANCER, "Ribbon"),
    ("EnableDiscoveryClient", CLIENT, REGISTRY, ""),
    ("EnableWebSecurity", PATTERN, WEB_SECURITY, "Spring Security"),
    ("EnableResourceServer", CLIENT, AUTHORIZATION, "Spring Cloud OAuth2"),
    ("EnableAuthorizationServer", SERVER, AUTHORIZATION, "Spring Cloud OAuth2"),
    ("EnableHystrixDashboard", SERVER, BREAKER_MONITORING, "Hystrix"),
    ("EnableTurbineStream", SERVER, BREAKER_AGGREGATION, "Turbine"),
    ("Slf4j", PATTERN, LOGGING, "Slf4j"),
)

# --- Fixed values: invoked method -> component ---
INVOCATION_COMPONENTS = (
    ("authenticate", "AuthenticationManager", "org.springframework.security.authentication",
     SERVER, AUTHORIZATION, "Spring Security"),
)

# --- Fixed values: endpoint groups (verb, path) ---
ACTUATOR_ENDPOINTS = (
    ("GET", "/actuator/env"), ("GET", "/actuator/logfile"), ("GET", "/actuator/health"),
    ("GET", "/actuator/info"), ("GET", "/actuator/metrics"), ("POST", "/actuator/shutdown"),
)
REFRESH_ENDPOINTS = (("POST", "/actuator/refresh"),)
STREAM_ENDPOINTS = (("GET", "/actuator/hystrix.stream"),)
ROUTE_ENDPOINTS = (("GET", "/routes"), ("GET", "/filters"))
CONFIG_ENDPOINTS = (("GET", "/{appID}/{profile}"),)
EUREKA_ENDPOINTS = (
    ("GET", "/eureka/v2/apps/"), ("GET", "/eureka/v2/apps/{appID}"), ("POST", "/eureka/v2/apps/{appID}"),
)
DASHBOARD_ENDPOINTS = (("GET", "/hystrix"),)
TURBINE_ENDPOINTS = (("GET", "/clusters"), ("GET", "/turbine.stream"))
OAUTH_ENDPOINTS = (("GET", "/oauth/token_key"), ("POST", "/oauth/token"), ("POST", "/oauth/authorize"))

# --- Fixed values: library -> endpoints (names, needed flag, endpoints) ---
LIBRARY_ENDPOINTS = (
    (ACTUATOR_LIBRARIES, None, ACTUATOR_ENDPOINTS),
    (ACTUATOR_LIBRARIES, CONFIG_CLIENT, REFRESH_ENDPOINTS),
    (ACTUATOR_LIBRARIES, HYSTRIX, STREAM_ENDPOINTS),
    (ACTUATOR_LIBRARIES, ZUUL, ROUTE_ENDPOINTS),
    (CONFIG_CLIENT_LIBRARIES, ACTUATOR, REFRESH_ENDPOINTS),
    (HYSTRIX_LIBRARIES, ACTUATOR, STREAM_ENDPOINTS),
    (("spring-cloud-config-server",), None, CONFIG_ENDPOINTS),
    (EUREKA_SERVER_LIBRARIES, None, EUREKA_ENDPOINTS),
    (("spring-cloud-starter-hystrix-dashboard",), None, DASHBOARD_ENDPOINTS),
    (("spring-cloud-starter-turbine",), None, TURBINE_ENDPOINTS),
    (ZUUL_LIBRARIES, ACTUATOR, ROUTE_ENDPOINTS),
)

# --- Fixed values: property test -> endpoints (match, text, value test, needed flag, endpoints) ---
PROPERTY_ENDPOINTS = (
    (PREFIX, ACTUATOR_PROPERTY_PREFIX, ANY_VALUE, None, ACTUATOR_ENDPOINTS),
    (PREFIX, ACTUATOR_PROPERTY_PREFIX, ANY_VALUE, CONFIG_CLIENT, REFRESH_ENDPOINTS),
    (PREFIX, ACTUATOR_PROPERTY_PREFIX, ANY_VALUE, HYSTRIX, STREAM_ENDPOINTS),
    (EXACT, CONFIG_URI_PROPERTY, ANY_VALUE, ACTUATOR, REFRESH_ENDPOINTS),
    (EXACT, BREAKER_PROPERTIES[0], NOT_ZERO, ACTUATOR, STREAM_ENDPOINTS),
    (EXACT, BREAKER_PROPERTIES[1], NOT_ZERO, ACTUATOR, STREAM_ENDPOINTS),
    (PREFIX, CONFIG_SERVER_PREFIXES[0], ANY_VALUE, None, CONFIG_ENDPOINTS),
    (PREFIX, CONFIG_SERVER_PREFIXES[1], ANY_VALUE, None, CONFIG_ENDPOINTS),
    (EXACT, "zuul.ignoredServices", ANY_VALUE, ACTUATOR, ROUTE_ENDPOINTS),
    (PREFIX, "zuul.routes.", ANY_VALUE, ACTUATOR, ROUTE_ENDPOINTS),
)

# --- Fixed values: type annotation -> endpoints (annotation, needed flag, endpoints) ---
ANNOTATION_ENDPOINTS = (
    ("EnableConfigServer", None, CONFIG_ENDPOINTS),
    ("EnableEurekaServer", None, EUREKA_ENDPOINTS),
    ("EnableHystrixDashboard", None, DASHBOARD_ENDPOINTS),
    ("EnableZuulProxy", ACTUATOR, ROUTE_ENDPOINTS),
)

# --- Fixed values: which fact sets which flag ---
LIBRARY_FLAGS = (
    (ACTUATOR_LIBRARIES, ACTUATOR),
    (HYSTRIX_LIBRARIES, HYSTRIX),
    (CONFIG_CLIENT_LIBRARIES, CONFIG_CLIENT),
    (EUREKA_SERVER_LIBRARIES, EUREKA),
    (ZUUL_LIBRARIES, ZUUL),
)
PROPERTY_FLAGS = (
    (PREFIX, ACTUATOR_PROPERTY_PREFIX, ANY_VALUE, ACTUATOR),
    (EXACT, BREAKER_PROPERTIES[0], NOT_ZERO, HYSTRIX),
    (EXACT, BREAKER_PROPERTIES[1], NOT_ZERO, HYSTRIX),
    (EXACT, CONFIG_URI_PROPERTY, ANY_VALUE, CONFIG_CLIENT),
    (EXACT, "zuul.ignoredServices", ANY_VALUE, ZUUL),
    (PREFIX, "zuul.routes.", ANY_VALUE, ZUUL),
)
CONTEXT_PATH_PROPERTIES = ("server.contextPath", "server.servlet.context-path")

# --- Fixed values: property -> provider, the host form (value is a host name) ---
HOST_DEPENDENCIES = (
    (EXACT, "spring.data.mongodb.host"),
    (EXACT, "redis.client.host"),
    (PREFIX, "spring.rabbitmq.host"),
    (EXACT, "mysql.client.server"),
)
# --- Fixed values: property -> provider, the URL form
#     (match, text, vetoing flag, destination before, what follows: nothing / service / url path, after) ---
PLAIN, SERVICE_NAME, URL_PATH = "plain", "service", "path"
URL_DEPENDENCIES = (
    (PREFIX, REGISTRY_URL_PREFIX, EUREKA, "Endpoint[RequestURI:POST /eureka/v2/apps/", SERVICE_NAME, "]"),
    (EXACT, CONFIG_URI_PROPERTY, None, "Endpoint[RequestURI:GET /", SERVICE_NAME, "/default]"),
    (EXACT, "spring.data.mongodb.uri", None, "", PLAIN, ""),
    (EXACT, "security.oauth2.resource.user-info-uri", None, "", PLAIN, ""),
    (SUFFIX, ".oauth2.resource.jwt.keyUri", None, "Endpoint[RequestURI:GET /", URL_PATH, "]"),
    (SUFFIX, ".oauth2.client.accessTokenUri", None, "Endpoint[RequestURI:POST /", URL_PATH, "]"),
    (SUFFIX, ".oauth2.client.userAuthorizationUri", None, "Endpoint[RequestURI:POST /", URL_PATH, "]"),
    (EXACT, "management.tracing.exporterEndpoint", None, "", PLAIN, ""),
    (EXACT, ZIPKIN_PROPERTY, None, "Endpoint[RequestURI:POST /api/v2/spans]", PLAIN, ""),
)
OWN_HOSTS = ("localhost", "127.0.0.1")

# --- Fixed values: message body schemas, opaque texts (the second one is not valid JSON; kept as it is) ---
HEALTH_SCHEMA = '{"type":"object","properties":{"status":{"type":"string"},"details":{"type":"object"}}}'
INFO_SCHEMA = '{"type":"object","properties":{"git":{"type":"object","properties":{"branch":{"type":"string"},"commit":{"type":"type":"object","properties":{"time":{"type":"object"},"id":{"type":"string"}}}}},"build":{"type":"object","properties":{"artifact":{"type":"string"},"group":{"type":"string"},"name":{"type":"string"},"version":{"type":"string"},"time":{"type":"object"}}}}}'  # noqa: E501
CATALOG_SCHEMA = '{"type":"object","properties":{"Datacenter":{"type":"string"},"ID":{"type":"string"},"Node":{"type":"string"},"Address":{"type":"string"},"TaggedAddresses":{"type":"object","properties":{"lan":{"type":"string"},"wan":{"type":"string"}}},"NodeMeta":{"type":"object","properties":{"somekey":{"type":"string"}}},"Service":{"type":"object","properties":{"ID":{"type":"string"},"Service":{"type":"string"},"Tags":{"type":"array","items":{"type":"string"}},"Address":{"type":"string"},"TaggedAddresses":{"type":"object","properties":{"lan":{"type":"object","properties":{"address":{"type":"string"},"port":{"type":"integer"}}},"wan":{"type":"object","properties":{"address":{"type":"string"},"port":{"type":"integer"}}}}},"Meta":{"type":"object"},"Port":{"type":"integer"}}},"Check":{"type":"object"},"SkipNodeUpdate":{"type":"boolean"}}}'  # noqa: E501
SPANS_SCHEMA = '{"type":"array","items":{"type":"object","properties":{"id":{"type":"string"},"traceId":{"type":"string"},"parentId":{"type":"string"},"name":{"type":"string"},"timestamp":{"type":"integer"},"duration":{"type":"integer"},"kind":{"type":"string"},"localEndpoint":{"type":"object","properties":{"serviceName":{"type":"string"},"ipv4":{"type":"string"},"port":{"type":"integer"}}},"remoteEndpoint":{"type":"object","properties":{"serviceName":{"type":"string"},"ipv4":{"type":"string"},"port":{"type":"integer"}}},"tags":{"type":"object","properties":{"http.method":{"type":"string"},"http.path":{"type":"string"}}}}}}'  # noqa: E501
SHUTDOWN_SCHEMA = '{"type":"object","properties":{"message":{"type":"string"}}}'
STRING_SCHEMA = '{"type":"string"}'

REQUEST, RESPONSE, INBOUND = "REQUEST", "RESPONSE", "INBOUND"

# --- Fixed values: messages of endpoints born from libraries and properties (verb test, path part, type, schema) ---
MODULE_MESSAGES = (
    ("", "/actuator/health", RESPONSE, HEALTH_SCHEMA),
    ("", "/actuator/info", RESPONSE, INFO_SCHEMA),
    ("", "/actuator/metrics", RESPONSE, CATALOG_SCHEMA),
    ("", "/actuator/shutdown", RESPONSE, SHUTDOWN_SCHEMA),
    ("GET", "/api/v2/spans", RESPONSE, SPANS_SCHEMA),
    ("POST", "/api/v2/spans", REQUEST, SPANS_SCHEMA),
    ("POST", "/api/v2/spans", RESPONSE, STRING_SCHEMA),
)
# --- Fixed values: messages of endpoints born from containers (uri, type, schema) ---
CONTAINER_MESSAGES = (
    ("PUT /catalog/register", REQUEST, CATALOG_SCHEMA),
    ("GET /api/v2/spans", RESPONSE, SPANS_SCHEMA),
    ("POST /api/v2/spans", REQUEST, SPANS_SCHEMA),
    ("POST /api/v2/spans", RESPONSE, STRING_SCHEMA),
)

# --- Fixed values: Maven scope on (existing, new); "-" removes the library ---
SCOPE_TABLE = {
    "COMPILE": {"COMPILE": "COMPILE", "PROVIDED": "-", "RUNTIME": "RUNTIME", "TEST": "-"},
    "PROVIDED": {"COMPILE": "PROVIDED", "PROVIDED": "-", "RUNTIME": "PROVIDED", "TEST": "-"},
    "RUNTIME": {"COMPILE": "RUNTIME", "PROVIDED": "-", "RUNTIME": "RUNTIME", "TEST": "-"},
    "TEST": {"COMPILE": "TEST", "PROVIDED": "-", "RUNTIME": "TEST", "TEST": "-"},
}

REACTIVE_MARKS = ("webflux", "reactive", "reactor")
LANG_TYPES = ("String", "Boolean", "Integer", "Float", "Object")
NOT_AVAILABLE = "NOT_AVAILABLE"
FORBIDDEN_NAME_CHARACTERS = '<>:"/\\|?*'
CONFIG_EXTENSIONS = (".yml", ".yaml", ".properties")


def _numbered(rows):
    return [(number, *row) for number, row in enumerate(rows)]


def library_component_rows():
    return [
        (number, name, scope, kind, category, technology, needs)
        for number, (names, scope, kind, category, technology, needs) in enumerate(LIBRARY_COMPONENTS)
        for name in names
    ]


def property_component_rows():
    return _numbered(PROPERTY_COMPONENTS)


def _numbers(groups):
    """Number of the first endpoint of every group; endpoints are numbered through the whole table."""
    first, numbers = 0, []
    for *_, endpoints in groups:
        numbers.append(first)
        first += len(endpoints)
    return numbers


def library_endpoint_rows():
    return [
        (_numbers(LIBRARY_ENDPOINTS)[group] + at, name, needs, verb, path)
        for group, (names, needs, endpoints) in enumerate(LIBRARY_ENDPOINTS)
        for name in names
        for at, (verb, path) in enumerate(endpoints)
    ]


def property_endpoint_rows():
    return [
        (_numbers(PROPERTY_ENDPOINTS)[group] + at, match, text, value, needs, verb, path)
        for group, (match, text, value, needs, endpoints) in enumerate(PROPERTY_ENDPOINTS)
        for at, (verb, path) in enumerate(endpoints)
    ]


def annotation_endpoint_rows():
    return [
        (_numbers(ANNOTATION_ENDPOINTS)[group] + at, name, needs, verb, path)
        for group, (name, needs, endpoints) in enumerate(ANNOTATION_ENDPOINTS)
        for at, (verb, path) in enumerate(endpoints)
    ]


def table(spark: SparkSession, rows, columns: str) -> DataFrame:
    """A rule table, marked for broadcast: its size is fixed by this module.

    Built from Arrow it is a local relation, so broadcasting it starts no job.
    """
    schema = T.StructType.fromDDL(columns)
    arrays = [pa.array(values, to_arrow_type(field.dataType)) for values, field in zip(zip(*rows), schema)]
    return F.broadcast(spark.createDataFrame(pa.table(arrays, names=schema.names)))

"""Queries over fact tables: services, components, endpoints, messages, dependencies, topology.

The oracle SQL states the same rules in the reading order: running flags are windows, merges are
ordered numbers.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.facts import FACT_SQL
from catalog.registry import ORACLES, query, values
from fleetscope import rules
from fleetscope.functions.runtime import written
from fleetscope.operators import components, dependencies, endpoints, services, topology
from fleetscope.operators import java_endpoints as java
from fleetscope.operators.flags import module_flags, registry_pair
from fleetscope.plans.derive import derive, service_overview
from fleetscope.schema import Facts

CONTAINER_TEXT = (
    "'DockerContainerDefinition[ContainerName:' || name || ',ImageField:' || image || ', GeneratesLogs:' "
    "|| CASE WHEN generates_logs THEN 'true' ELSE 'false' END || ']'"
)
PROPERTY_TEXT = "'ConfigurationProperty[FullyQualifiedPropertyName:' || name || ']'"


def quoted_list(items) -> str:
    return ", ".join(f"'{item}'" for item in items)


def flags_of(f):
    """The flags of all modules, computed once for all rules of a query."""
    if f._flags is None:
        f._flags = written(module_flags(f.library, f.property, f.java_annotation))
    return f._flags


# --- services ---------------------------------------------------------------------------------

INFRA_IMAGE = " OR ".join(f"contains(image, '{part}')" for part in rules.INFRASTRUCTURE_IMAGES)
SERVICE_SQL = f"""
service_part AS (
  SELECT app_id, name AS service, CASE WHEN {INFRA_IMAGE} THEN 1 ELSE 0 END AS infra, 0 AS spring, 0 AS phase
  FROM f_container
  UNION ALL SELECT app_id, artifact_id, 0, CASE WHEN kind = 'Microservice' THEN 0 ELSE 1 END, 1 FROM f_module),
service AS (
  SELECT app_id, service, CASE WHEN max(infra) = 1 THEN 'Infrastructure' ELSE 'Microservice' END AS kind,
    max(spring) AS spring FROM service_part GROUP BY app_id, service)"""


@query(
    "architecture",
    """
SELECT a.app_id, p.project AS name,
  'DistributedApplicationProject[ApplicationName:' || app_name || ']|ApplicationProject[ProjectArtifactId:'
  || artifact_id || ']' AS evidence
FROM f_application a JOIN f_app_project p ON a.app_id = p.app_id""".replace("SELECT a", "x AS (SELECT 1) SELECT a"),
    ("application", "app_project"),
)
def architecture(f):
    merged = services.architecture(f.application, f.app_project)
    texts = merged.evidence.groupBy("app_id").agg(
        F.array_join(F.sort_array(F.collect_list(F.struct("ord", "evidence"))).getField("evidence"), "|").alias(
            "evidence"
        )
    )
    return merged.rows.join(texts, "app_id")


@query(
    "services_from_containers",
    f"""
x AS (SELECT 1) SELECT app_id, name AS service, CASE WHEN {INFRA_IMAGE} THEN 'Infrastructure' ELSE 'Microservice' END
  AS kind, {CONTAINER_TEXT} AS evidence FROM f_container""",
    ("container",),
)
def services_from_containers(f):
    return services.services_from_containers(f.container).select("app_id", "service", "kind", "evidence")


@query(
    "services_from_modules",
    f"{SERVICE_SQL} SELECT app_id, service, kind, spring = 1 AS spring FROM service",
    ("container", "module"),
)
def services_from_modules(f):
    return services.merge_services(f.container, f.module).rows.select("app_id", "service", "kind", "spring")


@query(
    "service_evidence",
    f"""
x AS (SELECT 1) SELECT app_id, name AS service, {CONTAINER_TEXT} AS evidence, 0 AS phase FROM f_container
UNION ALL SELECT app_id, artifact_id, 'MicroserviceProject[ProjectArtifactId:' || artifact_id || ']', 1 FROM f_module""",
    ("container", "module"),
)
def service_evidence(f):
    return services.merge_services(f.container, f.module).evidence.select("app_id", "service", "evidence", "phase")


@query(
    "pim_containers_and_interfaces",
    f"""{SERVICE_SQL} SELECT app_id, service, service AS container_name,
  '[http|https]://' || service || ':<port-number>' AS server_url FROM service""",
    ("container", "module"),
)
def pim_containers_and_interfaces(f):
    rows = services.merge_services(f.container, f.module).rows
    return services.pim_containers(rows).join(services.service_interfaces(rows), ["app_id", "service"])


# --- components -------------------------------------------------------------------------------

C_COLUMNS = "app_id, service, kind, category, technology, environment, evidence"
CONTAINER_COMPONENTS = f"""
container_c AS (
  SELECT app_id, name AS service, 'Server' AS kind, category, technology, CAST(NULL AS VARCHAR) AS environment,
    {CONTAINER_TEXT} AS evidence, 0 AS phase, seq, rule
  FROM f_container JOIN {values(rules.IMAGE_COMPONENTS)} r(rule, part, category, technology) ON contains(image, part)
  UNION ALL
  SELECT app_id, name, 'Pattern', '{rules.METRICS_GENERATION}', 'Logging', NULL, {CONTAINER_TEXT}, 0, seq, 1
  FROM f_container WHERE generates_logs)"""


def sets_flag(flag: str) -> str:
    for flag_names, name in rules.LIBRARY_FLAGS:
        if name == flag:
            return f"library_name IN ({quoted_list(flag_names)})"
    raise KeyError(flag)


def property_sets(flag: str) -> str:
    tests = []
    for match, text, check, name in rules.PROPERTY_FLAGS:
        if name == flag:
            test = f"name = '{text}'" if match == rules.EXACT else f"starts_with(name, '{text}')"
            tests.append(f"({test}{" AND value <> '0'" if check == rules.NOT_ZERO else ''})")
    return " OR ".join(tests)


RUNNING = (rules.ACTUATOR, rules.HYSTRIX, rules.CONFIG_CLIENT, rules.ZUUL)
BEFORE = "PARTITION BY app_id, project ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
FLAGGED = f"""
library_run AS (
  SELECT *, {', '.join(f"coalesce(bool_or({sets_flag(flag)}) OVER w, false) AS has_{flag}" for flag in RUNNING)}
  FROM f_library WINDOW w AS ({BEFORE})),
library_end AS (
  SELECT app_id, project, {', '.join(f"bool_or({sets_flag(flag)}) AS end_{flag}" for flag in (*RUNNING, rules.EUREKA))}
  FROM f_library GROUP BY app_id, project),
pair AS (
  SELECT app_id, project, min(seq) FILTER (WHERE name = '{rules.NO_REGISTER_PROPERTY}') AS seq,
    arg_min(profile, seq) FILTER (WHERE name = '{rules.NO_REGISTER_PROPERTY}') AS profile
  FROM f_property
  WHERE name IN ('{rules.NO_REGISTER_PROPERTY}', '{rules.NO_FETCH_PROPERTY}') AND value = 'false'
  GROUP BY app_id, project HAVING count(DISTINCT name) = 2),
property_run AS (
  SELECT p.*, {', '.join(
      f"coalesce(end_{flag}, false) OR coalesce(bool_or({property_sets(flag)}) OVER w, false) AS has_{flag}"
      for flag in RUNNING
  )},
    coalesce(end_eureka, false) OR pair.app_id IS NOT NULL AS has_eureka
  FROM f_property p LEFT JOIN library_end e ON p.app_id = e.app_id AND p.project = e.project
    LEFT JOIN pair ON p.app_id = pair.app_id AND p.project = pair.project
  WINDOW w AS (PARTITION BY p.app_id, p.project ORDER BY p.seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
module_end AS (
  SELECT app_id, project, {', '.join(f"bool_or({name}) AS has_{flag}" for flag, name in
      [(flag, f"end_{flag}") for flag in RUNNING])}
  FROM (SELECT app_id, project, {', '.join(f'end_{flag}' for flag in RUNNING)} FROM library_end
    UNION ALL SELECT app_id, project, {', '.join(f'coalesce({property_sets(flag)}, false)' for flag in RUNNING)}
    FROM f_property) flags
  GROUP BY app_id, project)""".replace("OVER w, false)", "OVER w, false)")
HAS = " OR ".join(["needs IS NULL", *[f"(needs = '{flag}' AND has_{flag})" for flag in RUNNING]])
PROPERTY_MATCH = (
    "((match = 'exact' AND name = test) OR (match = 'prefix' AND starts_with(name, test))) "
    "AND (value_test = 'any' OR value <> '0')"
)
LIBRARY_COMPONENTS = f"""
library_c AS (
  SELECT app_id, project AS service, kind, category, technology, scope AS environment,
    'DependencyLibrary[LibraryName:' || library_name || ']' AS evidence, 1 AS phase, seq, rule
  FROM library_run JOIN {values(rules.library_component_rows())}
    r(rule, wanted, scope_test, kind, category, technology, needs) ON library_name = wanted
  WHERE (scope_test = 'any' OR (scope_test = 'runtime') = (scope = 'RUNTIME')) AND ({HAS}))"""
PROPERTY_COMPONENTS = f"""
property_c AS (
  SELECT app_id, project AS service, kind, category, technology, profile AS environment,
    {PROPERTY_TEXT} AS evidence, 3 AS phase, seq, rule
  FROM property_run JOIN {values(rules.property_component_rows())}
    r(rule, match, test, value_test, kind, category, technology, needs, unless) ON {PROPERTY_MATCH}
  WHERE ({HAS}) AND (unless IS NULL OR NOT has_eureka)
    AND NOT (test = '{rules.TRACING_PREFIX}' AND name = '{rules.ZIPKIN_PROPERTY}')
  UNION ALL
  SELECT app_id, project, 'Server', '{rules.REGISTRY}', 'Eureka', profile,
    'ConfigurationProperty[FullyQualifiedPropertyName:{rules.NO_REGISTER_PROPERTY}]', 2, seq, 0 FROM pair)"""
IMPORT_COMPONENTS = f"""
import_c AS (
  SELECT app_id, project AS service, r.kind, category, technology, profile AS environment,
    'JavaUserDefinedType[ElementIdentifier:' || target_id || ']' AS evidence, 4 AS phase, seq, 0 AS rule
  FROM f_java_supertype JOIN {values(rules.IMPORT_COMPONENTS)} r(wanted, package, kind, category, technology)
    ON target_id = wanted AND target_package = package WHERE relation = 'imports')"""
ANNOTATION_COMPONENTS = f"""
annotation_c AS (
  SELECT app_id, project AS service, kind, category, technology, profile AS environment,
    'JavaAnnotation[AnnotationName:' || annotation_name || ']' AS evidence, 5 AS phase, seq, rule
  FROM f_java_annotation
    JOIN {values([(number, *row) for number, row in enumerate(rules.ANNOTATION_COMPONENTS)])}
    r(rule, wanted, kind, category, technology) ON annotation_name = wanted WHERE owner_kind = 'type')"""
INVOCATION_COMPONENTS = f"""
invocation_c AS (
  SELECT app_id, project AS service, 'Server' AS kind, '{rules.AUTHORIZATION}' AS category,
    'Spring Security' AS technology, profile AS environment, 'JavaMethod[ElementIdentifier:authenticate()]' AS evidence,
    6 AS phase, seq, 0 AS rule
  FROM f_java_invocation WHERE callee = 'authenticate' AND receiver_type = 'AuthenticationManager'
    AND receiver_package = 'org.springframework.security.authentication')"""


def listed(table: str) -> str:
    """Contributions with how often each occurs, so that order inside the table does not matter."""
    return f"SELECT {C_COLUMNS}, count(*) AS hits FROM {table} GROUP BY ALL"


def contribution_counts(df):
    return df.groupBy(*[column for column in components.COLUMNS if column != "ord"]).agg(F.count("*").alias("hits"))


@query("components_from_containers", f"{CONTAINER_COMPONENTS} {listed('container_c')}", ("container",))
def components_from_containers(f):
    return contribution_counts(components.from_containers(f.container))


FLAG_FACTS = ("library", "property")


@query("components_from_libraries", f"{FLAGGED}, {LIBRARY_COMPONENTS} {listed('library_c')}", FLAG_FACTS)
def components_from_libraries(f):
    return contribution_counts(components.from_libraries(f.library, flags_of(f)))


@query("components_from_properties", f"{FLAGGED}, {PROPERTY_COMPONENTS} {listed('property_c')}", FLAG_FACTS)
def components_from_properties(f):
    return contribution_counts(components.from_properties(f.property, flags_of(f)))


@query("components_from_imports", f"{IMPORT_COMPONENTS} {listed('import_c')}", ("java_supertype",))
def components_from_imports(f):
    return contribution_counts(components.from_imports(f.java_supertype))


@query("components_from_annotations", f"{ANNOTATION_COMPONENTS} {listed('annotation_c')}", ("java_annotation",))
def components_from_annotations(f):
    return contribution_counts(components.from_annotations(f.java_annotation))


@query("components_from_invocations", f"{INVOCATION_COMPONENTS} {listed('invocation_c')}", ("java_invocation",))
def components_from_invocations(f):
    return contribution_counts(components.from_invocations(f.java_invocation))


COMPONENT_FACTS = ("container", "library", "property", "java_supertype", "java_annotation", "java_invocation")
ALL_COMPONENTS = f"""{FLAGGED}, {CONTAINER_COMPONENTS}, {LIBRARY_COMPONENTS}, {PROPERTY_COMPONENTS},
{IMPORT_COMPONENTS}, {ANNOTATION_COMPONENTS}, {INVOCATION_COMPONENTS},
every_c AS (
  SELECT *, row_number() OVER (PARTITION BY app_id, service, kind, category ORDER BY phase, seq, rule) AS n FROM (
    SELECT * FROM container_c UNION ALL SELECT * FROM library_c UNION ALL SELECT * FROM property_c
    UNION ALL SELECT * FROM import_c UNION ALL SELECT * FROM annotation_c UNION ALL SELECT * FROM invocation_c) c),
settled_c AS (
  SELECT *, CASE WHEN technology <> '' THEN technology
    ELSE arg_min(technology, n) FILTER (WHERE technology <> '') OVER (PARTITION BY app_id, service, kind, category)
    END AS resolved FROM every_c),
component AS (
  SELECT app_id, service, kind, category, resolved AS technology, arg_min(coalesce(environment, '-'), n) AS environment
  FROM settled_c GROUP BY app_id, service, kind, category, resolved)"""


@query("merge_components", f"{ALL_COMPONENTS} SELECT * FROM component", COMPONENT_FACTS)
def merge_components(f):
    merged = components.merge_components(components.contributions(f, flags_of(f))).rows
    return merged.select(
        *components.ELEMENT, "technology", F.coalesce("environment", F.lit("-")).alias("environment")
    )


@query(
    "component_evidence",
    f"""{ALL_COMPONENTS},
link AS (
  SELECT app_id, service, kind, category, resolved AS technology, evidence, min(n) AS n
  FROM settled_c GROUP BY app_id, service, kind, category, resolved, evidence)
SELECT app_id, service, kind, category, technology, evidence,
  row_number() OVER (PARTITION BY app_id, service, kind, category, technology ORDER BY n) AS position FROM link""",
    COMPONENT_FACTS,
)
def component_evidence(f):
    from pyspark.sql import Window

    merged = components.merge_components(components.contributions(f, flags_of(f))).evidence
    order = Window.partitionBy(*components.ELEMENT, "technology").orderBy("ord")
    return merged.withColumn("position", F.row_number().over(order)).drop("ord")


@query(
    "module_flags",
    f"""{FLAGGED}, every_module AS (
  SELECT app_id, project FROM f_library UNION SELECT app_id, project FROM f_property)
SELECT m.app_id, m.project, coalesce(has_actuator, false) AS actuator, coalesce(has_hystrix, false) AS hystrix,
  coalesce(has_config_client, false) AS config_client, coalesce(has_zuul, false) AS zuul,
  coalesce(end_eureka, false) OR pair.seq IS NOT NULL AS eureka
FROM every_module m LEFT JOIN module_end e ON m.app_id = e.app_id AND m.project = e.project
  LEFT JOIN library_end l ON m.app_id = l.app_id AND m.project = l.project
  LEFT JOIN pair ON m.app_id = pair.app_id AND m.project = pair.project""",
    FLAG_FACTS,
)
def flags(f):
    every = f.library.select("app_id", "project").union(f.property.select("app_id", "project")).distinct()
    names = (*RUNNING, rules.EUREKA)
    return every.join(flags_of(f), ["app_id", "project"], "left").select(
        "app_id", "project", *[F.col(f"first_{name}").isNotNull().alias(name) for name in names]
    )


@query("registry_pair", f"{FLAGGED} SELECT app_id, project, seq, profile FROM pair", FLAG_FACTS)
def registry_pairs(f):
    return registry_pair(f.property).drop("name")


TYPED_ONLY = f"""{SERVICE_SQL},
typed AS (
  SELECT s.app_id, s.service, CASE WHEN s.kind <> 'Microservice' OR spring = 0 THEN s.kind
    WHEN EXISTS (SELECT 1 FROM component c WHERE c.app_id = s.app_id AND c.service = s.service AND c.kind = 'Server')
    THEN 'Infrastructure' ELSE 'Functional' END AS kind
  FROM service s)"""
TYPED = f"{ALL_COMPONENTS}, {TYPED_ONLY}"


@query("classify_services", f"{TYPED} SELECT * FROM typed", (*COMPONENT_FACTS, "module"))
def classify_services(f):
    merged = components.merge_components(components.contributions(f, flags_of(f))).rows
    rows = services.merge_services(f.container, f.module).rows
    return services.classify_services(rows, merged).select("app_id", "service", "kind")


# --- endpoints --------------------------------------------------------------------------------

PREFIX = f"""
prefix AS (
  SELECT app_id, project, arg_min(value, seq) AS prefix FROM f_property
  WHERE name IN ({quoted_list(rules.CONTEXT_PATH_PROPERTIES)}) GROUP BY app_id, project)"""


@query("endpoint_prefix", f"{PREFIX} SELECT * FROM prefix", ("property",))
def endpoint_prefix(f):
    return endpoints.endpoint_prefixes(f.property)


E_COLUMNS = "app_id, service, uri, environment, overwrites, evidence"


def prefixed(table: str) -> str:
    return f"""{table} AS (
  SELECT r.app_id, r.project AS service, verb || ' ' || coalesce(prefix, '') || path AS uri, environment, overwrites,
    evidence, phase, seq, rule
  FROM {table}_raw r LEFT JOIN prefix p ON r.app_id = p.app_id AND r.project = p.project)"""


CONTAINER_ENDPOINTS = f"""
container_e AS (
  SELECT app_id, name AS service, verb || ' ' || path AS uri, CAST(NULL AS VARCHAR) AS environment,
    false AS overwrites, {CONTAINER_TEXT} AS evidence, 0 AS phase, seq, rule
  FROM f_container JOIN {values(rules.IMAGE_ENDPOINTS)} r(rule, part, verb, path) ON contains(image, part))"""
LIBRARY_ENDPOINTS = f"""
library_e_raw AS (
  SELECT app_id, project, verb, path, scope AS environment, true AS overwrites,
    'DependencyLibrary[LibraryName:' || library_name || ']' AS evidence, 1 AS phase, seq, rule
  FROM library_run JOIN {values(rules.library_endpoint_rows())} r(rule, wanted, needs, verb, path)
    ON library_name = wanted WHERE {HAS}),
{prefixed('library_e')}"""
PROPERTY_ENDPOINTS = f"""
property_e_raw AS (
  SELECT app_id, project, verb, path, profile AS environment, true AS overwrites, {PROPERTY_TEXT} AS evidence,
    3 AS phase, seq, rule
  FROM property_run JOIN {values(rules.property_endpoint_rows())} r(rule, match, test, value_test, needs, verb, path)
    ON {PROPERTY_MATCH} WHERE {HAS}
  UNION ALL
  SELECT app_id, project, verb, path, profile, true,
    'ConfigurationProperty[FullyQualifiedPropertyName:{rules.NO_REGISTER_PROPERTY}]', 2, seq, rule
  FROM pair JOIN {values([(number, *row) for number, row in enumerate(rules.EUREKA_ENDPOINTS)])}
    r(rule, verb, path) ON true),
{prefixed('property_e')}"""
IMPORT_ENDPOINTS = f"""
import_e_raw AS (
  SELECT app_id, project, verb, path, profile AS environment, false AS overwrites,
    'JavaUserDefinedType[ElementIdentifier:' || target_id || ']' AS evidence, 4 AS phase, seq, rule
  FROM f_java_supertype JOIN {values([(number, *row) for number, row in enumerate(rules.OAUTH_ENDPOINTS)])}
    r(rule, verb, path) ON relation = 'imports' AND target_id IN ({quoted_list(rules.OAUTH_TYPES)})
    AND target_package = '{rules.OAUTH_PACKAGE}'),
{prefixed('import_e')}"""
ANNOTATION_ENDPOINTS = f"""
annotation_e_raw AS (
  SELECT a.app_id, a.project, verb, path, profile AS environment, false AS overwrites,
    'JavaAnnotation[AnnotationName:' || annotation_name || ']' AS evidence, 5 AS phase, seq, rule
  FROM f_java_annotation a LEFT JOIN module_end m ON a.app_id = m.app_id AND a.project = m.project
  JOIN {values(rules.annotation_endpoint_rows())} r(rule, wanted, needs, verb, path) ON annotation_name = wanted
  WHERE owner_kind = 'type' AND (needs IS NULL OR coalesce(has_actuator, false))),
{prefixed('annotation_e')}"""


def listed_endpoints(table: str) -> str:
    return f"SELECT {E_COLUMNS} FROM {table} GROUP BY ALL"


def endpoint_set(df):
    return df.select(*[column for column in endpoints.COLUMNS if column != "ord"]).distinct()


@query("endpoints_from_containers", f"{CONTAINER_ENDPOINTS} {listed_endpoints('container_e')}", ("container",))
def endpoints_from_containers(f):
    return endpoint_set(endpoints.from_containers(f.container))


@query(
    "endpoints_from_libraries",
    f"{FLAGGED}, {PREFIX}, {LIBRARY_ENDPOINTS} {listed_endpoints('library_e')}",
    FLAG_FACTS,
)
def endpoints_from_libraries(f):
    raw = endpoints.from_libraries(f.library, flags_of(f))
    return endpoint_set(endpoints.with_prefix(raw, endpoints.endpoint_prefixes(f.property)))


@query(
    "endpoints_from_properties",
    f"{FLAGGED}, {PREFIX}, {PROPERTY_ENDPOINTS} {listed_endpoints('property_e')}",
    FLAG_FACTS,
)
def endpoints_from_properties(f):
    raw = endpoints.from_properties(f.property, flags_of(f))
    return endpoint_set(endpoints.with_prefix(raw, endpoints.endpoint_prefixes(f.property)))


@query(
    "endpoints_from_imports",
    f"{PREFIX}, {IMPORT_ENDPOINTS} {listed_endpoints('import_e')}",
    ("property", "java_supertype"),
)
def endpoints_from_imports(f):
    raw = endpoints.from_imports(f.java_supertype)
    return endpoint_set(endpoints.with_prefix(raw, endpoints.endpoint_prefixes(f.property)))


@query(
    "endpoints_from_annotations",
    f"{FLAGGED}, {PREFIX}, {ANNOTATION_ENDPOINTS} {listed_endpoints('annotation_e')}",
    (*FLAG_FACTS, "java_annotation"),
)
def endpoints_from_annotations(f):
    raw = endpoints.from_annotations(f.java_annotation, flags_of(f))
    return endpoint_set(endpoints.with_prefix(raw, endpoints.endpoint_prefixes(f.property)))


JAVA_FACTS = ("property", "java_type", "java_annotation", "annotation_param", "java_method", "method_param")
IN_QUOTES = "split_part(split_part({0}, '\"', 2), '\"', 1)"


def in_quotes(value: str) -> str:
    return f"CASE WHEN length({value}) - length(replace({value}, '\"', '')) >= 2 THEN split_part({value}, '\"', 2) ELSE '' END"


MAPPED = f"""
first_mapping AS (
  SELECT app_id, owner_key AS method_key, arg_min(annotation_key, seq) AS annotation_key,
    arg_min(annotation_name, seq) AS mapping
  FROM f_java_annotation WHERE owner_kind = 'method' AND annotation_name LIKE '%Mapping' GROUP BY ALL),
mapping_param AS (
  SELECT app_id, annotation_key, arg_max(param_value, seq) FILTER (WHERE param_name = 'method') AS verb_param,
    arg_max(param_value, seq) FILTER (WHERE param_name IN ('value', 'path', 'NOT_AVAILABLE')) AS path_param
  FROM f_annotation_param GROUP BY ALL),
mapped AS (
  SELECT m.*, CASE WHEN verb_param IS NOT NULL THEN replace(verb_param, 'RequestMethod.', '')
      WHEN mapping = 'RequestMapping' THEN 'GET' ELSE replace(mapping, 'Mapping', '') END AS verb,
    CASE WHEN path_param IS NULL THEN '' ELSE {in_quotes('path_param')} END AS path
  FROM f_java_method m JOIN first_mapping f ON m.app_id = f.app_id AND m.method_key = f.method_key
    LEFT JOIN mapping_param p ON f.app_id = p.app_id AND f.annotation_key = p.annotation_key),
type_note AS (
  SELECT a.app_id, owner_key AS type_key, annotation_name, param_name, param_value
  FROM f_java_annotation a LEFT JOIN f_annotation_param p
    ON a.app_id = p.app_id AND a.annotation_key = p.annotation_key WHERE owner_kind = 'type')"""
CONTROLLERS = f"""
controller AS (
  SELECT m.app_id, m.project, m.method_key, m.method_name, m.return_type, m.profile, m.seq, upper(verb) || ' ' ||
    CASE WHEN t.type_key IS NULL THEN '' ELSE coalesce(prefix, '') || {in_quotes('t.param_value')} END || path AS uri
  FROM mapped m LEFT JOIN (
      SELECT * FROM type_note WHERE annotation_name = 'RequestMapping' AND param_name IN ('value', 'NOT_AVAILABLE')) t
      ON m.app_id = t.app_id AND m.type_key = t.type_key
    LEFT JOIN prefix p ON m.app_id = p.app_id AND m.project = p.project
  WHERE verb <> '' AND EXISTS (SELECT 1 FROM type_note c WHERE c.app_id = m.app_id AND c.type_key = m.type_key
    AND c.annotation_name LIKE '%Controller'))"""
REPOSITORIES = f"""
repository AS (
  SELECT t.app_id, t.project, t.type_key, t.seq, t.profile,
    coalesce(prefix, '') || '/' || {in_quotes('n.param_value')} AS collection
  FROM f_java_type t JOIN type_note n ON t.app_id = n.app_id AND t.type_key = n.type_key
    AND n.annotation_name = 'RepositoryRestResource' AND n.param_name = 'path'
    LEFT JOIN prefix p ON t.app_id = p.app_id AND t.project = p.project),
named_param AS (
  SELECT p.app_id, p.method_key, string_agg(param_name, ',' ORDER BY param_order) AS names
  FROM f_method_param p WHERE EXISTS (SELECT 1 FROM f_java_annotation a WHERE a.app_id = p.app_id
    AND a.owner_kind = 'parameter' AND a.owner_key = p.param_key AND a.annotation_name = 'Param')
  GROUP BY p.app_id, p.method_key),
search AS (
  SELECT m.app_id, m.project, m.method_key, m.method_name, m.return_type, m.profile, m.seq,
    'GET ' || collection || '/search/' || method_name || coalesce('{{?' || names || '}}', '') AS uri
  FROM f_java_method m JOIN repository r ON m.app_id = r.app_id AND m.type_key = r.type_key
    LEFT JOIN named_param n ON m.app_id = n.app_id AND m.method_key = n.method_key
  WHERE method_name LIKE 'find%')"""


def repositories_of(f, prefixes):
    return java.repository_types(f.java_type, f.java_annotation, f.annotation_param, prefixes)


@query(
    "repository_rest_endpoints",
    f"""{PREFIX}, {MAPPED}, {REPOSITORIES}
SELECT app_id, project, 'GET ' || collection AS uri, type_key AS element FROM repository
UNION ALL SELECT app_id, project, uri, method_key FROM search""",
    JAVA_FACTS,
)
def repository_rest_endpoints(f):
    f.share_lines()
    repositories = repositories_of(f, endpoints.endpoint_prefixes(f.property))
    searches = java.repository_searches(repositories, f.java_method, f.method_param, f.java_annotation)
    collections = repositories.select(
        "app_id", "project", F.concat(F.lit("GET "), "collection").alias("uri"), F.col("type_key").alias("element")
    )
    return collections.unionByName(
        searches.select("app_id", "project", "uri", F.col("method_key").alias("element"))
    )


@query(
    "controller_endpoints",
    f"{PREFIX}, {MAPPED}, {CONTROLLERS} SELECT app_id, project, method_key, uri FROM controller",
    ("property", "java_annotation", "annotation_param", "java_method"),
)
def controller_endpoints(f):
    return java.controller_endpoints(
        f.java_method, f.java_annotation, f.annotation_param, endpoints.endpoint_prefixes(f.property)
    ).select("app_id", "project", "method_key", "uri")


LISTENERS = f"""
listener AS (
  SELECT m.app_id, m.project, m.method_key, m.method_name, m.profile, m.seq,
    CASE WHEN contains(param_value, '"') THEN {in_quotes('param_value')} ELSE param_value END AS queue,
    CASE WHEN contains(param_value, '"') THEN method_name || '()' ELSE '' END AS operation_name
  FROM f_java_method m JOIN f_java_annotation a ON m.app_id = a.app_id AND a.owner_kind = 'method'
    AND m.method_key = a.owner_key AND annotation_name = 'RabbitListener'
  JOIN f_annotation_param p ON a.app_id = p.app_id AND a.annotation_key = p.annotation_key AND param_name = 'queues')"""
LISTENER_FACTS = ("java_annotation", "annotation_param", "java_method")


def listeners_of(f):
    return java.queue_listeners(f.java_method, f.java_annotation, f.annotation_param)


@query(
    "queue_listeners",
    f"{LISTENERS} SELECT app_id, project, method_key, queue, operation_name FROM listener WHERE queue <> ''",
    LISTENER_FACTS,
)
def queue_listeners(f):
    return listeners_of(f).select("app_id", "project", "method_key", "queue", "operation_name")


@query(
    "merge_queue_listeners",
    f"""{LISTENERS}
SELECT app_id, project AS service, queue, operation_name, arg_min(profile, seq) AS environment,
  count(DISTINCT method_name) AS evidence_count
FROM listener WHERE queue <> '' GROUP BY app_id, project, queue, operation_name""",
    LISTENER_FACTS,
)
def merge_queue_listeners(f):
    merged = endpoints.merge_listeners(listeners_of(f))
    key = ["app_id", "service", "queue", "operation_name"]
    counts = merged.evidence.groupBy(*key).agg(F.count("*").alias("evidence_count"))
    return merged.rows.drop("ord").join(counts, key)


ENDPOINT_FACTS = ("container", "library", "java_supertype", *JAVA_FACTS)
ALL_ENDPOINTS = f"""{FLAGGED}, {PREFIX}, {CONTAINER_ENDPOINTS}, {LIBRARY_ENDPOINTS}, {PROPERTY_ENDPOINTS},
{IMPORT_ENDPOINTS}, {ANNOTATION_ENDPOINTS}, {MAPPED}, {CONTROLLERS}, {REPOSITORIES},
method_e AS (
  SELECT *, 4 AS phase, 9 AS rule FROM search UNION ALL SELECT *, 6, 0 FROM controller),
every_e AS (
  SELECT *, row_number() OVER (PARTITION BY app_id, service, uri ORDER BY phase, seq, rule) AS n FROM (
    SELECT * FROM container_e UNION ALL SELECT * FROM library_e UNION ALL SELECT * FROM property_e
    UNION ALL SELECT * FROM import_e UNION ALL SELECT * FROM annotation_e
    UNION ALL SELECT app_id, project, 'GET ' || collection, profile, false,
      'JavaAnnotation[AnnotationName:RepositoryRestResource]', 4, seq, 8 FROM repository
    UNION ALL SELECT app_id, project, uri, profile, false, 'JavaMethod[ElementIdentifier:' || method_name || '()]',
      phase, seq, rule FROM method_e) e),
endpoint AS (
  SELECT app_id, service, uri, CASE WHEN bool_or(overwrites) THEN arg_max(environment, n) FILTER (WHERE overwrites)
    ELSE CASE WHEN arg_min(coalesce(environment, '-'), n) = '-' THEN NULL ELSE arg_min(environment, n) END END AS environment
  FROM every_e GROUP BY app_id, service, uri)"""


def endpoint_parts(f):
    prefixes = endpoints.endpoint_prefixes(f.property)
    module_flag = flags_of(f)
    repositories = repositories_of(f, prefixes)
    methods = endpoints.method_born(f, prefixes, repositories)
    of_modules = endpoints.module_born(f, module_flag, prefixes)
    return of_modules, methods, endpoints.merge_endpoints(
        endpoints.all_contributions(
            endpoints.from_containers(f.container),
            of_modules,
            endpoints.type_born(f, module_flag, prefixes),
            repositories,
            methods,
        )
    )


@query("merge_endpoints", f"{ALL_ENDPOINTS} SELECT * FROM endpoint", ENDPOINT_FACTS)
def merge_endpoints(f):
    return endpoint_parts(f)[2].rows.drop("ord")


@query(
    "endpoint_evidence",
    f"{ALL_ENDPOINTS} SELECT app_id, service, uri, evidence FROM every_e GROUP BY ALL",
    ENDPOINT_FACTS,
)
def endpoint_evidence(f):
    return endpoint_parts(f)[2].evidence.drop("ord")


# --- messages and operations ------------------------------------------------------------------

MODULE_MESSAGES = f"""
module_m AS (
  SELECT app_id, service, uri AS destination, message_type, body_schema, evidence
  FROM (SELECT * FROM library_e UNION ALL SELECT * FROM property_e) e
    JOIN {values(rules.MODULE_MESSAGES)} r(verb_part, path_part, message_type, body_schema)
    ON contains(uri, path_part) AND contains(uri, verb_part)
  UNION ALL
  SELECT app_id, service, e.uri, message_type, body_schema, evidence
  FROM container_e e JOIN {values(rules.CONTAINER_MESSAGES)} r(uri, message_type, body_schema) ON e.uri = r.uri)"""


@query(
    "endpoint_messages",
    f"""{FLAGGED}, {PREFIX}, {CONTAINER_ENDPOINTS}, {LIBRARY_ENDPOINTS}, {PROPERTY_ENDPOINTS}, {MODULE_MESSAGES}
SELECT app_id, service, destination, message_type, body_schema, evidence FROM module_m GROUP BY ALL""",
    ("container", *FLAG_FACTS),
)
def endpoint_messages(f):
    module = endpoints.module_born(f, flags_of(f), endpoints.endpoint_prefixes(f.property))
    found = endpoints.module_messages(module).unionByName(
        endpoints.container_messages(endpoints.from_containers(f.container))
    )
    return endpoints.merge_messages(found).evidence.drop("ord", "schema_format")


BODIES = """
body AS (
  SELECT p.app_id, p.method_key, arg_min(type_name, param_order) AS body_type,
    arg_min(json_schema, param_order) AS body_schema
  FROM f_method_param p JOIN f_java_annotation a ON p.app_id = a.app_id AND a.owner_kind = 'parameter'
    AND a.owner_key = p.param_key AND annotation_name = 'RequestBody' GROUP BY p.app_id, p.method_key),
first_param AS (
  SELECT app_id, method_key, type_name AS body_type, json_schema AS body_schema FROM f_method_param
  WHERE param_order = 1)"""
METHOD_MESSAGES = """
method_m AS (
  SELECT e.app_id, project AS service, uri AS destination, 'REQUEST' AS message_type, body_schema, method_name
  FROM method_e e JOIN body b ON e.app_id = b.app_id AND e.method_key = b.method_key
  UNION ALL SELECT app_id, project, uri, 'RESPONSE', '', method_name FROM method_e WHERE return_type IS NOT NULL
  UNION ALL
  SELECT l.app_id, project, queue, 'INBOUND', body_schema, method_name
  FROM listener l JOIN first_param p ON l.app_id = p.app_id AND l.method_key = p.method_key WHERE queue <> '')"""
METHOD_ONLY = f"""{PREFIX}, {MAPPED}, {CONTROLLERS}, {REPOSITORIES}, {LISTENERS}, {BODIES},
method_e AS (SELECT * FROM search UNION ALL SELECT * FROM controller)"""


def method_found(f):
    prefixes = endpoints.endpoint_prefixes(f.property)
    methods = endpoints.method_born(f, prefixes, repositories_of(f, prefixes))
    return methods, java.body_params(f.method_param, f.java_annotation), java.first_params(f.method_param)


@query(
    "method_messages",
    f"""{METHOD_ONLY}, {METHOD_MESSAGES}
SELECT *, count(*) AS hits FROM method_m GROUP BY ALL""",
    JAVA_FACTS,
)
def method_messages(f):
    methods, bodies, firsts = method_found(f)
    found = java.method_messages(methods, bodies).unionByName(java.listener_messages(listeners_of(f), firsts))
    return (
        found.withColumn("method_name", F.regexp_extract("evidence", r":(.*)\(\)", 1))
        .groupBy("app_id", "service", "destination", "message_type", "body_schema", "method_name")
        .agg(F.count("*").alias("hits"))
    )


@query(
    "merge_messages",
    f"""{METHOD_ONLY}, {METHOD_MESSAGES}
SELECT app_id, service, destination, message_type, body_schema, 'JSON' AS schema_format,
  count(DISTINCT method_name) AS evidence_count
FROM method_m GROUP BY ALL""",
    JAVA_FACTS,
)
def merge_messages(f):
    methods, bodies, firsts = method_found(f)
    found = java.method_messages(methods, bodies).unionByName(java.listener_messages(listeners_of(f), firsts))
    merged = endpoints.merge_messages(found)
    counts = merged.evidence.groupBy(*endpoints.MESSAGE).agg(F.count("*").alias("evidence_count"))
    return merged.rows.drop("ord").join(counts, endpoints.MESSAGE)


OPERATIONS = """
status AS (
  SELECT a.app_id, owner_key AS method_key, arg_min(param_value, p.seq) AS status
  FROM f_java_annotation a JOIN f_annotation_param p ON a.app_id = p.app_id AND a.annotation_key = p.annotation_key
  WHERE owner_kind = 'method' AND annotation_name = 'ResponseStatus' AND param_name = 'value' GROUP BY ALL),
operation_part AS (
  SELECT e.app_id, e.project AS service, e.uri AS destination, e.method_name, e.method_key,
    ' requests object ' || body_type AS request,
    CASE WHEN return_type IS NOT NULL THEN ' responds with object ' || return_type
      ELSE ' responds with ' || status END AS response
  FROM method_e e LEFT JOIN body b ON e.app_id = b.app_id AND e.method_key = b.method_key
    LEFT JOIN status s ON e.app_id = s.app_id AND e.method_key = s.method_key),
operation_c AS (
  SELECT app_id, service, destination, method_name, method_key, 'An operation with name ' || method_name || '()' ||
    CASE WHEN request IS NOT NULL AND response IS NOT NULL THEN ' that' || request || ' and' || response
      WHEN request IS NOT NULL THEN ' that' || request
      WHEN response IS NOT NULL THEN ' that' || response ELSE '' END AS description
  FROM operation_part
  UNION ALL
  SELECT l.app_id, project, queue, method_name, l.method_key, 'An operation with name ' || method_name || '()' ||
    coalesce(' that reads object ' || body_type, '')
  FROM listener l LEFT JOIN first_param p ON l.app_id = p.app_id AND l.method_key = p.method_key WHERE queue <> '')"""


def operations_of(f):
    f.share_lines()
    methods, bodies, firsts = method_found(f)
    statuses = java.response_statuses(f.java_annotation, f.annotation_param)
    return java.endpoint_operations(methods, bodies, statuses).unionByName(
        java.listener_operations(listeners_of(f), firsts)
    )


@query(
    "operations",
    f"""{METHOD_ONLY}, {OPERATIONS}
SELECT app_id, service, destination, method_name || '()' AS name, description, count(*) AS hits
FROM operation_c GROUP BY ALL""",
    JAVA_FACTS,
)
def operations(f):
    return operations_of(f).groupBy("app_id", "service", "destination", "name", "description").agg(
        F.count("*").alias("hits")
    )


@query(
    "merge_operations",
    f"""{METHOD_ONLY}, {OPERATIONS}
SELECT app_id, service, method_name || '()' AS name, description, 1 AS evidence_count
FROM operation_c GROUP BY app_id, service, method_name, description""",
    JAVA_FACTS,
)
def merge_operations(f):
    merged = endpoints.merge_operations(operations_of(f))
    key = ["app_id", "service", "name", "description"]
    counts = merged.evidence.groupBy(*key).agg(F.count("*").cast("int").alias("evidence_count"))
    return merged.rows.select(*key).join(counts, key)


# --- dependencies -----------------------------------------------------------------------------

LINK_DEPENDENCIES = f"""
link_d AS (
  SELECT l.app_id, container AS service, target AS provider, CAST(NULL AS VARCHAR) AS destination,
    CAST(NULL AS VARCHAR) AS operation, CAST(NULL AS VARCHAR) AS environment, false AS overwrites, false AS from_method,
    CASE side WHEN 0 THEN {CONTAINER_TEXT} ELSE 'DockerContainerLink[LinksDependsOnField:' || target || ']' END
      AS evidence, 0 AS phase, l.dep_order AS seq, side AS rule
  FROM f_container_link l JOIN f_container c ON l.app_id = c.app_id AND container = name
    JOIN (VALUES (0), (1)) two(side) ON true)"""
_HOST_TEST = " OR ".join(
    f"name = '{text}'" if match == rules.EXACT else f"starts_with(name, '{text}')"
    for match, text in rules.HOST_DEPENDENCIES
)
PROPERTY_DEPENDENCIES = f"""
registry_module AS (
  SELECT app_id, project FROM library_end WHERE end_eureka UNION SELECT app_id, project FROM pair
  UNION SELECT app_id, project FROM f_java_annotation
    WHERE owner_kind = 'type' AND annotation_name = 'EnableEurekaServer'),
url_raw AS (
  SELECT p.*, unless, head, middle, tail, CASE WHEN contains(value, '://')
    THEN substr(value, strpos(value, '://') + 3) ELSE '' END AS behind
  FROM f_property p JOIN {values(rules.URL_DEPENDENCIES)} r(match, test, unless, head, middle, tail)
    ON (match = 'exact' AND name = test) OR (match = 'prefix' AND starts_with(name, test))
      OR (match = 'suffix' AND ends_with(name, test))),
url_host AS (
  SELECT *, CASE WHEN contains(split_part(behind, ':', 1), '}}') THEN split_part(split_part(behind, ':', 1), '}}', 1)
    ELSE split_part(split_part(behind, ':', 1), '/', 1) END AS provider FROM url_raw),
url_d AS (
  SELECT *, CASE WHEN contains(value, provider) AND
      contains(substr(value, strpos(value, provider) + length(provider)), '/')
    THEN substr(substr(value, strpos(value, provider) + length(provider)),
      strpos(substr(value, strpos(value, provider) + length(provider)), '/') + 1) ELSE '' END AS url_path
  FROM url_host u WHERE provider NOT IN ('', 'localhost', '127.0.0.1') AND (unless IS NULL OR NOT EXISTS (
    SELECT 1 FROM registry_module m WHERE m.app_id = u.app_id AND m.project = u.project))),
property_d AS (
  SELECT app_id, project AS service, lower(value) AS provider, '' AS destination, CAST(NULL AS VARCHAR) AS operation,
    profile AS environment, true AS overwrites, false AS from_method, {PROPERTY_TEXT} AS evidence, 3 AS phase, seq,
    0 AS rule
  FROM f_property WHERE ({_HOST_TEST}) AND lower(value) NOT IN ('localhost', '127.0.0.1')
  UNION ALL
  SELECT app_id, project, provider,
    head || CASE middle WHEN 'service' THEN project WHEN 'path' THEN url_path ELSE '' END || tail,
    NULL, profile, true, false, {PROPERTY_TEXT}, 3, seq, 0 FROM url_d)"""
FEIGN_DEPENDENCIES = f"""
feign_d AS (
  SELECT m.app_id, m.project AS service, {in_quotes('t.param_value')} AS provider,
    'Endpoint[RequestURI:' || upper(verb) || ' ' || path || ']' AS destination, method_name || '()' AS operation,
    profile AS environment, false AS overwrites, true AS from_method,
    'JavaMethod[ElementIdentifier:' || method_name || '()]' AS evidence, 6 AS phase, m.seq, 0 AS rule
  FROM mapped m JOIN type_note t ON m.app_id = t.app_id AND m.type_key = t.type_key
    AND annotation_name = 'FeignClient' AND param_name = 'name')"""
REST_DEPENDENCIES = """
call_arg AS (
  SELECT app_id, invocation_key, max(CASE WHEN arg_order = 1 THEN arg_value END) AS url,
    max(CASE WHEN arg_order = 2 THEN arg_name END) AS verb_name, count(*) AS arg_count,
    max(CASE WHEN arg_order = 2 AND arg_value <> 'NOT_AVAILABLE' THEN arg_value END) AS key_text
  FROM f_invocation_arg GROUP BY app_id, invocation_key),
rest_d AS (
  SELECT i.app_id, project AS service, split_part(split_part(split_part(url, '//', 2), '/', 1), ':', 1) AS provider,
    'Endpoint[RequestURI:' || CASE WHEN contains(verb_name, 'HttpMethod.') THEN split_part(verb_name, 'HttpMethod.', 2)
      ELSE 'HTTP_REQUEST' END || ' ' || substr(url, strpos(url, '//') + 2 + length(split_part(split_part(url, '//', 2),
      '/', 1))) || ']' AS destination, root_method AS operation, profile AS environment, false AS overwrites,
    true AS from_method, 'JavaMethod[ElementIdentifier:exchange()]' AS evidence, 7 AS phase, seq, 0 AS rule
  FROM f_java_invocation i JOIN call_arg a ON i.app_id = a.app_id AND i.invocation_key = a.invocation_key
  WHERE callee = 'exchange' AND receiver_type = 'RestTemplate' AND receiver_package = 'org.springframework.web.client'
    AND contains(url, '//'))"""
ASYNC_DEPENDENCIES = """
send AS (
  SELECT i.*, CASE WHEN contains(key_text, '*') THEN split_part(split_part(key_text, '"', 2), '*', 1)
    ELSE split_part(key_text, '"', 2) END AS routing
  FROM f_java_invocation i JOIN call_arg a ON i.app_id = a.app_id AND i.invocation_key = a.invocation_key
  WHERE callee = 'convertAndSend' AND arg_count >= 2 AND key_text IS NOT NULL),
queue AS (SELECT DISTINCT app_id, project AS provider, queue FROM listener WHERE queue <> ''),
async_d AS (
  SELECT s.app_id, s.project AS service, provider, 'QueueListener[QueueName:' || queue || ']' AS destination,
    root_method AS operation, s.profile AS environment, false AS overwrites, true AS from_method,
    'JavaMethod[ElementIdentifier:convertAndSend()]' AS evidence, 8 AS phase, s.seq, 0 AS rule
  FROM send s JOIN queue q ON s.app_id = q.app_id AND contains(queue, routing) WHERE routing <> '')"""
D_LISTED = "app_id, service, provider, destination, operation, environment, evidence"


def listed_dependencies(table: str) -> str:
    return f"SELECT DISTINCT {D_LISTED} FROM {table}"


def dependency_set(df):
    return df.select(*[name.strip() for name in D_LISTED.split(",")]).distinct()


@query(
    "dependencies_from_links",
    f"{LINK_DEPENDENCIES} {listed_dependencies('link_d')}",
    ("container", "container_link"),
)
def dependencies_from_links(f):
    return dependency_set(dependencies.from_links(f.container_link, f.container))


@query(
    "dependencies_from_properties",
    f"{FLAGGED}, {PROPERTY_DEPENDENCIES} {listed_dependencies('property_d')}",
    (*FLAG_FACTS, "java_annotation"),
)
def dependencies_from_properties(f):
    return dependency_set(dependencies.from_properties(f.property, flags_of(f)))


@query(
    "dependencies_from_feign",
    f"{MAPPED}, {FEIGN_DEPENDENCIES} {listed_dependencies('feign_d')}",
    ("java_annotation", "annotation_param", "java_method"),
)
def dependencies_from_feign(f):
    return dependency_set(dependencies.from_feign(f.java_method, f.java_annotation, f.annotation_param))


@query(
    "dependencies_from_rest_template",
    f"{REST_DEPENDENCIES} {listed_dependencies('rest_d')}",
    ("java_invocation", "invocation_arg"),
)
def dependencies_from_rest_template(f):
    return dependency_set(dependencies.from_rest_template(f.java_invocation, f.invocation_arg))


@query(
    "async_dependencies",
    f"{LISTENERS}, {REST_DEPENDENCIES}, {ASYNC_DEPENDENCIES} {listed_dependencies('async_d')}",
    (*LISTENER_FACTS, "java_invocation", "invocation_arg"),
)
def async_dependencies(f):
    queues = endpoints.merge_listeners(listeners_of(f)).rows.select("app_id", "service", "queue")
    return dependency_set(dependencies.from_async(f.java_invocation, f.invocation_arg, queues))


DEPENDENCY_FACTS = (
    "container", "container_link", *FLAG_FACTS, "java_annotation", "annotation_param", "java_method",
    "java_invocation", "invocation_arg",
)
ALL_DEPENDENCIES = f"""{FLAGGED}, {LINK_DEPENDENCIES}, {PROPERTY_DEPENDENCIES}, {MAPPED}, {LISTENERS},
{FEIGN_DEPENDENCIES}, {REST_DEPENDENCIES}, {ASYNC_DEPENDENCIES},
every_d AS (
  SELECT *, row_number() OVER (PARTITION BY app_id, service, provider ORDER BY phase, seq, rule, destination) AS n
  FROM (SELECT * FROM link_d UNION ALL SELECT * FROM property_d UNION ALL SELECT * FROM feign_d
    UNION ALL SELECT * FROM rest_d UNION ALL SELECT * FROM async_d) d),
first_use AS (
  SELECT app_id, service, provider, destination AS taker, min(n) AS use FROM every_d WHERE destination <> '' GROUP BY ALL),
member AS (
  SELECT *, destination AS row_destination FROM every_d WHERE destination <> ''
  UNION ALL
  SELECT d.*, coalesce(taker, '') FROM every_d d ASOF LEFT JOIN first_use u
    ON d.app_id = u.app_id AND d.service = u.service AND d.provider = u.provider AND d.n < u.use
  WHERE coalesce(d.destination, '') = ''),
dependency AS (
  SELECT app_id, service, provider,
    CASE WHEN row_destination <> '' THEN row_destination ELSE max(destination) END AS destination,
    arg_max(operation, n) FILTER (WHERE from_method) AS operation,
    CASE WHEN bool_or(overwrites) THEN arg_max(environment, n) FILTER (WHERE overwrites)
      WHEN arg_min(coalesce(environment, '-'), n) = '-' THEN NULL ELSE arg_min(environment, n) END AS environment
  FROM member GROUP BY app_id, service, provider, row_destination)"""


def dependencies_of(f):
    f.share_lines()
    queues = endpoints.merge_listeners(listeners_of(f)).rows.select("app_id", "service", "queue")
    # The merge reads its contributions several times.
    return dependencies.merge_dependencies(written(dependencies.contributions(f, flags_of(f), queues, written)))


@query("merge_dependencies", f"{ALL_DEPENDENCIES} SELECT * FROM dependency", DEPENDENCY_FACTS)
def merge_dependencies(f):
    return dependencies_of(f).rows.drop("ord", "wrapped")


@query(
    "dependency_evidence",
    f"{ALL_DEPENDENCIES} SELECT DISTINCT app_id, service, provider, row_destination AS destination, evidence FROM member",
    DEPENDENCY_FACTS,
)
def dependency_evidence(f):
    return dependencies_of(f).evidence.drop("ord")


@query(
    "dependency_graph",
    f"{ALL_DEPENDENCIES} SELECT DISTINCT app_id, service AS consumer, provider FROM every_d",
    DEPENDENCY_FACTS,
)
def dependency_graph(f):
    return dependencies.dependency_graph(dependencies_of(f).rows)


# --- topology ---------------------------------------------------------------------------------

TOPOLOGY_FACTS = tuple(dict.fromkeys((*COMPONENT_FACTS, "module", "container_link", *ENDPOINT_FACTS, "invocation_arg")))
UNIQUE_ENDPOINTS = ALL_ENDPOINTS.replace(f"{FLAGGED}, ", "", 1)
STREAMS = f"""
breaker_d AS (
  SELECT c.app_id, c.service, e.service AS provider, 'Endpoint[RequestURI:' || uri || ']' AS destination, environment
  FROM (SELECT DISTINCT app_id, service FROM component
    WHERE (kind = 'Server' AND category = '{rules.BREAKER_MONITORING}') OR category = '{rules.BREAKER_AGGREGATION}') c
  JOIN endpoint e ON c.app_id = e.app_id AND uri LIKE '%hystrix.stream')"""
ROUTES = f"""
gateway AS (
  SELECT DISTINCT app_id, service FROM component WHERE kind = 'Server' AND category = '{rules.API_GATEWAY}'),
path_property AS (
  SELECT p.app_id, p.project, p.seq, CASE WHEN contains(value, '/*') THEN split_part(value, '/*', 1) ELSE '' END AS prefix,
    split_part(split_part(name, 'zuul.routes.', 2), '.path', 1) AS route_id
  FROM f_property p JOIN gateway g ON p.app_id = g.app_id AND p.project = g.service
  WHERE name LIKE 'zuul.routes.%.path'),
id_property AS (
  SELECT t.app_id, t.project, t.route_id, arg_min(name, p.seq) AS name
  FROM (SELECT DISTINCT app_id, project, route_id FROM path_property) t JOIN f_property p
    ON t.app_id = p.app_id AND t.project = p.project AND starts_with(name, 'zuul.routes.' || route_id)
    AND name LIKE '%.serviceId' GROUP BY t.app_id, t.project, t.route_id),
route AS (
  SELECT t.app_id, t.project AS gateway, t.seq, prefix,
    CASE WHEN i.name IS NULL THEN t.route_id ELSE split_part(split_part(i.name, 'zuul.routes.', 2), '.serviceId', 1) END
      AS target
  FROM path_property t LEFT JOIN id_property i
    ON t.app_id = i.app_id AND t.project = i.project AND t.route_id = i.route_id)"""
FORWARDED = f"""
routed AS (
  SELECT r.app_id, gateway AS service, split_part(uri, ' ', 1) || ' ' || prefix || split_part(uri, ' ', 2) AS uri,
    environment, target AS provider, uri AS target_uri, false AS default_route, seq
  FROM route r JOIN endpoint e ON r.app_id = e.app_id AND r.target = e.service),
default_routed AS (
  SELECT g.app_id, g.service, split_part(uri, ' ', 1) || ' /' || e.service || split_part(uri, ' ', 2) AS uri,
    environment, e.service AS provider, uri AS target_uri, true AS default_route, CAST(0 AS BIGINT) AS seq
  FROM gateway g JOIN endpoint e ON g.app_id = e.app_id AND g.service <> e.service
  WHERE EXISTS (SELECT 1 FROM component c WHERE c.app_id = e.app_id AND c.service = e.service AND kind = 'Client'
      AND category = '{rules.REGISTRY}' AND technology = 'Eureka')
    AND NOT EXISTS (SELECT 1 FROM f_property p WHERE p.app_id = g.app_id AND p.project = g.service
      AND name = 'zuul.ignoredServices' AND contains(value, '*'))
    AND NOT EXISTS (SELECT 1 FROM route r WHERE r.app_id = g.app_id AND r.gateway = g.service AND r.target = e.service))"""
TOPOLOGY = f"{ALL_COMPONENTS}, {UNIQUE_ENDPOINTS}, {STREAMS}, {ROUTES}, {FORWARDED}"
ONLY_DEPENDENCIES = ALL_DEPENDENCIES.replace(f"{FLAGGED}, ", "", 1).replace(f"{MAPPED}, ", "", 1)
WRAPPED = f"""
direct AS (
  SELECT app_id, service, provider, destination, environment FROM dependency UNION ALL SELECT * FROM breaker_d),
wrapped AS (
  SELECT app_id, service, provider, 'Endpoint[RequestURI:' || target_uri || ']' AS destination,
    arg_min(coalesce(environment, '-'), (default_route, seq)) AS environment
  FROM (SELECT * FROM routed UNION ALL SELECT * FROM default_routed) f GROUP BY ALL),
gateway_d AS (
  SELECT * FROM wrapped w WHERE NOT EXISTS (SELECT 1 FROM direct d WHERE d.app_id = w.app_id
    AND d.service = w.service AND d.provider = w.provider AND d.destination = w.destination))"""


def recovered(f):
    """Merged component and endpoint rows, the input of the topology rules."""
    merged = components.merge_components(components.contributions(f, flags_of(f))).rows
    return written(merged), written(endpoint_parts(f)[2].rows.drop("ord"))


def forwarded_of(f, merged, published):
    gateway_services = topology.gateways(merged)
    routes = topology.route_table(gateway_services, f.property)
    configured = topology.gateway_routes(routes, published)
    default = topology.gateway_default_routes(gateway_services, routes, f.property, merged, published)
    return configured, default


@query(
    "circuit_breaker_dependencies",
    f"{ALL_COMPONENTS}, {UNIQUE_ENDPOINTS}, {STREAMS} SELECT * FROM breaker_d",
    TOPOLOGY_FACTS,
)
def circuit_breaker_dependencies(f):
    return topology.circuit_breaker_dependencies(*recovered(f)).drop("wrapped")


@query("gateway_route_table", f"{ALL_COMPONENTS}, {ROUTES} SELECT * FROM route", COMPONENT_FACTS)
def gateway_route_table(f):
    merged = components.merge_components(components.contributions(f, flags_of(f))).rows
    return topology.route_table(topology.gateways(merged), f.property)


@query("gateway_routes", f"{TOPOLOGY} SELECT * FROM routed", TOPOLOGY_FACTS)
def gateway_routes(f):
    return forwarded_of(f, *recovered(f))[0]


@query("gateway_default_routes", f"{TOPOLOGY} SELECT * FROM default_routed", TOPOLOGY_FACTS)
def gateway_default_routes(f):
    return forwarded_of(f, *recovered(f))[1]


@query(
    "gateway_dependencies",
    f"{TOPOLOGY}, {ONLY_DEPENDENCIES}, {WRAPPED} SELECT *, true AS wrapped FROM gateway_d",
    TOPOLOGY_FACTS,
)
def gateway_dependencies(f):
    f.share_lines()
    merged, published = recovered(f)
    configured, default = forwarded_of(f, merged, published)
    columns = ["app_id", "service", "provider", "destination"]
    direct = dependencies_of(f).rows.select(*columns).unionByName(
        topology.circuit_breaker_dependencies(merged, published).select(*columns)
    )
    return topology.gateway_dependencies(configured.unionByName(default), direct).withColumn(
        "environment", F.coalesce("environment", F.lit("-"))
    )


@query(
    "service_overview",
    f"""{TOPOLOGY}, {ONLY_DEPENDENCIES}, {WRAPPED}, {TYPED_ONLY},
edge AS (SELECT DISTINCT app_id, service, provider FROM (
  SELECT app_id, service, provider FROM direct UNION ALL SELECT app_id, service, provider FROM gateway_d) d),
used AS (SELECT app_id, service, count(*) AS components, count(DISTINCT category) AS categories FROM component GROUP BY ALL),
outgoing AS (SELECT app_id, service, count(*) AS providers FROM edge GROUP BY ALL),
incoming AS (SELECT app_id, provider AS service, count(*) AS consumers FROM edge GROUP BY ALL)
SELECT t.app_id, t.service, t.kind, coalesce(components, 0) AS components, coalesce(categories, 0) AS categories,
  coalesce(providers, 0) AS providers, coalesce(consumers, 0) AS consumers
FROM typed t LEFT JOIN used u ON t.app_id = u.app_id AND t.service = u.service
  LEFT JOIN outgoing o ON t.app_id = o.app_id AND t.service = o.service
  LEFT JOIN incoming i ON t.app_id = i.app_id AND t.service = i.service""",
    TOPOLOGY_FACTS,
)
def overview(f):
    """Infrastructure and neighbours of every service, over dependencies of every kind."""
    f.share_lines()
    merged, published = recovered(f)
    configured, default = forwarded_of(f, merged, published)
    columns = ["app_id", "service", "provider", "destination", "environment"]
    direct = dependencies_of(f).rows.select(*columns).unionByName(
        topology.circuit_breaker_dependencies(merged, published).select(*columns)
    )
    direct = written(direct)
    every = direct.unionByName(
        topology.gateway_dependencies(configured.unionByName(default), direct).select(*columns)
    )
    typed = services.classify_services(services.merge_services(f.container, f.module).rows, merged)
    return service_overview({"microservice": typed, "component": merged, "dependency": every})


@query("derive")
def derive_fleet(f):
    """The same overview from the whole derivation plan."""
    f.share_lines()
    tables = {name: getattr(f, name) for name in FACT_SQL}
    return service_overview(derive(Facts.of(f._spark, tables, "bigint"), written))


ORACLES["derive"] = ORACLES["service_overview"]

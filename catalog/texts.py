"""Queries over artifact texts. The texts are put together from the test tables; the oracle SQL reads
the expected facts straight from the rows the texts are made of."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog.facts import LINE_NUMBER, SERVICES, div, text
from catalog.registry import query
from fleetscope import rules
from fleetscope.functions.runtime import cut_lineage, spillable, written
from fleetscope.operators import build, config as config_ops, deploy
from fleetscope.plans.extract import extract
from fleetscope.schema import fact_schema
from fleetscope.sources import config, export, files as file_ops, java, model_file, pom
from fleetscope.sources.compose import compose_entries, read_compose, read_dockerfiles, rejected_services, services_of


def sql(f, statement: str):
    return f._sql(statement)


# --- files ------------------------------------------------------------------------------------

PATH = "regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '')"
LANG = "regexp_extract(html, 'lang=\"([a-z]+)\"', 1)"
PAGE_FILE = f"""
SELECT split_part({PATH}, '/', 1) AS app_id, substr({PATH}, length(split_part({PATH}, '/', 1)) + 2) AS path,
  html AS content FROM pages
UNION ALL
SELECT split_part({PATH}, '/', 1), {LANG} || '/pom.xml', '<project/>' FROM pages WHERE url LIKE '%/en/%'
UNION ALL
SELECT split_part({PATH}, '/', 1), 'src/test/' || substr({PATH}, length(split_part({PATH}, '/', 1)) + 2), html
FROM pages"""


@query(
    "scan_artifacts",
    f"f_file AS ({PAGE_FILE}) SELECT app_id, path, length(content) AS size FROM f_file "
    "WHERE contains(regexp_extract(path, '([^/]*)$', 1), '.html') AND contains(regexp_extract(path, '^(.*)/[^/]*$', 1), 'en')",
)
def scan_artifacts(f):
    found = file_ops.scan_artifacts(sql(f, PAGE_FILE), ".html", "en")
    return found.select("app_id", "path", F.length("content").cast("long").alias("size"))


@query(
    "exclude_test_sources",
    f"""f_file AS ({PAGE_FILE}) SELECT app_id, path, count(*) AS files FROM (
  SELECT app_id, '/' || path AS path FROM f_file) x WHERE NOT contains(path, '/src/test/') GROUP BY app_id, path""",
)
def exclude_test_sources(f):
    rooted = sql(f, PAGE_FILE).withColumn("path", F.concat(F.lit("/"), "path"))
    return file_ops.exclude_test_sources(rooted).groupBy("app_id", "path").agg(F.count("*").alias("files"))


@query(
    "discover_modules",
    f"""f_file AS ({PAGE_FILE}), name AS (SELECT DISTINCT split_part({PATH}, '/', 1) AS app_id, {LANG} AS name FROM pages)
SELECT f.app_id, split_part(path, '/', 1) AS directory,
  min(CASE WHEN path = split_part(path, '/', 1) || '/pom.xml' THEN path END) AS build_file
FROM f_file f JOIN name n ON f.app_id = n.app_id AND split_part(path, '/', 1) = n.name
WHERE contains(path, '/') GROUP BY 1, 2""",
)
def discover_modules(f):
    names = sql(f, f"SELECT split_part({PATH}, '/', 1) AS app_id, {LANG} AS name FROM pages")
    return file_ops.discover_modules(names, sql(f, PAGE_FILE))


APPS = """
SELECT c_custkey AS app_id, CASE c_nationkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'a<b' ELSE c_name END AS name,
  CASE WHEN c_nationkey = 7 THEN CAST(NULL AS STRING) ELSE '/src' END AS root,
  CASE WHEN c_acctbal < 0 THEN 0 ELSE 2 END AS compose_files, c_nationkey % 4 AS module_dirs,
  CASE WHEN c_mktsegment = 'BUILDING' THEN ' ' ELSE '/out' END AS output
FROM customer"""


@query(
    "validate_app_inputs",
    f"""f_app AS ({APPS}) SELECT app_id, concat_ws(';', CASE WHEN name = '' THEN 'name is missing' END,
  CASE WHEN contains(name, '<') THEN 'name has a forbidden character' END,
  CASE WHEN root IS NULL THEN 'root is missing' END, CASE WHEN compose_files < 1 THEN 'no compose file' END,
  CASE WHEN module_dirs < 1 THEN 'no module directory' END,
  CASE WHEN trim(output) = '' THEN 'output is missing' END) AS reasons FROM f_app""",
)
def validate_app_inputs(f):
    checked = file_ops.validate_app_inputs(sql(f, APPS))
    return checked.select("app_id", F.array_join("reasons", ";").alias("reasons"))


# --- YAML over whole documents ----------------------------------------------------------------


def document_yaml(f):
    """Every line of every document as a YAML line: first word as key, the rest as value."""
    words = F.filter(F.split("text", "\n"), lambda line: F.trim(line) != "")

    def keyed(line):
        """Marks stay in the value; in the key they would make another line of it."""
        word = F.substring_index(line, " ", 1)
        return F.concat(F.translate(word, ":#-", "..."), F.lit(": "), F.substring(line, F.length(word) + 1, F.length(line)))

    lines = F.transform(
        words,
        lambda line, at: F.concat(
            F.repeat(F.lit("  "), at % 3),
            F.when(at % 7 == 5, F.concat(F.lit("- "), F.translate(line, ":#-", "..."))).otherwise(keyed(line)),
        ),
    )
    return sql(f, "SELECT doc_id, text FROM documents").select("doc_id", F.array_join(lines, "\n").alias("content"))


YAML_SQL = r"""
line AS (
  SELECT doc_id, spot, CASE WHEN spot % 7 = 5 THEN translate(raw, ':#-', '...') ELSE raw END AS raw,
    split_part(translate(raw, ':#-', '...'), ' ', 1) AS word
  FROM (SELECT doc_id, raw, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS spot
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS n
      FROM documents) s WHERE trim(raw) <> '') r),
keyed AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY spot) AS k FROM line WHERE spot % 7 <> 5),
sized AS (
  SELECT *, k + min(spot % 3 + 1 - k) OVER (PARTITION BY doc_id ORDER BY spot ROWS UNBOUNDED PRECEDING) AS lowest FROM keyed),
depth AS (SELECT doc_id, spot, trim(word) AS word, CAST(least(lowest, k) AS INT) AS size FROM sized),
spread AS (
  SELECT l.doc_id, l.spot, l.raw, l.word, l.spot % 7 = 5 AS item,
    last_value(d.size IGNORE NULLS) OVER w AS size,
    last_value(CASE WHEN d.size = 1 THEN d.word END IGNORE NULLS) OVER w AS one,
    last_value(CASE WHEN d.size = 2 THEN d.word END IGNORE NULLS) OVER w AS two,
    last_value(CASE WHEN d.size = 3 THEN d.word END IGNORE NULLS) OVER w AS three
  FROM line l LEFT JOIN depth d ON l.doc_id = d.doc_id AND l.spot = d.spot
  WINDOW w AS (PARTITION BY l.doc_id ORDER BY l.spot ROWS UNBOUNDED PRECEDING))
SELECT doc_id, one || CASE WHEN size > 1 THEN '.' || two ELSE '' END || CASE WHEN size > 2 THEN '.' || three ELSE '' END
  AS name, trim(CASE WHEN item THEN raw ELSE split_part(substr(raw, length(word) + 1), '#', 1) END) AS value, count(*) AS hits
FROM spread WHERE size IS NOT NULL AND (item OR trim(substr(raw, length(word) + 1)) <> '') GROUP BY ALL"""


@query("read_yaml_properties", YAML_SQL)
def read_yaml_properties(f):
    lines = document_yaml(f).select("doc_id", F.explode(config.flatten_yaml(F.col("content"))).alias("line"))
    name, value = F.substring_index("line", "=", 1), F.regexp_extract("line", "(?s)^[^=]*=(.*)$", 1)
    return lines.groupBy("doc_id", name.alias("name"), value.alias("value")).agg(F.count("*").alias("hits"))


# --- configuration files ----------------------------------------------------------------------

CONFIG_LINE = f"""
SELECT {div('event_id', 32)} AS file_no, event_id, CASE
  WHEN event_id % 20 = 7 THEN '---'
  WHEN event_id % 50 = 11 THEN 'spring.profiles=' || event_type || ',eu'
  WHEN event_id % 41 = 5 THEN 'spring.application.name: shop-' || {text('event_id % 9')}
  WHEN event_id % 13 = 3 THEN '# ' || event_type
  WHEN event_id % 3 = 0 THEN 'k' || {text('event_id % 30')} || ' = http://' || event_type || ':80/x=1 '
  ELSE 'k' || {text('event_id % 30')} || ': ' || event_type END AS line
FROM events"""


def config_files(f):
    """Files of 32 lines each."""
    return (
        sql(f, CONFIG_LINE)
        .groupBy("file_no")
        .agg(F.array_join(F.sort_array(F.collect_list(F.struct("event_id", "line"))).getField("line"), "\n").alias("content"))
        .select("file_no", F.concat(F.lit("conf/application-"), "file_no", F.lit(".properties")).alias("path"), "content")
    )


PARSED_CONFIG = f"""
line AS ({CONFIG_LINE}),
kept AS (SELECT *, sum(CASE WHEN line = '---' THEN 1 ELSE 0 END) OVER (PARTITION BY file_no ORDER BY event_id) AS doc
  FROM line WHERE NOT contains(line, '#')),
pair AS (
  SELECT file_no, CAST(doc AS INT) AS doc, event_id, trim(CASE WHEN contains(line, '=') THEN split_part(line, '=', 1)
      ELSE split_part(line, ':', 1) END) AS name,
    trim(CASE WHEN contains(line, '=') THEN substr(line, strpos(line, '=') + 1) ELSE substr(line, strpos(line, ':') + 1) END)
      AS value
  FROM kept WHERE line <> '---'),
property AS (
  SELECT *, coalesce(last_value(CASE WHEN name = 'spring.profiles' THEN upper(replace(value, ',', ';')) END IGNORE NULLS)
    OVER (PARTITION BY file_no ORDER BY event_id), 'COMPILE') AS profile,
    CAST(row_number() OVER (PARTITION BY file_no ORDER BY event_id) - 1 AS INT) AS pos FROM pair)"""


@query("read_properties_files", f"{PARSED_CONFIG} SELECT file_no, doc, pos, name, value, profile FROM property")
def read_properties_files(f):
    return config.file_properties(config.config_lines(config_files(f))).drop("path")


@query(
    "application_name",
    f"""{PARSED_CONFIG}, first AS (
  SELECT file_no, doc, arg_min(value, pos) AS value FROM property WHERE name = 'spring.application.name' GROUP BY ALL)
SELECT file_no, arg_max(value, doc) AS app_name FROM first GROUP BY file_no""",
)
def application_name(f):
    rows = config.file_properties(config.config_lines(config_files(f))).withColumn("phase", F.lit(0))
    return config.application_name(rows, ["file_no"])


def _file(path: str, *lines: str) -> tuple[str, str]:
    """SQL for the path and for the lines of a file of every supplier."""
    return path, " || chr(10) || ".join(lines)


_SVC = f"'svc-' || {text('s_suppkey')}"
_NAME = "replace(s_name, '#', '-')"
_PORT = text("8000 + s_suppkey % 7")
_OPEN = "'$' || '{'"


def _reference(*names: str) -> str:
    return " || '/' || ".join(f"{_OPEN} || '{name}' || '}}'" for name in names)


# A default, references inside a document and across documents and files, a missing one, a local port, and profiles.
APPLICATION_YML = _file(
    f"{_SVC} || '/src/main/resources/application.yml'",
    f"'n: ' || {_NAME}", f"'spring.application.name: ' || {_SVC}", f"'port: ' || {_PORT}",
    f"'url: http://localhost:' || {_reference('port')} || '/a'", f"'alias: ' || {_reference('n', 'base')}",
    f"'opt: ' || {_reference('ctx:api')}", "'---'", "'spring.profiles: docker'", f"'host: ' || {_reference('n')}",
    f"'far: ' || {_reference('boot')}",
)
BOOTSTRAP = _file(
    f"{_SVC} || '/src/main/resources/bootstrap-' || {text('s_nationkey')} || '.properties'",
    f"'boot=b' || {text('s_nationkey')}", "'n=boot'", f"'own=' || {_reference('n')}",
)
CENTRAL = _file(f"'central/config/application-' || {text('s_suppkey')} || '.yaml'", f"'shared: ' || {_reference('n', 'port')}")
NAMED = _file(f"'central/config/svc-' || {text('s_suppkey')} || '-prod.yml'", f"'late: x' || {_reference('boot')}")
MODULE_FILE = "\nUNION ALL\n".join(
    f"SELECT {div('s_suppkey', 10)} AS app_id, {path} AS path, {content} AS content FROM supplier"
    for path, content in (
        APPLICATION_YML, BOOTSTRAP, CENTRAL, NAMED,
        _file(f"{_SVC} || '/src/test/resources/application.yml'", "'n: of a test'"),
        _file(f"{_SVC} || '/README.md'", "'n: of a text'"),
    )
)
MODULE_KEY = f"SELECT {div('s_suppkey', 10)} AS app_id, 'svc-' || {text('s_suppkey')} AS module FROM supplier"


@query(
    "module_config_files",
    f"""f_file AS ({MODULE_FILE}), f_module AS ({MODULE_KEY}),
config AS (SELECT *, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, regexp_extract(path, '([^/]*)$', 1) AS base FROM f_file
  WHERE (path LIKE '%.yml' OR path LIKE '%.yaml' OR path LIKE '%.properties') AND NOT contains(path, '/src/test/'))
SELECT m.app_id, module, path, 0 AS phase, '' AS app_name FROM f_module m JOIN config c
  ON m.app_id = c.app_id AND contains(dir, module) AND contains(base, 'application')
UNION ALL SELECT m.app_id, module, path, 1, '' FROM f_module m JOIN config c
  ON m.app_id = c.app_id AND contains(dir, module) AND contains(base, 'bootstrap')
UNION ALL SELECT m.app_id, module, path, 2, '' FROM f_module m JOIN config c
  ON m.app_id = c.app_id AND contains(dir, 'central/') AND contains(base, 'application')
UNION ALL SELECT m.app_id, module, path, 3, module FROM f_module m JOIN config c
  ON m.app_id = c.app_id AND contains(dir, 'central/') AND contains(base, module)""",
)
def module_config_files(f):
    modules = sql(f, MODULE_KEY)
    dirs = modules.select("app_id", F.lit("central/").alias("config_dir")).distinct()
    names = modules.withColumn("app_name", F.col("module"))
    return config_ops.module_config_files(sql(f, MODULE_FILE), modules, dirs, names)


# What the files say, read from the supplier rows they are made of.
MODULE_PROPERTY = "\nUNION ALL\n".join(
    f"SELECT {div('s_suppkey', 10)} AS app_id, {_SVC} AS module, {path} AS path, {phase} AS phase, {doc} AS doc, {pos} AS pos, "
    f"'{name}' AS name, {value} AS value, '{profile}' AS profile FROM supplier"
    for path, phase, doc, pos, name, value, profile in (
        *((APPLICATION_YML[0], 0, 0, pos, name, value, "COMPILE") for pos, (name, value) in enumerate((
            ("n", _NAME), ("spring.application.name", _SVC), ("port", _PORT),
            ("url", f"'http://localhost:' || {_PORT} || '/a'"), ("alias", f"{_NAME} || '/' || {_reference('base')}"), ("opt", "'api'"),
        ))),
        *((APPLICATION_YML[0], 0, 1, pos + 6, name, value, "DOCKER") for pos, (name, value) in enumerate((
            ("spring.profiles", "'docker'"), ("host", _NAME), ("far", f"'b' || {text('s_nationkey')}"),
        ))),
        *((BOOTSTRAP[0], 1, 0, pos, name, value, "COMPILE") for pos, (name, value) in enumerate((
            ("boot", f"'b' || {text('s_nationkey')}"), ("n", "'boot'"), ("own", "'boot'"),
        ))),
        (NAMED[0], 3, 0, 0, "late", f"'xb' || {text('s_nationkey')}", "PROD"),
    )
)


@query(
    "collect_module_properties",
    f"""f_own AS ({MODULE_PROPERTY}), f_port AS (
  SELECT {div('s_suppkey', 10)} AS app_id, {_PORT} AS port, max(s_suppkey) AS last FROM supplier GROUP BY 1, 2),
shared AS (
  SELECT {div('m.s_suppkey', 10)} AS app_id, 'svc-' || {text('m.s_suppkey')} AS module,
    'central/config/application-' || {text('c.s_suppkey')} || '.yaml' AS path, 2 AS phase, 0 AS doc, 0 AS pos, 'shared' AS name,
    replace(m.s_name, '#', '-') || '/' || {text('8000 + m.s_suppkey % 7')} AS value, 'COMPILE' AS profile
  FROM supplier m JOIN supplier c ON {div('m.s_suppkey', 10)} = {div('c.s_suppkey', 10)})
SELECT o.app_id, module, path, phase, doc, pos, name,
  CASE WHEN name = 'url' THEN 'http://svc-' || {text('last')} || '/a' ELSE value END AS value, profile
FROM f_own o LEFT JOIN f_port p ON o.app_id = p.app_id AND contains(value, 'localhost:' || port)
UNION ALL SELECT * FROM shared""",
)
def collect_module_properties(f):
    modules = sql(f, MODULE_KEY)
    dirs = modules.select("app_id", F.lit("central/").alias("config_dir")).distinct()
    ports = sql(f, PORT)
    rows = config_ops.collect_module_properties(sql(f, MODULE_FILE), modules, dirs, ports)[0]
    return rows.select("app_id", "module", "path", "phase", "doc", "pos", "name", "value", "profile")


OPEN, SHUT = "'$' || '{'", "'}'"
PLACEHOLDER = f"""
SELECT {div(f'(user_id % {SERVICES})', 10)} AS app_id, 'svc-' || {text(f'user_id % {SERVICES}')} AS module,
  CAST(event_id % 3 AS INT) AS doc_order, event_id AS pos_order, 'k' || {text('event_id % 40')} AS name,
  CASE event_id % 5
    WHEN 1 THEN {OPEN} || 'k' || {text('event_id % 40 + 1')} || {SHUT} || '/a'
    WHEN 2 THEN {OPEN} || 'x:' || event_type || {SHUT} || '-' || {OPEN} || 'y:z' || {SHUT}
    WHEN 3 THEN {OPEN} || 'missing' || {SHUT} || {OPEN} || 'k' || {text('event_id % 40 + 1')} || {SHUT}
    WHEN 4 THEN {OPEN} || 'k' || {text('event_id % 40 + 1')} || {SHUT} || {OPEN} || 'k' || {text('event_id % 40 + 2')} || {SHUT}
    ELSE 'v' || {text('event_id')} END AS value
FROM events"""
DEFAULTED = f"regexp_replace(value, '\\$\\{{(\\w[\\w.+]*):(\\w[:\\w+]*)\\}}', '\\2', 'g')"


@query("apply_placeholder_defaults", f"f_p AS ({PLACEHOLDER}) SELECT pos_order, {DEFAULTED} AS value FROM f_p")
def apply_placeholder_defaults(f):
    return sql(f, PLACEHOLDER).select(
        "pos_order", config_ops.apply_placeholder_defaults(F.col("value")).alias("value")
    )


@query(
    "resolve_placeholders",
    f"""RECURSIVE_f_p AS (SELECT app_id, module, doc_order, pos_order, name, {DEFAULTED} AS value FROM ({PLACEHOLDER}) p),
near AS (SELECT app_id, module, doc_order, name, arg_min(value, pos_order) AS near FROM RECURSIVE_f_p GROUP BY ALL),
far AS (SELECT app_id, module, name, arg_min(value, (doc_order, pos_order)) AS far FROM RECURSIVE_f_p GROUP BY ALL),
step(app_id, module, doc_order, pos_order, name, value, depth) AS (
  SELECT app_id, module, doc_order, pos_order, name, value, 0 FROM RECURSIVE_f_p
  UNION ALL
  SELECT s.app_id, s.module, s.doc_order, s.pos_order, s.name,
    replace(s.value, '${{' || regexp_extract(s.value, '\\$\\{{(\\w+)\\}}', 1) || '}}',
      coalesce(near, far, '$<' || regexp_extract(s.value, '\\$\\{{(\\w+)\\}}', 1) || '>')), depth + 1
  FROM step s LEFT JOIN near n ON s.app_id = n.app_id AND s.module = n.module AND s.doc_order = n.doc_order
      AND n.name = regexp_extract(s.value, '\\$\\{{(\\w+)\\}}', 1)
    LEFT JOIN far f ON s.app_id = f.app_id AND s.module = f.module AND f.name = regexp_extract(s.value, '\\$\\{{(\\w+)\\}}', 1)
  WHERE regexp_matches(s.value, '\\$\\{{\\w+\\}}'))
SELECT app_id, module, doc_order, pos_order, name,
  replace(replace(arg_max(value, depth), '$<', '${{'), '>', '}}') AS value
FROM step GROUP BY app_id, module, doc_order, pos_order, name""",
)
def resolve_placeholders(f):
    rows = sql(f, PLACEHOLDER).withColumn("value", config_ops.apply_placeholder_defaults(F.col("value")))
    return config_ops.resolve_placeholders(rows, ["app_id", "module"])[0]


PORT = f"""
SELECT {div('s_suppkey', 10)} AS app_id, 'svc-' || {text('s_suppkey')} AS container, s_suppkey AS ord,
  {text('8000 + s_suppkey % 7')} || ':' || {text('80 + s_nationkey % 3')} AS port
FROM supplier"""
LOCAL = f"""
SELECT {div(f'(user_id % {SERVICES})', 10)} AS app_id, event_id,
  CASE WHEN event_id % 4 = 0 THEN event_type ELSE 'http://localhost:' || {text('8000 + event_id % 9')} || '/' || event_type
    || CASE WHEN event_id % 3 = 0 THEN '?b=localhost:80' ELSE '' END END AS value
FROM events"""


@query(
    "resolve_localhost",
    f"""f_port AS ({PORT}), f_value AS ({LOCAL}),
wanted AS (SELECT *, regexp_extract(value, 'localhost:([0-9]+)', 1) AS wanted FROM f_value),
host AS (SELECT p.app_id, w.wanted, arg_max(container, ord) AS host
  FROM (SELECT DISTINCT app_id, wanted FROM wanted WHERE wanted <> '') w JOIN f_port p
  ON p.app_id = w.app_id AND contains(port, wanted) GROUP BY ALL)
SELECT w.app_id, event_id, CASE WHEN host IS NULL THEN value ELSE regexp_replace(value, 'localhost:[0-9]+', host, 'g') END AS value
FROM wanted w LEFT JOIN host h ON w.app_id = h.app_id AND w.wanted = h.wanted""",
)
def resolve_localhost(f):
    return config_ops.resolve_localhost(sql(f, LOCAL), sql(f, PORT), ["app_id", "event_id"])


SERVER_PORT = f"""
SELECT {div('s_suppkey', 10)} AS app_id, s_suppkey AS seq, 'svc-' || {text('s_suppkey')} AS project, 'server.port' AS name,
  {text('8000 + s_suppkey % 13')} AS value FROM supplier"""
WANTED_PORT = f"SELECT {div('p_partkey', 200)} AS app_id, {text('p_partkey % 100')} AS port FROM part"


@query(
    "resolve_host_by_server_port",
    f"""f_port AS ({WANTED_PORT}), f_property AS ({SERVER_PORT})
SELECT w.app_id, w.port, arg_min(project, seq) AS host FROM (SELECT DISTINCT * FROM f_port) w JOIN f_property p
  ON w.app_id = p.app_id AND contains(value, w.port) GROUP BY w.app_id, w.port""",
)
def resolve_host_by_server_port(f):
    return config_ops.host_by_server_port(sql(f, WANTED_PORT), sql(f, SERVER_PORT))


# --- compose files and Dockerfiles ------------------------------------------------------------

COMPOSE_ROW = f"""
SELECT {div('s_suppkey', 10)} AS app_id, 1 AS file_no, s_suppkey AS n, 'svc-' || {text('s_suppkey')} AS container,
  CASE WHEN s_suppkey % 4 = 3 THEN '' ELSE 'acme/' || {text('s_nationkey')} || ':1' END AS image,
  './services/svc-' || {text('s_suppkey')} || '/' AS build,
  {text('8000 + s_nationkey')} AS port, {text('9000 + s_suppkey % 10')} AS expose,
  'svc-' || {text(f"{div('s_suppkey', 10)} * 10 + s_nationkey % 10")} AS link, s_acctbal < 2000 AS logs
FROM supplier
UNION ALL
SELECT {div('p_partkey', 200)}, 2, p_partkey, 'svc-' || {text(f"{div('p_partkey', 200)} * 10 + p_partkey % 12")},
  'other/' || {text('p_size')}, '', {text('8000 + p_size')}, {text('9000 + p_size')},
  'part-' || {text('p_partkey')}, p_size = 1
FROM part"""


def compose_files(f):
    """Two compose files per application; the second one, per container name, is one file each."""
    rows = sql(f, COMPOSE_ROW)
    block = F.concat(
        F.lit("  "), "container", F.lit(":\n    image: "), F.when(F.col("image") == "", '""').otherwise(F.col("image")),
        F.lit("\n    build:\n      context: \""), "build", F.lit("\" # where\n    ports:\n      - \""), "port",
        F.lit("\"\n    expose:\n    - "), "expose", F.lit("\n    depends_on: ["), "link", F.lit("]\n"),
        F.when(F.col("logs"), F.lit("    logging:\n      driver: json\n")).otherwise(""),
    )
    path = F.concat(F.lit("docker-compose-"), F.lpad("file_no", 2, "0"), F.lit("-"), F.lpad("n", 9, "0"), F.lit(".yml"))
    return rows.select(
        "app_id", path.alias("path"), F.concat(F.lit("version: '2'\nservices:\n"), block).alias("content")
    )


ORDERED = f"f_row AS ({COMPOSE_ROW}), row_in_order AS (SELECT *, file_no * 1000000000 + n AS ord FROM f_row)"


@query(
    "merge_containers",
    f"""{ORDERED}
SELECT app_id, container, coalesce(arg_min(image, ord) FILTER (WHERE image <> ''), '') AS image,
  coalesce(arg_min(build, ord) FILTER (WHERE build <> ''), '') AS build, bool_or(logs) AS generates_logs
FROM row_in_order GROUP BY app_id, container""",
)
def merge_containers(f):
    return deploy.merge_containers(read_compose(compose_files(f))).drop("ord", "artifact")


@query(
    "container_ports",
    f"""{ORDERED}, every AS (
  SELECT app_id, container, port, ord * 2 AS ord FROM row_in_order UNION ALL SELECT app_id, container, expose, ord * 2 + 1
  FROM row_in_order)
SELECT app_id, container, port, row_number() OVER (PARTITION BY app_id, container ORDER BY min(ord)) AS position
FROM every GROUP BY app_id, container, port""",
)
def container_ports(f):
    from pyspark.sql import Window

    ports = deploy.container_ports(read_compose(compose_files(f)))
    order = Window.partitionBy(*deploy.CONTAINER).orderBy("ord")
    return ports.withColumn("position", F.row_number().over(order)).drop("ord")


@query(
    "container_links",
    f"""{ORDERED}
SELECT app_id, container, link AS target, row_number() OVER (PARTITION BY app_id, container ORDER BY min(ord)) AS dep_order
FROM row_in_order GROUP BY app_id, container, link""",
)
def container_links(f):
    return deploy.container_links(read_compose(compose_files(f))).drop("ord")


# A base and an image by anchor, merge keys (one and several, also of a service that merges itself), an alias as a service,
# flow maps in both writings, and two services that are rejected.
_FORM_LINES = (
    "'x-base: &base'", f"'  image: base:' || {text('s_nationkey')}", "'  logging: {driver: json}'", "'  ports:'",
    f"'    - \"' || {text('s_suppkey')} || ':1\"'", "'x-other: &other {image: other, ports: [\"9:9\"]}'", f"'x-image: &img redis:' || {text('s_suppkey')}", "'services:'",
    "'  a:'", "'    <<: *base'", "'    expose: [7]'",
    f"'  b: {{image: flow, build: {{context: ./b}}, ports: [\"80:' || {text('s_nationkey')} || '\", 90], depends_on: [a, ''c'']}}'",
    f"'  c: {{\"image\":\"json:' || {text('s_suppkey')} || '\",\"links\":[\"a\"]}}'", "'  d:'", "'    image: *img'", "'  e: &e'",
    "'    image: own'", "'    <<: *base'", "'    ports: [\"5:5\"]'", "'  f: {<<: *e, image: late}'", "'  g: *e'", "'  k: {<<: [*other, *base]}'", "'  h:'",
    "'    image: *lost'", "'    ports: [1]'", "'  i: {image: x,'", "'    build: y}'",
)
FORM_COMPOSE = f"""
SELECT s_suppkey AS app_id, 'compose.yaml' AS path, {" || chr(10) || ".join(_FORM_LINES)} AS content FROM supplier"""


@query(
    "compose_forms",
    f"""s AS (SELECT s_suppkey AS app_id, {text('s_nationkey')} AS nation, {text('s_suppkey')} AS k FROM supplier)
SELECT app_id, container, kind, CAST(replace(replace(shown, '#', nation), '@', k) AS VARCHAR) AS shown FROM s, (VALUES
  ('a', 'image', 'base:#'), ('b', 'image', 'flow'), ('c', 'image', 'json:@'), ('d', 'image', 'redis:@'), ('e', 'image', 'own'),
  ('f', 'image', 'late'), ('g', 'image', 'own'), ('k', 'image', 'other'), ('k', 'logs', 'true'), ('k', 'port', '9:9'), ('h', 'image', '*lost'), ('b', 'build', './b'), ('a', 'logs', 'true'), ('e', 'logs', 'true'),
  ('f', 'logs', 'true'), ('g', 'logs', 'true'), ('a', 'port', '@:1'), ('a', 'port', '7'), ('b', 'port', '80:#'), ('b', 'port', '90'),
  ('e', 'port', '5:5'), ('f', 'port', '5:5'), ('g', 'port', '5:5'), ('h', 'port', '1'), ('b', 'link', 'a'), ('b', 'link', 'c'), ('c', 'link', 'a'),
  ('h', 'rejected', 'alias without anchor'), ('i', 'rejected', 'flow map over several lines')) v(container, kind, shown)""",
)
def compose_forms(f):
    """Containers, ports, links and rejects of compose files with anchors, merge keys and flow maps."""
    entries = cut_lineage(compose_entries(sql(f, FORM_COMPOSE)))
    rows = services_of(entries)
    merged = deploy.merge_containers(rows)
    parts = (
        ("image", merged, F.col("image")), ("build", merged.where("build <> ''"), F.col("build")),
        ("logs", merged.where("generates_logs"), F.lit("true")), ("port", deploy.container_ports(rows), F.col("port")),
        ("link", deploy.container_links(rows), F.col("target")), ("rejected", rejected_services(entries), F.col("reason")),
    )
    shown = [df.select("app_id", "container", F.lit(kind).alias("kind"), value.alias("shown")) for kind, df, value in parts]
    return reduce(DataFrame.unionByName, shown)


DOCKERFILE = f"""
SELECT {div('s_suppkey', 10)} AS app_id, 'src/services/svc-' || {text('s_suppkey')} || '/' || sub || 'Dockerfile' AS path,
  'FROM sdk:' || {text('s_nationkey')} || ' AS build' || chr(10) || 'RUN x' || chr(10) || 'EXPOSE ' || {text('s_suppkey % 90')}
  || chr(10) || 'FROM ' || sub || 'base AS final' || chr(10) AS content
FROM supplier JOIN (VALUES (''), ('z/')) subs(sub) ON true"""


@query(
    "dockerfile_overlay",
    f"""{ORDERED}, merged AS (
  SELECT app_id, container, coalesce(arg_min(image, ord) FILTER (WHERE image <> ''), '') AS image,
    coalesce(arg_min(build, ord) FILTER (WHERE build <> ''), '') AS build FROM row_in_order GROUP BY ALL),
placed AS (SELECT *, regexp_replace(regexp_replace(build, '^[./]+', ''), '/+$', '') AS place FROM merged),
docker AS (SELECT DISTINCT {div('s_suppkey', 10)} AS app_id, s_suppkey,
  'src/services/svc-' || {text('s_suppkey')} AS directory FROM supplier),
chosen AS (SELECT p.app_id, place, min(directory) AS directory FROM (SELECT DISTINCT app_id, place FROM placed
  WHERE place <> '') p JOIN docker d ON p.app_id = d.app_id AND contains(directory, place) GROUP BY ALL)
SELECT p.app_id, container, CASE WHEN c.place IS NULL THEN image ELSE 'base AS final' END AS image,
  {text('s_suppkey % 90')} AS exposed
FROM placed p LEFT JOIN chosen c ON p.app_id = c.app_id AND p.place = c.place
  LEFT JOIN docker d ON c.app_id = d.app_id AND c.directory = d.directory""",
)
def dockerfile_overlay(f):
    # The overlay asks for the containers three times: parse once.
    merged = written(deploy.merge_containers(read_compose(compose_files(f))))
    overlaid, ports = deploy.dockerfile_overlay(merged, read_dockerfiles(sql(f, DOCKERFILE)))
    exposed = ports.select("app_id", "container", F.col("port").alias("exposed"))
    return overlaid.select("app_id", "container", "image").join(exposed, ["app_id", "container"], "left")


@query(
    "read_dockerfiles",
    f"""line AS (SELECT app_id, path, content FROM ({DOCKERFILE}) d)
SELECT app_id, path, 0 AS line_no, split_part(split_part(content, chr(10), 1), 'FROM ', 2) AS image, NULL AS port FROM line
UNION ALL SELECT app_id, path, 2, NULL, split_part(split_part(content, chr(10), 3), 'EXPOSE ', 2) FROM line
UNION ALL SELECT app_id, path, 3, split_part(split_part(content, chr(10), 4), 'FROM ', 2), NULL FROM line""",
)
def dockerfiles(f):
    return read_dockerfiles(sql(f, DOCKERFILE)).drop("directory")


# --- build files ------------------------------------------------------------------------------

POM_DEPENDENCY = f"""
SELECT {div('p_partkey', 20)} AS s_suppkey, p_partkey % 20 AS pos, 'org.' || {text('p_size % 3')} AS group_name,
  CASE WHEN p_partkey % 20 = 13 AND {div('p_partkey', 20)} % 10 > 0
    THEN 'svc-' || {text(f"{div('p_partkey', 200)} * 10 + p_size % ({div('p_partkey', 20)} % 10 + 1)")}
    ELSE 'lib-' || {text('p_size % 8')} END AS library_name,
  CASE p_size % 5 WHEN 0 THEN 'test' WHEN 1 THEN 'runtime' WHEN 2 THEN 'provided' WHEN 3 THEN 'import' END AS scope
FROM part"""


def pom_files(f):
    """One build file per supplier with the 20 dependencies of its parts; every third has a parent."""
    scope = F.coalesce(F.concat(F.lit("<scope>"), "scope", F.lit("</scope>")), F.lit(""))
    one = F.concat(
        F.lit("<dependency><groupId>"), "group_name", F.lit("</groupId><artifactId>"), "library_name",
        F.lit("</artifactId>"), scope, F.lit("</dependency>"),
    )
    listed = (
        _dependencies(f)
        .groupBy("s_suppkey")
        .agg(F.array_join(F.sort_array(F.collect_list(F.struct("pos", one.alias("one")))).getField("one"), "\n").alias("body"))
    )
    owners = sql(
        f,
        f"SELECT s_suppkey, {div('s_suppkey', 10)} AS app_id, 'svc-' || {text('s_suppkey')} AS name, CASE WHEN s_suppkey % 3 = 2 "
        f"THEN 'svc-' || {text(div('s_suppkey', 10) + ' * 10')} END AS parent FROM supplier",
    )
    parent = F.coalesce(F.concat(F.lit("<parent><artifactId>"), "parent", F.lit("</artifactId></parent>")), F.lit(""))
    return owners.join(listed, "s_suppkey", "left").select(
        "app_id",
        F.concat(F.lit("modules/"), "name", F.lit("/pom.xml")).alias("path"),
        F.concat(
            F.lit("<project><artifactId>"), "name", F.lit("</artifactId>"), parent, F.lit("<dependencies>"),
            F.coalesce("body", F.lit("")), F.lit("</dependencies></project>"),
        ).alias("content"),
    )


def _dependencies(f):
    # A build file never names a later one, so references cannot run in a circle.
    return sql(f, POM_DEPENDENCY).withColumn(
        "library_name",
        F.when(F.col("library_name") == F.concat(F.lit("svc-"), "s_suppkey"), "lib-self").otherwise(F.col("library_name")),
    )


POM_SQL = f"""
dep AS (SELECT s_suppkey, pos, group_name, CASE WHEN library_name = 'svc-' || {text('s_suppkey')} THEN 'lib-self'
  ELSE library_name END AS library_name, upper(coalesce(scope, 'compile')) AS scope FROM ({POM_DEPENDENCY}) d),
owner AS (SELECT s_suppkey, {div('s_suppkey', 10)} AS app_id, CASE WHEN s_suppkey % 3 = 2
  THEN {div('s_suppkey', 10)} * 10 END AS parent FROM supplier)"""


@query(
    "read_pom",
    f"""{POM_SQL}
SELECT app_id, 'svc-' || {text('o.s_suppkey')} AS artifact_id, 'svc-' || {text('parent')} AS parent_artifact_id, pos,
  group_name, library_name, scope FROM owner o JOIN dep d ON o.s_suppkey = d.s_suppkey""",
)
def read_pom(f):
    poms = pom.read_pom(pom_files(f))
    rows = pom.pom_dependencies(poms)
    names = poms.select("app_id", "path", "artifact_id", "parent_artifact_id")
    return rows.join(names, ["app_id", "path"]).withColumn("pos", F.col("pos").cast("long")).drop("path")


@query(
    "library_occurrences",
    f"""RECURSIVE_{POM_SQL.strip()},
part_of AS (
  SELECT s_suppkey, 0 AS step, parent AS child, CAST(NULL AS VARCHAR) AS group_name,
    CAST(NULL AS VARCHAR) AS library_name, CAST(NULL AS VARCHAR) AS scope FROM owner
  WHERE parent IS NOT NULL AND parent <> s_suppkey
  UNION ALL
  SELECT d.s_suppkey, pos + 1, CAST(CASE WHEN library_name LIKE 'svc-%' THEN replace(library_name, 'svc-', '') END AS BIGINT),
    group_name, library_name, scope FROM dep d),
walk(root, child, place, group_name, library_name, scope) AS (
  SELECT s_suppkey, child, lpad({text('step')}, 6, '0'), group_name, library_name, scope FROM part_of
  UNION ALL
  SELECT w.root, p.child, w.place || lpad({text('p.step')}, 6, '0'), p.group_name, p.library_name, p.scope
  FROM walk w JOIN part_of p ON w.child = p.s_suppkey WHERE w.child IS NOT NULL)
SELECT {div('root', 10)} AS app_id, 'modules/svc-' || {text('root')} || '/pom.xml' AS path, place, group_name, library_name, scope
FROM walk WHERE child IS NULL""",
)
def library_occurrences(f):
    poms = pom.read_pom(pom_files(f))
    occurrences, _ = build.library_occurrences(poms, pom.pom_dependencies(poms))
    return occurrences.drop("declared_in")


SCOPE_LOOKUP = (
    "table_of(change, result) AS (VALUES "
    + ", ".join(f"('{old}|{new}', '{'' if result == '-' else result}')" for old, row in rules.SCOPE_TABLE.items() for new, result in row.items())
    + "), lookup AS (SELECT map(list(change), list(result)) AS next FROM table_of)"
)


@query(
    "library_effects",
    f"""RECURSIVE_{POM_SQL.strip()}, {SCOPE_LOOKUP},
part_of AS (
  SELECT s_suppkey, 0 AS step, parent AS child, CAST(NULL AS VARCHAR) AS group_name,
    CAST(NULL AS VARCHAR) AS library_name, CAST(NULL AS VARCHAR) AS scope FROM owner
  WHERE parent IS NOT NULL AND parent <> s_suppkey
  UNION ALL
  SELECT d.s_suppkey, pos + 1, CAST(CASE WHEN library_name LIKE 'svc-%' THEN replace(library_name, 'svc-', '') END AS BIGINT),
    group_name, library_name, scope FROM dep d),
walk(root, child, place, group_name, library_name, scope) AS (
  SELECT s_suppkey, child, lpad({text('step')}, 6, '0'), group_name, library_name, scope FROM part_of
  UNION ALL
  SELECT w.root, p.child, w.place || lpad({text('p.step')}, 6, '0'), p.group_name, p.library_name, p.scope
  FROM walk w JOIN part_of p ON w.child = p.s_suppkey WHERE w.child IS NOT NULL),
listed AS (SELECT root, group_name, library_name, list(scope ORDER BY place) AS scopes FROM walk WHERE child IS NULL GROUP BY ALL),
folded AS (SELECT l.*, list_reduce(scopes, lambda a, x: CASE WHEN a = '' THEN x ELSE coalesce(next[a || '|' || x], a) END, '') AS scope
  FROM listed l, lookup)
SELECT {div('root', 10)} AS app_id, 'modules/svc-' || {text('root')} || '/pom.xml' AS path, group_name, library_name, scope
FROM folded WHERE scope <> ''""",
)
def library_effects(f):
    poms = cut_lineage(pom.read_pom(pom_files(f)))
    return build.library_effects(poms, pom.pom_dependencies(poms))[0].drop("place")


SHARED_LEVELS = 20


@query(
    "shared_parent_libraries",
    f"""level AS (SELECT unnest(range(0, {SHARED_LEVELS + 1})) AS level), side AS (SELECT unnest(['a', 'b']) AS side)
SELECT s_suppkey AS app_id, side || {text('level')} || 'z/pom.xml' AS path, library_name, scope FROM supplier, level, side, (VALUES
  ('lib-' || {text('s_nationkey')}, 'COMPILE', 0, 20), ('tested', 'TEST', 0, 0), ('started', 'RUNTIME', 0, 20), ('given', 'PROVIDED', 0, 0))
  l(library_name, scope, low, high) WHERE level BETWEEN low AND high""",
)
def shared_parent_libraries(f):
    """Levels of build files that each name both files of the level below: 2**20 ways through 42 files."""
    suppliers = sql(f, "SELECT s_suppkey AS app_id, s_nationkey FROM supplier")
    files = suppliers.select("app_id", "s_nationkey", F.explode(F.sequence(F.lit(0), F.lit(SHARED_LEVELS))).alias("level"), F.array(F.lit("a"), F.lit("b")).alias("sides"))
    files = files.select("*", F.explode("sides").alias("side"), (F.col("level") - 1).cast("string").alias("below"))
    base = F.array(*[
        F.struct(name.alias("library_name"), F.lit(scope).alias("scope"))
        for name, scope in ((F.concat(F.lit("lib-"), "s_nationkey"), "COMPILE"), (F.lit("tested"), "TEST"), (F.lit("started"), "RUNTIME"), (F.lit("given"), "PROVIDED"))
    ])
    shared = F.array(F.struct(F.concat(F.lit("b"), "below", F.lit("z")).alias("library_name"), F.lit("COMPILE").alias("scope")))
    named = files.select(
        "app_id", F.concat("side", "level", F.lit("z")).alias("artifact_id"), F.when(F.col("level") > 0, F.concat(F.lit("a"), "below", F.lit("z"))).alias("parent_artifact_id"),
        F.when(F.col("level") > 0, shared).otherwise(base).alias("parts"),
    ).withColumn("path", F.concat("artifact_id", F.lit("/pom.xml")))
    named = cut_lineage(named)
    dependencies = named.select("app_id", "path", F.posexplode("parts").alias("pos", "one")).select("app_id", "path", "pos", F.lit("g").alias("group_name"), "one.library_name", "one.scope")
    return build.library_effects(named.drop("parts"), dependencies)[0].select("app_id", "path", "library_name", "scope")


@query(
    "merge_scopes",
    """
table_of(change, result) AS (VALUES """
    + ", ".join(
        f"('{old}|{new}', '{'' if result == '-' else result}')"
        for old, row in rules.SCOPE_TABLE.items()
        for new, result in row.items()
    )
    + """),
lookup AS (SELECT map(list(change), list(result)) AS next FROM table_of),
listed AS (SELECT app_id, project, group_name, library_name, list(scope ORDER BY seq) AS scopes FROM f_library GROUP BY ALL),
folded AS (SELECT l.*, list_reduce(scopes, lambda a, x: CASE WHEN a = '' THEN x ELSE next[a || '|' || x] END, '') AS scope
  FROM listed l, lookup)
SELECT app_id, project, group_name, library_name, scope FROM folded WHERE scope <> ''""",
    ("library",),
)
def merge_scopes(f):
    # Blocks of the reading order: 64 orders each.
    return build.merge_scopes(f.library, ["app_id", "project"], block=F.shiftright("seq", 30)).drop("seq")


@query(
    "module_names",
    f"""m AS (SELECT {div('p_partkey', 200)} AS app_id, 'modules/svc-' || {text(f"{div('p_partkey', 200)} * 10 + p_partkey % 14")}
  AS directory, p_partkey FROM part), pom AS (SELECT {div('s_suppkey', 10)} AS app_id, 'svc-' || {text('s_suppkey')} AS name FROM supplier)
SELECT m.app_id, directory, p_partkey, min('modules/' || name || '/pom.xml') AS build_file,
  coalesce(arg_min(name, 'modules/' || name || '/pom.xml'), replace(directory, 'modules/', '')) AS artifact_id
FROM m LEFT JOIN pom ON m.app_id = pom.app_id AND starts_with('modules/' || name || '/pom.xml', directory)
GROUP BY m.app_id, directory, p_partkey""",
)
def module_names(f):
    modules = sql(
        f,
        f"SELECT {div('p_partkey', 200)} AS app_id, 'modules/svc-' || "
        f"{text(div('p_partkey', 200) + ' * 10 + p_partkey % 14')} AS directory, p_partkey FROM part",
    )
    return build.module_names(modules, pom.read_pom(pom_files(f)))


@query(
    "classify_modules",
    """x AS (SELECT 1) SELECT m.app_id, m.artifact_id, CASE WHEN EXISTS (SELECT 1 FROM f_library l WHERE l.app_id = m.app_id
  AND l.project = m.artifact_id AND (contains(library_name, 'webflux') OR contains(library_name, 'reactive')
  OR contains(library_name, 'reactor'))) THEN 'SpringWebFlux' ELSE 'SpringMVC' END AS kind FROM f_module m""",
    ("module", "library"),
)
def classify_modules(f):
    return build.classify_modules(f.module, f.library).select("app_id", "artifact_id", "kind")


@query(
    "app_project",
    f"""app AS (SELECT {div('n_nationkey', 4)} AS app_id, count(*) AS n, min(n_name) AS only_name,
  string_agg(n_name || '/pom.xml', ';' ORDER BY n_name || '/pom.xml') AS artifact FROM nation GROUP BY 1)
SELECT app_id, 'app-' || {text('app_id')} AS project, artifact,
  CASE WHEN n = 1 THEN only_name ELSE 'app-' || {text('app_id')} END AS artifact_id FROM app""",
)
def app_project(f):
    files = sql(f, f"SELECT {div('n_nationkey', 4)} AS app_id, n_name || '/pom.xml' AS path, n_name AS artifact_id FROM nation")
    apps = files.select("app_id", F.concat(F.lit("app-"), "app_id").alias("app_name")).distinct()
    return build.app_projects(apps, files)


# --- Java source ------------------------------------------------------------------------------

# Lines of an order are numbered anew: line numbers repeat, and every row is a method.
JAVA_LINE = f"""
SELECT l_orderkey, {LINE_NUMBER} AS l_linenumber, l_partkey AS part, l_suppkey AS supp, l_returnflag AS flag,
  l_linestatus AS status FROM lineitem"""
PROJECT = f"'svc-' || {text(f'o_custkey % {SERVICES}')}"
APP = div(f"(o_custkey % {SERVICES})", 10)


def java_files(f):
    """One class per order, one method per line of the order."""
    lines = sql(f, JAVA_LINE)
    method = F.concat(
        F.lit('  @GetMapping("/m/'), "part", F.lit('") // {\n  public '),
        F.when(F.col("status") == "F", "void").otherwise(F.lit("Page<Item>")), F.lit(" m"), "l_linenumber",
        F.lit("(@Param(\"p\") final Long key, "), F.when(F.col("flag") == "N", "@RequestBody Item").otherwise(F.lit("int")),
        F.lit(" body) {\n    String url = \"http://svc-"), "supp", F.lit(":80/;{\";\n    rest.exchange(url, HttpMethod.PUT);\n"),
        F.when(F.col("flag") == "A", F.lit("    bus.convertAndSend(\"t\", \"q.*\");\n")).otherwise(F.lit("    key.trim();\n")),
        F.lit("    if (body) { return; }\n  }\n"),
    )
    body = lines.groupBy("l_orderkey").agg(
        F.array_join(F.sort_array(F.collect_list(F.struct("l_linenumber", method.alias("m")))).getField("m"), "").alias("body")
    )
    orders = sql(f, f"SELECT o_orderkey, {APP} AS app_id, {PROJECT} AS project, o_orderstatus, o_custkey FROM orders")
    head = F.concat(
        F.lit("package com.acme.o"), "o_orderkey", F.lit(";\nimport org.springframework.web.client.RestTemplate;\n"
              "import com.acme.api.Page;\n/* import no.Such; class X { */\nimport com.acme.base"), "o_custkey",
        F.lit(".Base;\n"), F.when(F.col("o_orderstatus") == "F", "@Slf4j\n").otherwise(F.lit("@RestController\n")),
        F.lit('@RequestMapping(value = "/r/'), "o_custkey", F.lit('", produces = {"a", "b"})\npublic class T'), "o_orderkey",
        F.lit(" extends Base<Item, String> implements Page<Item> {\n  private RestTemplate rest;\n"
              "  private static final String NAME = \"n\";\n"),
    )
    return orders.join(spillable(body), orders.o_orderkey == body.l_orderkey, "left").select(
        "app_id", "project",
        F.concat("project", F.lit("/src/T"), "o_orderkey", F.lit(".java")).alias("path"),
        F.concat(head, F.coalesce("body", F.lit("")), F.lit("}\n")).alias("content"),
    )


def java_parts(f, deepest=None):
    source = java_files(f)
    segments = java.source_segments(source, deepest)
    if deepest != java.TYPE_HEADS:
        # Types, members, calls and local variables all read the segments: parse once. Heads of types are read once anyway.
        segments = written(segments)
    types = java.java_types(segments)
    return source, segments, types


def java_methods_of(f, deepest=None):
    _, segments, types = java_parts(f, deepest)
    # Methods ask several things of a member's text, fields too: mark it once. Only rejected members need their whole text.
    members = written(java.java_members(segments, types).drop("text"))
    return segments, types, members, java.java_methods(members)


JAVA_HEAD = f"""f_line AS ({JAVA_LINE}), f_type AS (SELECT {APP} AS app_id, {PROJECT} AS project, o_orderkey, o_orderstatus,
  o_custkey, 'T' || {text('o_orderkey')} AS type_id FROM orders)"""


@query(
    "java_imports",
    f"""{JAVA_HEAD}
SELECT app_id, project, type_id || '.java' AS file, target_id, target_package FROM (
  SELECT *, 'RestTemplate' AS target_id, 'org.springframework.web.client' AS target_package FROM f_type
  UNION ALL SELECT *, 'Page', 'com.acme.api' FROM f_type
  UNION ALL SELECT *, 'Base', 'com.acme.base' || {text('o_custkey')} FROM f_type) i""",
)
def java_imports(f):
    rows = java.java_imports(java_files(f))
    return rows.select("app_id", "project", F.substring_index("path", "/", -1).alias("file"), "target_id", "target_package")


@query(
    "java_types",
    f"{JAVA_HEAD} SELECT app_id, project, type_id, 'Class' AS kind, 'com.acme.o' || {text('o_orderkey')} AS package FROM f_type",
)
def java_types(f):
    return java_parts(f, java.TYPE_HEADS)[2].select("app_id", "project", "type_id", "kind", "package")


@query(
    "java_supertypes",
    f"""{JAVA_HEAD} SELECT app_id, project, type_id, 'extends' AS relation, 'Base<Item,String>' AS target_id,
  'com.acme.base' || {text('o_custkey')} AS target_package FROM f_type
UNION ALL SELECT app_id, project, type_id, 'implements', 'Page<Item>', 'com.acme.api' FROM f_type""",
)
def java_supertypes(f):
    rows = java.java_supertypes(java_parts(f, java.TYPE_HEADS)[2])
    return rows.select("app_id", "project", "type_id", "relation", "target_id", "target_package")


@query(
    "java_annotations",
    f"""{JAVA_HEAD}, m AS (SELECT t.*, l.* FROM f_type t JOIN f_line l ON o_orderkey = l_orderkey)
SELECT app_id, project, type_id, 'type' AS owner_kind, '' AS owner,
  CASE WHEN o_orderstatus = 'F' THEN 'Slf4j' ELSE 'RestController' END AS annotation_name, NULL AS param_name,
  NULL AS param_value FROM f_type
UNION ALL SELECT app_id, project, type_id, 'type', '', 'RequestMapping', 'value', '"/r/' || {text('o_custkey')} || '"' FROM f_type
UNION ALL SELECT app_id, project, type_id, 'method', 'm' || {text('l_linenumber')}, 'GetMapping', 'NOT_AVAILABLE',
  '"/m/' || {text('part')} || '"' FROM m
UNION ALL SELECT app_id, project, type_id, 'parameter', 'm' || {text('l_linenumber')} || '#1', 'Param', 'NOT_AVAILABLE', '"p"' FROM m
UNION ALL SELECT app_id, project, type_id, 'parameter', 'm' || {text('l_linenumber')} || '#2', 'RequestBody', NULL, NULL
  FROM m WHERE flag = 'N'""",
)
def java_annotations(f):
    _, types, _, methods = java_methods_of(f, java.MEMBER_HEADS)
    keys = ["app_id", "project", "type_id", "owner_kind", "owner", "at", "annotation_name"]
    notes = (
        java.type_annotations(types)
        .select("*", F.lit("type").alias("owner_kind"), F.lit("").alias("owner"))
        .select(*keys, "body")
        .unionByName(
            java.method_annotations(methods)
            .select("*", F.lit("method").alias("owner_kind"), F.col("method_name").alias("owner"))
            .select(*keys, "body")
        )
        .unionByName(
            java.param_annotations(java.method_params(methods))
            .select("*", F.lit("parameter").alias("owner_kind"), F.concat_ws("#", "method_name", "param_order").alias("owner"))
            .select(*keys, "body")
        )
    )
    params = java.annotation_params(notes).drop("param_no")
    return notes.drop("body").join(spillable(params), keys, "left").drop("at")


@query(
    "java_methods",
    f"""{JAVA_HEAD}
SELECT app_id, project, type_id, 'm' || {text('l_linenumber')} AS method_name,
  CASE WHEN status = 'F' THEN NULL ELSE 'Page<Item>' END AS return_type,
  CASE WHEN status = 'F' THEN '' ELSE 'com.acme.api' END AS return_package
FROM f_type JOIN f_line ON o_orderkey = l_orderkey""",
)
def java_methods(f):
    rows = java_methods_of(f, java.MEMBER_HEADS)[3]
    return rows.select("app_id", "project", "type_id", "method_name", "return_type", "return_package")


@query(
    "java_method_params",
    f"""{JAVA_HEAD}
SELECT app_id, project, type_id, 'm' || {text('l_linenumber')} AS method_name, param_order,
  CASE param_order WHEN 1 THEN 'key' ELSE 'body' END AS param_name,
  CASE WHEN param_order = 1 THEN 'Long' WHEN flag = 'N' THEN 'Item' END AS type_name
FROM f_type JOIN f_line ON o_orderkey = l_orderkey JOIN (VALUES (1), (2)) two(param_order) ON true""",
)
def java_method_params(f):
    rows = java.method_params(java_methods_of(f, java.MEMBER_HEADS)[3])
    return rows.select("app_id", "project", "type_id", "method_name", "param_order", "param_name", "type_name")


@query(
    "java_invocations",
    f"""{JAVA_HEAD}
SELECT app_id, project, type_id, 'm' || {text('l_linenumber')} || '()' AS root_method, callee,
  CASE callee WHEN 'exchange' THEN 'RestTemplate' END AS receiver_type,
  CASE callee WHEN 'exchange' THEN 'org.springframework.web.client' END AS receiver_package
FROM f_type JOIN f_line ON o_orderkey = l_orderkey
  JOIN (VALUES ('exchange'), ('convertAndSend'), ('trim')) c(callee)
  ON callee = 'exchange' OR (callee = 'convertAndSend') = (flag = 'A')""",
)
def java_invocations(f):
    segments, types, members, methods = java_methods_of(f)
    calls = java.java_invocations(segments, methods)
    rows = java.resolve_receivers(
        calls, java.method_params(methods), java.java_locals(segments, types), java.java_fields(members)
    )
    return rows.select("app_id", "project", "type_id", "root_method", "callee", "receiver_type", "receiver_package")


@query(
    "java_invocation_args",
    f"""{JAVA_HEAD}
SELECT app_id, project, type_id, 'm' || {text('l_linenumber')} || '()' AS root_method, callee, arg_order, arg_name,
  CASE WHEN arg_name = 'url' THEN '"http://svc-' || {text('supp')} || ':80/;{{"' ELSE arg_value END AS arg_value
FROM f_type JOIN f_line ON o_orderkey = l_orderkey
  JOIN (VALUES ('exchange', 1, 'url', ''), ('exchange', 2, 'HttpMethod.PUT', 'NOT_AVAILABLE'),
    ('convertAndSend', 1, 'NOT_AVAILABLE', '"t"'), ('convertAndSend', 2, 'NOT_AVAILABLE', '"q.*"'))
  c(callee, arg_order, arg_name, arg_value) ON callee = 'exchange' OR flag = 'A'""",
)
def java_invocation_args(f):
    segments, types, members, methods = java_methods_of(f)
    calls = java.java_invocations(segments, methods)
    args = java.invocation_args(calls, java.java_locals(segments, types), java.java_fields(members))
    names = calls.select(*java.KEYS, "type_no", "member_no", "no", "at", "type_id", "root_method", "callee")
    return args.join(spillable(names), [*java.KEYS, "type_no", "member_no", "no", "at"]).select(
        "app_id", "project", "type_id", "root_method", "callee", "arg_order", "arg_name", "arg_value"
    )


NESTED_FILE = f"""
SELECT {div('s_suppkey', 10)} AS app_id, 'svc-' || {text('s_suppkey')} AS project, 'N' || {text('s_suppkey')} || '.java' AS path,
  'class N' || {text('s_suppkey')} || ' {{ public <T extends Comparable<T>> T max' || {text('s_suppkey')}
  || '(Map<String, List<Map<String, List<T>>>> all) {{ one.first(all); }} '
  || 'Mono<ResponseEntity<List<Map<String, Object>>>> mono(' || repeat('List<', CAST(s_suppkey % 20 + 1 AS INT)) || 'Item'
  || repeat('>', CAST(s_suppkey % 20 + 1 AS INT)) || ' all) {{ two.second(all); }} int a, b' || {text('s_suppkey')} || '; }}' AS content
FROM supplier"""


@query(
    "java_nested_members",
    f"""n AS (SELECT {div('s_suppkey', 10)} AS app_id, {text('s_suppkey')} AS k, CAST(s_suppkey % 20 + 1 AS INT) AS deep FROM supplier)
SELECT app_id, 'method' AS kind, 'max' || k AS name, 'T' AS detail FROM n
UNION ALL SELECT app_id, 'method', 'mono', 'Mono<ResponseEntity<List<Map<String,Object>>>>' FROM n
UNION ALL SELECT app_id, 'parameter', 'max' || k, 'Map<String,List<Map<String,List<T>>>>' FROM n
UNION ALL SELECT app_id, 'parameter', 'mono', repeat('List<', deep) || 'Item' || repeat('>', deep) FROM n
UNION ALL SELECT app_id, 'call', 'max' || k || '()', 'first' FROM n
UNION ALL SELECT app_id, 'call', 'mono()', 'second' FROM n
UNION ALL SELECT app_id, 'rejected', 'N' || k, 'int a, b' || k FROM n""",
)
def java_nested_members(f):
    """Methods with bounded type parameters and deep generics, what they take and call, and a member that is not understood."""
    segments = written(java.source_segments(sql(f, NESTED_FILE)))
    types = java.java_types(segments)
    members = written(java.java_members(segments, types))
    methods = java.java_methods(members)
    parts = (
        ("method", methods, "method_name", "return_type"),
        ("parameter", java.method_params(methods), "method_name", "type_name"),
        ("call", java.java_invocations(segments, methods), "root_method", "callee"),
        ("rejected", java.member_rejects(members), "type_id", "text"),
    )
    rows = [df.select("app_id", F.lit(kind).alias("kind"), F.col(name).alias("name"), F.col(detail).alias("detail")) for kind, df, name, detail in parts]
    return reduce(DataFrame.unionByName, rows)


FORM_FILE = f"""
SELECT {div('s_suppkey', 10)} AS app_id, 'svc-' || {text('s_suppkey')} AS project, 'F' || {text('s_suppkey')} || '.java' AS path,
  'class F' || {text('s_suppkey')} || ' {{ @Operation(summary = "please get it") @GetMapping("/x' || {text('s_suppkey')} || '") public X get() {{ '
  || 'two(rest.exchange(' || repeat('u(', CAST(s_suppkey % 9 + 1 AS INT)) || '1' || repeat(')', CAST(s_suppkey % 9 + 1 AS INT))
  || ', HttpMethod.GET), new Map<String, List<Item>>(), "a,(b"); }} public Foo' || chr(10) || chr(9) || 'bar(@RequestBody @Size(max = 3) Item i, int a' || s_nationkey
  || '[], final List<Map<String, A>> all[][]) throws E {{ run(x -> {{ one(i, "p"); two(i); }}, int[].class); }} record R(int x) {{ }} }}' AS content
FROM supplier"""


@query(
    "java_member_forms",
    f"""n AS (SELECT {div('s_suppkey', 10)} AS app_id, {text('s_suppkey')} AS k, {text('s_nationkey')} AS nation FROM supplier)
SELECT app_id, 'method' AS kind, 'get' AS name, 'X' AS detail FROM n
UNION ALL SELECT app_id, 'method', 'bar', 'Foo' FROM n
UNION ALL SELECT app_id, 'annotation', 'get', 'Operation("please get it")' FROM n
UNION ALL SELECT app_id, 'annotation', 'get', 'GetMapping("/x' || k || '")' FROM n
UNION ALL SELECT app_id, 'of parameter', 'i', 'RequestBody' FROM n
UNION ALL SELECT app_id, 'of parameter', 'i', 'Size' FROM n
UNION ALL SELECT app_id, 'parameter', 'i', 'Item' FROM n
UNION ALL SELECT app_id, 'parameter', 'a' || nation, 'int[]' FROM n
UNION ALL SELECT app_id, 'parameter', 'all', 'List<Map<String,A>>[][]' FROM n
UNION ALL SELECT app_id, 'argument', callee || arg_order, shown FROM n, (VALUES ('exchange', '1', 'HttpMethod.GET'), ('two', '1', '"a,(b"'),
  ('one', '1', 'i'), ('one', '2', '"p"'), ('two', '1', 'i')) a(callee, arg_order, shown)
UNION ALL SELECT app_id, 'argument', callee || '1', '1' FROM n, (VALUES ('u')) a(callee)""",
)
def java_member_forms(f):
    """Names inside of annotations, declarations over several lines, records, square brackets behind names, calls in calls."""
    segments = written(java.source_segments(sql(f, FORM_FILE)))
    types = java.java_types(segments)
    members = written(java.java_members(segments, types))
    methods = java.java_methods(members)
    params = java.method_params(methods)
    notes = java.method_annotations(methods)
    calls = java.java_invocations(segments, methods)
    args = java.invocation_args(calls, java.java_locals(segments, types), java.java_fields(members))
    called = args.join(calls.select(*java.KEYS, "type_no", "member_no", "no", "at", "callee"), [*java.KEYS, "type_no", "member_no", "no", "at"])
    note = F.concat("annotation_name", F.lit("("), F.regexp_extract("body", '("[^"]*")', 1), F.lit(")"))
    shown = F.when(F.col("arg_name") != "NOT_AVAILABLE", F.col("arg_name")).otherwise(F.col("arg_value"))
    parts = (
        ("method", methods, F.col("method_name"), F.col("return_type")),
        ("annotation", notes, F.col("method_name"), note),
        ("of parameter", java.param_annotations(params).join(params.select(*java.KEYS, "member_no", "param_order", "param_name"), [*java.KEYS, "member_no", "param_order"]),
         F.col("param_name"), F.col("annotation_name")),
        ("parameter", params, F.col("param_name"), F.col("type_name")),
        ("argument", called, F.concat("callee", "arg_order"), shown),
    )
    rows = [df.select("app_id", F.lit(kind).alias("kind"), name.alias("name"), detail.alias("detail")) for kind, df, name, detail in parts]
    return reduce(DataFrame.unionByName, rows)


# --- model files ------------------------------------------------------------------------------

MODEL = f"""
SELECT '<application ApplicationName="app-' || {text('s_suppkey')} || '"><application_project ProjectArtifactId="p">'
  || '<modules ProjectArtifactId="m"><properties ParentProjectName="m" FullyQualifiedPropertyName="k" PropertyValue="'
  || s_name || '"/><properties ParentProjectName="m" FullyQualifiedPropertyName="l" PropertyValue="2" ConfigurationProfile="DOCKER"/>'
  || '</modules></application_project><containers ContainerName="c" ImageField="mysql:' || {text('s_nationkey')}
  || '"><links LinksDependsOnField="d"/><links LinksDependsOnField="e" DependencyOrder="2"/></containers></application>' AS content
FROM supplier"""


@query(
    "read_model_files",
    f"""m AS (SELECT *, 'app-' || {text('s_suppkey')} AS app_id FROM supplier)
SELECT app_id, 'property' AS fact, CAST(0 AS BIGINT) AS seq, 'k' AS name, s_name AS value, 'global' AS extra FROM m
UNION ALL SELECT app_id, 'property', 1, 'l', '2', 'DOCKER' FROM m
UNION ALL SELECT app_id, 'container', 0, 'c', 'mysql:' || {text('s_nationkey')}, 'false' FROM m
UNION ALL SELECT app_id, 'container_link', 0, 'c', 'd', '1' FROM m
UNION ALL SELECT app_id, 'container_link', 1, 'c', 'e', '2' FROM m""",
)
def read_model_files(f):
    facts = model_file.model_facts(f._spark, model_file.parse_model_texts(sql(f, MODEL)))
    shown = {
        "property": ("name", "value", "profile"),
        "container": ("name", "image", "generates_logs"),
        "container_link": ("container", "target", "dep_order"),
    }
    parts = [
        getattr(facts, fact).select(
            "app_id", F.lit(fact).alias("fact"), "seq", F.col(name).alias("name"), F.col(value).alias("value"),
            F.col(extra).cast("string").alias("extra"),
        )
        for fact, (name, value, extra) in shown.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# {k} and {n} stand for the numbers of a supplier and its nation, in the model and in what has to come out of it.
_JAVA_MODEL = (
    '<application xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance" ApplicationName="app-{k}" ProjectPackageURL="http://p/{n}">'
    '<application_project ProjectArtifactId="p"><modules ParentProjectName="p" ArtifactFileName="pom.xml" ProjectArtifactId="m" xsi:type="PSM:SpringMVCProject">'
    '<libraries ParentProjectName="m" LibraryGroupName="g" LibraryName="lib-{n}" LibraryScope="test"/><layers>'
    '<elements xsi:type="PSM:JavaClassType" ElementIdentifier="Ctrl{k}" PackageName="com.x" ArtifactFileName="C.java">'
    '<annotations AnnotationName="RestController"><parameters ParameterValue="/k{k}"/></annotations>'
    '<methods ElementIdentifier="get{k}()"><annotations AnnotationName="GetMapping"><parameters ParameterName="path" ParameterValue="/n{n}"/></annotations>'
    '<parameters ElementIdentifier="id"><annotations AnnotationName="PathVariable"/><type ElementIdentifier="Long"/></parameters>'
    '<returns ElementIdentifier="Item" PackageName="com.x" JsonSchema="s{n}"/>'
    '<invokes ElementIdentifier="find()"><parent ElementIdentifier="Repo" PackageName="com.r"/><parameters ElementIdentifier="id"/>'
    '<parameters ParameterOrder="2" FieldValue="{n}"/></invokes></methods>'
    '<methods ElementIdentifier="put" ElementProfile="test"><parameters ElementIdentifier="body" ParameterOrder="2"/><invokes RootCallingMethod="all()" ElementIdentifier="save"/></methods>'
    '<extends ElementIdentifier="Base"/><imports ElementIdentifier="List" PackageName="java.util"/><implements ElementIdentifier="Api" PackageName="com.x"/>'
    '</elements><elements xsi:type="PSM:JavaInterfaceType" ElementIdentifier="Api" ElementProfile="test"/></layers></modules></application_project>'
    '<containers ContainerName="c"><ports ExposesPortsField="80:{n}"/></containers></application>'
)
_JAVA_FACTS = {
    "application": ("app-{k}|http://p/{n}",),
    "app_project": ("-|-|p",),
    "container": ("-|-|c|||false",),
    "container_port": ("-|-|c|80:{n}",),
    "module": ("p|pom.xml|m|SpringMVC",),
    "library": ("m|-|g|lib-{n}|test",),
    "java_type": ("m|C.java|0#0#0|Ctrl{k}|com.x|Class|COMPILE|", "m||0#0#1|Api|java.lang|Interface|test|"),
    "java_supertype": (
        "m|C.java|0#0#0|extends|Base|java.lang|COMPILE", "m|C.java|0#0#0|implements|Api|com.x|COMPILE", "m|C.java|0#0#0|imports|List|java.util|COMPILE",
    ),
    "java_annotation": (
        "m|C.java|type|0#0#0|type@0#0#0@0|RestController|COMPILE", "m|C.java|method|0#0#0#0|method@0#0#0#0@0|GetMapping|COMPILE",
        "m|C.java|parameter|0#0#0#0#1|parameter@0#0#0#0#1@0|PathVariable|COMPILE",
    ),
    "annotation_param": ("type@0#0#0@0|value|/k{k}", "method@0#0#0#0@0|path|/n{n}"),
    "java_method": ("m|C.java|0#0#0|0#0#0#0|get{k}|Item|com.x|s{n}|COMPILE", "m|C.java|0#0#0|0#0#0#1|put|-|-|-|test"),
    "method_param": ("0#0#0#0|0#0#0#0#1|1|id|Long|java.lang|", "0#0#0#1|0#0#0#1#1|2|body|-|-|-"),
    "java_invocation": ("m|C.java|0#0#0#0|0#0#0#0#0|get{k}()|find|Repo|com.r|COMPILE", "m|C.java|0#0#0#1|0#0#0#1#0|all()|save|-|-|test"),
    "invocation_arg": ("0#0#0#0#0|1|id|NOT_APPLICABLE", "0#0#0#0#0|2|NOT_AVAILABLE|{n}"),
}


def _of_supplier(template: str) -> str:
    return f"replace(replace({template}, '{{k}}', {text('s_suppkey')}), '{{n}}', {text('s_nationkey')})"


@query(
    "read_model_java",
    f"""v(fact, made) AS (VALUES {", ".join(f"('{fact}', '{made}')" for fact, rows in _JAVA_FACTS.items() for made in rows)})
SELECT 'app-' || {text('s_suppkey')} AS app_id, fact, {_of_supplier('made')} AS row FROM supplier, v""",
)
def read_model_java(f):
    """Every fact of model files with Java elements, without the positions that only order them."""
    texts = sql(f, "SELECT " + _of_supplier("'" + _JAVA_MODEL + "'") + " AS content FROM supplier")
    tables = model_file.model_facts(f._spark, cut_lineage(model_file.parse_model_texts(texts))).tables()
    parts = []
    for fact, df in tables.items():
        columns = [name for name in fact_schema(fact).names if name not in ("app_id", "seq")]
        row = F.concat_ws("|", *[F.coalesce(F.col(name).cast("string"), F.lit("-")) for name in columns])
        parts.append(df.select("app_id", F.lit(fact).alias("fact"), row.alias("row")))
    return reduce(DataFrame.unionByName, parts)


# --- whole extraction -------------------------------------------------------------------------

_LIBRARY = f"'lib-' || {text('s_nationkey')}"
FLEET_FILE = f"""
{MODULE_FILE}
UNION ALL SELECT {div('s_suppkey', 10)}, {_SVC} || '/pom.xml', '<project><artifactId>' || {_SVC} || '</artifactId><dependencies><dependency>'
  || '<groupId>g</groupId><artifactId>' || {_LIBRARY} || '</artifactId></dependency></dependencies></project>' FROM supplier
UNION ALL SELECT {div('s_suppkey', 10)}, {_SVC} || '/src/main/java/T.java', 'class T<A extends B> extends C {{ void m' || {text('s_suppkey')}
  || '() {{ if (rest.exchange(wrap("u-' || {text('s_suppkey')} || '"), HttpMethod.GET) != null) {{ log.info(first(second(1))); }} }} }}' FROM supplier"""


def fleet_files(f):
    """Configuration, build and Java files of every supplier, and one compose file per application."""
    service = F.concat(
        F.lit("  svc-"), "s_suppkey", F.lit(":\n    image: acme/"), "s_nationkey", F.lit(":1\n    ports:\n      - \""),
        (F.col("s_suppkey") % 7 + 8000).cast("string"), F.lit(":80\"\n"),
    )
    compose = (
        sql(f, f"SELECT *, {div('s_suppkey', 10)} AS app_id FROM supplier")
        .groupBy("app_id")
        .agg(F.array_join(F.sort_array(F.collect_list(F.struct("s_suppkey", service.alias("text")))).getField("text"), "").alias("body"))
        .select("app_id", F.lit("compose.yaml").alias("path"), F.concat(F.lit("version: '2'\nservices:\n"), "body").alias("content"))
    )
    return sql(f, FLEET_FILE).unionByName(compose)


FLEET_FACT = f"""f_own AS ({MODULE_PROPERTY}), f_port AS (
  SELECT {div('s_suppkey', 10)} AS app_id, {_PORT} AS port, max(s_suppkey) AS last FROM supplier GROUP BY 1, 2)
SELECT {div('s_suppkey', 10)} AS app_id, 'container' AS kind, {_SVC} AS name, 'acme/' || {text('s_nationkey')} || ':1' AS detail FROM supplier
UNION ALL SELECT {div('s_suppkey', 10)}, 'port', {_SVC}, {_PORT} || ':80' FROM supplier
UNION ALL SELECT {div('s_suppkey', 10)}, 'module', {_SVC}, 'SpringMVC' FROM supplier
UNION ALL SELECT {div('s_suppkey', 10)}, 'library', {_SVC}, {_LIBRARY} FROM supplier
UNION ALL SELECT {div('s_suppkey', 10)}, 'extends', {_SVC}, 'C' FROM supplier
UNION ALL SELECT {div('s_suppkey', 10)}, 'call', 'm' || {text('s_suppkey')} || '()', callee
  FROM supplier CROSS JOIN (VALUES ('exchange'), ('wrap'), ('info'), ('first'), ('second')) calls(callee)
UNION ALL SELECT o.app_id, 'property', module, name || '=' || profile || '=' ||
  CASE WHEN name = 'url' THEN 'http://svc-' || {text('last')} || '/a' ELSE value END
  FROM f_own o LEFT JOIN f_port p ON o.app_id = p.app_id AND contains(value, 'localhost:' || port)
UNION ALL SELECT {div('m.s_suppkey', 10)}, 'property', 'svc-' || {text('m.s_suppkey')},
  'shared=COMPILE=' || replace(m.s_name, '#', '-') || '/' || {text('8000 + m.s_suppkey % 7')}
  FROM supplier m JOIN supplier c ON {div('m.s_suppkey', 10)} = {div('c.s_suppkey', 10)}"""


def fleet_facts(f):
    apps = sql(f, f"SELECT DISTINCT {div('s_suppkey', 10)} AS app_id, 'fleet' AS app_name, '/src' AS package_url FROM supplier")
    dirs = apps.select("app_id", F.lit("central/").alias("config_dir"))
    return extract(cut_lineage(fleet_files(f)), apps, dirs)


@query("extract", FLEET_FACT)
def extract_fleet(f):
    """Facts of every kind that the files of a fleet give."""
    facts, _ = fleet_facts(f)
    parts = (
        ("container", facts.container, "name", F.col("image")),
        ("port", facts.container_port, "container", F.col("port")),
        ("module", facts.module, "artifact_id", F.col("kind")),
        ("library", facts.library, "project", F.col("library_name")),
        ("extends", facts.java_supertype, "project", F.col("target_id")),
        ("call", facts.java_invocation, "root_method", F.col("callee")),
        ("property", facts.property, "project", F.concat_ws("=", "name", "profile", "value")),
    )
    rows = [df.select("app_id", F.lit(kind).alias("kind"), F.col(name).alias("name"), detail.alias("detail")) for kind, df, name, detail in parts]
    return reduce(DataFrame.unionByName, rows)


CIRCLE = f"""
SELECT {div('p_partkey', 200)} AS app_id, CAST(0 AS INT) AS doc_order, p_partkey AS pos_order, 'k' || {text('p_partkey % 200')} AS name,
  CASE WHEN p_partkey % 200 < 24 THEN {OPEN} || 'k' || {text('p_partkey % 200 + 1')} || {SHUT} || '-'
    WHEN p_partkey % 200 = 50 THEN {OPEN} || 'k51' || {SHUT} WHEN p_partkey % 200 = 51 THEN 'a' || {OPEN} || 'k50' || {SHUT}
    WHEN p_partkey % 200 > 150 THEN {OPEN} || 'k51' || {SHUT} || {OPEN} || 'k24' || {SHUT} ELSE 'end' END AS value
FROM part"""


@query(
    "deep_placeholders",
    f"""f_p AS ({CIRCLE}) SELECT pos_order, CASE WHEN pos_order % 200 < 24 AND last >= 24
    THEN 'end' || repeat('-', CAST(24 - pos_order % 200 AS BIGINT)) ELSE value END AS value
  FROM f_p JOIN (SELECT app_id AS app, max(pos_order % 200) AS last FROM f_p GROUP BY app_id) ends ON app = app_id""",
)
def deep_placeholders(f):
    """References 24 levels deep, and values that lead into a circle, which stay as they were."""
    return config_ops.resolve_placeholders(sql(f, CIRCLE), ["app_id"])[0].select("pos_order", "value")


@query(
    "circular_placeholders",
    f"f_p AS ({CIRCLE}) SELECT pos_order, value FROM f_p WHERE pos_order % 200 IN (50, 51) OR pos_order % 200 > 150",
)
def circular_placeholders(f):
    return config_ops.resolve_placeholders(sql(f, CIRCLE), ["app_id"])[1].select("pos_order", "value")


CHAIN = f"""
SELECT {div('p_partkey', 1000)} AS app_id, CAST(0 AS INT) AS doc_order, p_partkey AS pos_order, 'k' || {text('p_partkey % 1000')} AS name,
  CASE WHEN p_partkey % 1000 < 999 THEN {OPEN} || 'k' || {text('p_partkey % 1000 + 1')} || {SHUT} || '-' ELSE p_name END AS value
FROM part"""


@query(
    "placeholder_chains",
    f"""f_p AS ({CHAIN}) SELECT pos_order,
  CASE WHEN last = 999 THEN ending || repeat('-', CAST(999 - pos_order % 1000 AS BIGINT))
    ELSE {OPEN} || 'k' || {text('last + 1')} || {SHUT} || repeat('-', CAST(last + 1 - pos_order % 1000 AS BIGINT)) END AS value
  FROM f_p JOIN (SELECT app_id AS app, max(pos_order % 1000) AS last, arg_max(value, pos_order % 1000) AS ending FROM f_p GROUP BY app_id) ends
    ON app = app_id""",
)
def placeholder_chains(f):
    """Chains of a thousand references; a chain that breaks off keeps the name that nobody defines."""
    return config_ops.resolve_placeholders(sql(f, CHAIN), ["app_id"])[0].select("pos_order", "value")

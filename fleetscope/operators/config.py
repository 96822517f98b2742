"""Properties of every module: which files count, placeholders, and host names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetscope import rules
from fleetscope.functions.graph import connected, ending_nodes
from fleetscope.functions.matching import join_contains
from fleetscope.functions.runtime import cut_lineage, shuffled, written
from fleetscope.sources import config
from fleetscope.sources.files import directory, exclude_test_sources, file_name

MODULE = ["app_id", "module"]
# Which texts count as names and defaults; other placeholders stay as they are. A name is dotted; one without
# default may also have dashes and an opened index. A default has no dots, dashes or slashes. The plus sign belongs to each,
# so that values with it resolve as they always have.
_NAME, _DEFAULT, _BARE_NAME = r"\w[\w.+]*", r"\w[:\w+]*", r"\w[\w.+\[\-]*"
_DEFAULTED = rf"\$\{{({_NAME}):({_DEFAULT})\}}"
_REFERENCE = rf"\$\{{({_BARE_NAME})\}}"
MODULE_PHASES = ((0, "application"), (1, "bootstrap"))
CENTRAL_PHASES = ((2, "application"),)
NAMED_PHASE = 3


def _config_files(files: DataFrame) -> DataFrame:
    wanted = reduce(lambda one, other: one | other, [F.col("path").endswith(end) for end in rules.CONFIG_EXTENSIONS])
    return exclude_test_sources(files).where(wanted).withColumn("directory", directory(F.col("path")))


def module_config_files(
    files: DataFrame, modules: DataFrame, config_dirs: DataFrame, app_names: DataFrame | None = None
) -> DataFrame:
    """(path, module, phase, app_name) for every configuration file a module reads, in reading order.

    ``modules`` has (app_id, module), ``config_dirs`` (app_id, config_dir), ``app_names`` (app_id,
    module, app_name). A directory counts if it contains the module's name or the configured text.
    Paths only: contents are parsed once and joined to this map by path.
    """
    paths = _config_files(files).select("app_id", "path", "directory")
    directories = paths.select("app_id", "directory").distinct()

    def phases(rows: DataFrame, wanted) -> DataFrame:
        parts = [rows.where(file_name(F.col("path")).contains(part)).withColumn("phase", F.lit(phase)) for phase, part in wanted]
        return reduce(DataFrame.unionByName, parts)

    no_name = F.lit("").alias("app_name")
    owners = join_contains(directories, "directory", modules.select(*MODULE), "module", ["app_id"])
    own = phases(paths, MODULE_PHASES).join(owners, ["app_id", "directory"]).select(*MODULE, "path", "phase", no_name)

    wanted = join_contains(directories, "directory", config_dirs.select("app_id", "config_dir"), "config_dir", ["app_id"])
    # A row for each configured text that the directory contains, as before.
    central = paths.join(wanted, ["app_id", "directory"])
    shared = phases(central, CENTRAL_PHASES).join(modules.select(*MODULE), "app_id")
    parts = [own, shared.select(*MODULE, "path", "phase", no_name)]
    if app_names is not None:
        bases = central.select("app_id", "path").withColumn("base", file_name(F.col("path")))
        names = app_names.select(*MODULE, "app_name").where(F.col("app_name") != "")
        by_name = join_contains(bases, "base", names, "app_name", ["app_id"])
        parts.append(by_name.select(*MODULE, "path", F.lit(NAMED_PHASE).alias("phase"), "app_name"))
    return reduce(DataFrame.unionByName, parts)


def apply_placeholder_defaults(value: Column, compat_defaults: bool = False) -> Column:
    """``${key:default}`` -> default, from the inside out; the default wins over a defined key.

    ``compat_defaults`` puts the first default of a round in every place of that round.
    """
    rounds = F.regexp_count(value, F.lit(r"\$\{"))

    def once(text: Column, _: Column) -> Column:
        if compat_defaults:
            return F.regexp_replace(text, F.lit(_DEFAULTED), F.regexp_extract(text, _DEFAULTED, 2))
        return F.regexp_replace(text, _DEFAULTED, "$2")

    return F.when(rounds > 0, F.aggregate(F.sequence(F.lit(1), rounds), value, once)).otherwise(value)


def _references(text: Column | str) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(_REFERENCE), F.lit(1)))


def _filled(text: str, found: str) -> Column:
    """``text`` with every reference of ``found`` (ref, text) replaced; bounded by the references of one value."""
    return F.aggregate(
        found, F.col(text), lambda value, one: F.replace(value, F.concat(F.lit("$"), F.lit("{"), one["ref"], F.lit("}")), one["text"])
    )


def _named_texts(asking: DataFrame, properties: DataFrame, keys: list[str]) -> DataFrame:
    """(document, ref, text) for every name that a value of the document may reach through other values.

    Names of a module that refer to each other form a group. A document that asks for a name gets the texts of its whole
    group at once, so nothing is followed step by step; most names refer to nothing and are a group of their own.
    """
    document = [*keys, "doc_order"]
    wanted = written(properties.select(*keys, F.explode(_references("value")).alias("ref")).distinct())
    named = written(properties.withColumnRenamed("name", "ref").join(shuffled(wanted), [*keys, "ref"], "left_semi"))
    links = named.select(*keys, F.col("ref").alias("node"), F.explode(_references("value")).alias("to")).distinct()
    groups = connected(links, keys).withColumnRenamed("node", "ref")
    near = named.groupBy(*document, "ref").agg(F.min_by("value", "pos_order").alias("near"))
    far = named.groupBy(*keys, "ref").agg(F.min_by("value", F.struct("doc_order", "pos_order")).alias("far"))
    asked = asking.select(*document, F.explode(_references("value")).alias("ref")).distinct()
    inside = asked.join(shuffled(groups), [*keys, "ref"]).select(*document, "group").distinct()
    reached = written(asked.unionByName(inside.join(shuffled(groups), [*keys, "group"]).select(*document, "ref")).distinct())
    texts = reached.join(shuffled(near), [*document, "ref"], "left").join(shuffled(far), [*keys, "ref"], "left")
    return texts.select(*document, "ref", F.coalesce("near", "far").alias("text")).where("text IS NOT NULL")


def _settled_texts(texts: DataFrame, document: list[str]) -> DataFrame:
    """The texts whose references all lead to an end, filled in. What is left out runs into a circle.

    Every round fills the references of a text with what the texts that they name are so far: a text reaches twice as deep
    after it, and ``edges`` lead twice as far. Without circles they come to an end.
    """
    node = [*document, "ref"]
    known = texts.select(*document, F.col("ref").alias("to"))
    edges = written(texts.select(*node, F.explode(_references("text")).alias("to")).join(shuffled(known), [*document, "to"], "left_semi"))
    _, endless = ending_nodes(edges.withColumnRenamed("ref", "node"), document)
    endless = endless.withColumnRenamed("node", "ref")
    endless = shuffled(endless)
    now, edges = written(texts.join(endless, node, "left_anti")), written(edges.join(endless, node, "left_anti"))
    while not edges.isEmpty():
        filling = now.select(*document, F.col("ref").alias("to"), F.col("text").alias("filled"))
        # The references of one text: bounded by the text itself.
        one = F.struct(F.col("to").alias("ref"), F.col("filled").alias("text"))
        found = edges.join(shuffled(filling), [*document, "to"]).groupBy(*node).agg(F.collect_list(one).alias("found"))
        text = F.when(F.col("found").isNull(), F.col("text")).otherwise(_filled("text", "found"))
        now = written(now.join(shuffled(found), node, "left").select(*node, text.alias("text")))
        further = edges.select(*document, F.col("ref").alias("to"), F.col("to").alias("further"))
        edges = written(edges.join(shuffled(further), [*document, "to"]).select(*node, F.col("further").alias("to")).distinct())
    return now


def resolve_placeholders(properties: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """``${name}`` -> value of that property: first of the same document, else first of the module.

    ``properties`` has ``keys``, doc_order, pos_order, name and value; (keys, doc_order, pos_order) is unique. Returns
    (properties, rejected). Names are followed as deep as they lead, in rounds that grow with the logarithm of the depth, and
    only over names that are referred to. Values that lead into a circle are rejected and stay as they were; names that nobody
    defines stay in the text.
    """
    document = [*keys, "doc_order"]
    row = [*document, "pos_order"]
    properties = written(properties)
    asking = properties.where(F.col("value").rlike(_REFERENCE)).select(*row, "value")
    texts = written(_named_texts(asking, properties, keys))
    settled = written(_settled_texts(texts, document))
    references = asking.select(*row, F.explode(_references("value")).alias("ref"))
    answers = (
        references.join(shuffled(texts.select(*document, "ref", F.lit(True).alias("known"))), [*document, "ref"])
        .join(shuffled(settled), [*document, "ref"], "left")
        .groupBy(*row)
        # The references of one value: bounded by the value itself.
        .agg(F.bool_or(F.col("text").isNull()).alias("circular"), F.collect_list(F.struct("ref", "text")).alias("found"))
    )
    answers = written(answers)
    out = properties.join(shuffled(answers.where(~F.col("circular"))), row, "left")
    out = out.withColumn("value", F.when(F.col("found").isNotNull(), _filled("value", "found")).otherwise(F.col("value")))
    return out.select(*properties.columns), properties.join(shuffled(answers.where("circular").select(*row)), row, "left_semi")


def resolve_localhost(properties: DataFrame, container_ports: DataFrame, keys: list[str]) -> DataFrame:
    """``localhost:<port>`` -> the last container with a port text that contains the first such port.

    ``container_ports`` has app_id, container, port and ord; ``keys`` identify a property.
    """
    port = F.regexp_extract("value", r"localhost:(\d+)", 1)
    with_port = F.col("value").rlike(r"localhost:\d")
    ported = properties.where(with_port).withColumn("wanted_port", port)
    wanted = ported.select("app_id", "wanted_port").distinct()
    hosts = (
        join_contains(container_ports, "port", wanted, "wanted_port", ["app_id"])
        .groupBy("app_id", "wanted_port")
        .agg(F.max_by("container", "ord").alias("host"))
    )
    replaced = F.regexp_replace(F.col("value"), F.lit(r"localhost:\d+"), F.col("host"))
    changed = ported.join(hosts, ["app_id", "wanted_port"], "left").withColumn("value", F.coalesce(replaced, "value"))
    return changed.select(*properties.columns).unionByName(properties.where(~F.coalesce(with_port, F.lit(False))))


def host_by_server_port(ports: DataFrame, properties: DataFrame) -> DataFrame:
    """(app_id, port) -> the first module whose ``server.port`` contains the port."""
    servers = properties.where(F.col("name") == "server.port").select(
        "app_id", "project", "seq", F.col("value").alias("server_port")
    )
    wanted = ports.select("app_id", "port").distinct()
    return (
        join_contains(servers, "server_port", wanted, "port", ["app_id"])
        .groupBy("app_id", "port")
        .agg(F.min_by("project", F.struct("seq", "project")).alias("host"))
    )


def collect_module_properties(
    files: DataFrame, modules: DataFrame, config_dirs: DataFrame, container_ports: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """All steps from files to the property table; (properties, rejected placeholders).

    Every file is parsed once; its properties, not its content, meet the modules that read it.
    """
    parsed = cut_lineage(config.file_rows(config.config_lines(_config_files(files).select("app_id", "path", "content"))))

    def read(found: DataFrame) -> DataFrame:
        return config.with_start_profile(parsed.join(found, ["app_id", "path"]))

    first = module_config_files(files, modules, config_dirs).where(F.col("phase") <= 1)
    named = config.application_name(read(first), MODULE)
    every = module_config_files(files, modules, config_dirs, named)
    rows = read(every).withColumn("value", apply_placeholder_defaults(F.col("value")))
    ordered = rows.withColumn("doc_order", F.struct("phase", "path", "doc")).withColumn("pos_order", F.col("pos"))
    resolved, rejected = resolve_placeholders(ordered, MODULE)
    hosted = resolve_localhost(resolved, container_ports, [*MODULE, "doc_order", "pos_order"])
    return hosted, rejected

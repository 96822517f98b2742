"""From artifact files to fact tables, for all applications at once.

Files are rows (app_id, path, content) with paths relative to the application's root.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetscope.functions.matching import join_contains
from fleetscope.functions.ordering import position
from fleetscope.functions.runtime import cut_lineage
from fleetscope.operators import build, config, deploy
from fleetscope.schema import Facts
from fleetscope.sources import java
from fleetscope.sources.compose import compose_entries, read_dockerfiles, rejected_services, services_of
from fleetscope.sources.files import CONFIG_NAMES, compose_candidates, directory, discover_modules, scan_artifacts, validate_app_inputs
from fleetscope.sources.pom import pom_dependencies, read_pom


def file_numbers(files: DataFrame) -> DataFrame:
    """(app_id, path, file_no): the files of an application in the order of their paths."""
    in_order = Window.partitionBy("app_id").orderBy("path")
    return files.select("app_id", "path").distinct().withColumn("file_no", F.row_number().over(in_order))


def owned_files(files: DataFrame, modules: DataFrame) -> DataFrame:
    """``files`` with the ``project`` whose name their directory contains, once for each such module.

    Directories, not contents, are compared with the names; contents move once, to their modules.
    """
    placed = files.select("app_id", "path", directory(F.col("path")).alias("directory"))
    directories = placed.select("app_id", "directory").distinct()
    named = join_contains(directories, "directory", modules, "module", ["app_id"]).withColumnRenamed("module", "project")
    owners = cut_lineage(placed.join(named, ["app_id", "directory"]).select("app_id", "path", "project"))
    return files.join(owners, ["app_id", "path"])


# Bits of a position: files of an application, and segments, members or lines of a file, and what is inside those.
_FILE, _PART, _INNER = 21, 20, 12


def java_facts(files: DataFrame, modules: DataFrame) -> tuple[dict[str, DataFrame], DataFrame, DataFrame]:
    """Java fact tables, the files without a recognised type, and the member heads that are not understood.

    ``modules`` has (app_id, module).
    """
    sources = files.where(F.col("path").endswith(".java"))
    numbers = cut_lineage(file_numbers(sources))
    owned = owned_files(sources, modules)

    def seq(part: Column | str, inner: Column | str | None = None) -> Column:
        columns = [F.col(one) if isinstance(one, str) else one for one in (part, inner) if one is not None]
        widths = (_PART, _INNER) if len(columns) == 2 else (_PART + _INNER,)
        return position((F.col("file_no"), _FILE), *zip(columns, widths, strict=True)).alias("seq")

    def numbered(rows: DataFrame) -> DataFrame:
        return rows.join(numbers, ["app_id", "path"])

    segments = cut_lineage(java.source_segments(owned))
    types = cut_lineage(java.java_types(segments))
    members = cut_lineage(java.java_members(segments, types))
    methods = cut_lineage(java.java_methods(members))
    params = java.method_params(methods)
    calls = cut_lineage(java.java_invocations(segments, methods))
    fields, local_rows = java.java_fields(members), java.java_locals(segments, types)

    profile = F.lit("COMPILE").alias("profile")
    artifact = F.col("path").alias("artifact")
    type_key = F.concat_ws("#", "project", "path", "type_no")
    method_key = F.concat(type_key, F.lit("#"), F.col("member_no").cast("string"))
    head = ["app_id", "project", artifact]
    type_rows = numbered(types).select(
        *head, seq("type_no"), type_key.alias("type_key"), "type_id", "package", "kind", profile,
        F.lit("").alias("json_schema"),
    )
    supertypes = numbered(java.java_supertypes(types)).select(
        *head, seq("type_no", "at"), type_key.alias("type_key"), "relation", "target_id",
        "target_package", profile,
    )
    imports = (
        numbered(java.java_imports(owned))
        .join(types.select(*java.KEYS, "type_no"), java.KEYS)
        .select(
            *head, seq("type_no", "no"), type_key.alias("type_key"),
            F.lit("imports").alias("relation"), "target_id", "target_package", profile,
        )
    )
    notes = reduce(
        lambda one, other: one.unionByName(other),
        (
            java.type_annotations(types)
            .select("*", F.lit("type").alias("owner_kind"), type_key.alias("owner_key"), F.lit(0).alias("member"), F.lit(0).alias("argument"))
            .drop("type_id"),
            java.method_annotations(methods)
            .select(
                "*", F.lit("method").alias("owner_kind"), method_key.alias("owner_key"), F.col("member_no").alias("member"), F.lit(0).alias("argument")
            )
            .drop("type_id", "member_no", "method_name"),
            java.param_annotations(params)
            .select(
                "*", F.lit("parameter").alias("owner_kind"), F.concat_ws("#", method_key, "param_order").alias("owner_key"),
                F.col("member_no").alias("member"), F.col("param_order").alias("argument"),
            )
            .drop("type_id", "member_no", "method_name", "param_order"),
        ),
    ).withColumn("annotation_key", F.concat_ws("@", "owner_kind", "owner_key", "at"))
    # Annotations are numbered through the whole file: by member (types have none), argument, and place in front of it.
    annotations = numbered(notes).select(
        *head, seq(F.col("type_no") + F.col("member"), F.col("argument") * 32 + F.col("at")), "owner_kind", "owner_key", "annotation_key",
        "annotation_name", profile,
    )
    notes = notes.drop("type_no", "member", "argument")
    annotation_params = java.annotation_params(notes).select(
        "app_id", F.col("param_no").cast("long").alias("seq"), "annotation_key", "param_name", "param_value"
    )
    method_rows = numbered(methods).select(
        *head, seq("member_no", F.lit(0)), type_key.alias("type_key"), method_key.alias("method_key"),
        "method_name", "return_type", "return_package",
        F.when(F.col("return_type").isNotNull(), "").alias("return_schema"), profile,
    )
    param_rows = params.select(
        "app_id", F.col("param_order").cast("long").alias("seq"), method_key.alias("method_key"),
        F.concat_ws("#", method_key, "param_order").alias("param_key"), "param_order", "param_name", "type_name",
        "type_package", F.when(F.col("type_name").isNotNull(), "").alias("json_schema"),
    )
    call_key = F.concat_ws("#", method_key, "no", "at")
    resolved = java.resolve_receivers(calls, params, local_rows, fields)
    invocations = numbered(resolved).select(
        *head, seq("no", "at"), method_key.alias("method_key"),
        call_key.alias("invocation_key"), "root_method", "callee", "receiver_type", "receiver_package", profile,
    )
    args = java.invocation_args(calls, local_rows, fields).select(
        "app_id", F.col("arg_order").cast("long").alias("seq"), call_key.alias("invocation_key"), "arg_order", "arg_name", "arg_value"
    )
    return {
        "java_type": type_rows, "java_supertype": supertypes.unionByName(imports), "java_annotation": annotations,
        "annotation_param": annotation_params, "java_method": method_rows, "method_param": param_rows,
        "java_invocation": invocations, "invocation_arg": args,
    }, java.rejects(owned, types), java.member_rejects(members)


def extract(
    files: DataFrame,
    apps: DataFrame,
    config_dirs: DataFrame,
    compose_files: DataFrame | None = None,
    module_dirs: DataFrame | None = None,
) -> tuple[Facts, dict[str, DataFrame]]:
    """(facts, rejected rows by kind). ``apps`` has app_id, app_name, package_url; ``config_dirs`` app_id, config_dir.

    ``compose_files`` (app_id, path) are the chosen compose files, by default all with a usual name;
    ``module_dirs`` (app_id, directory) the chosen module directories, by default those below the root
    that are named like a container.
    """
    spark = files.sparkSession
    named = apps.select("app_id", F.col("app_name").alias("project"))
    chosen = compose_candidates(files) if compose_files is None else files.join(compose_files, ["app_id", "path"], "left_semi")
    entries = cut_lineage(compose_entries(chosen))
    compose = services_of(entries)
    merged, file_ports = deploy.dockerfile_overlay(deploy.merge_containers(compose), read_dockerfiles(files))
    merged = cut_lineage(merged)
    containers = merged.join(named, "app_id").select(
        "app_id", F.col("ord.pos").cast("long").alias("seq"), "project", "artifact", F.col("container").alias("name"), "image", "build", "generates_logs"
    )
    listed_ports = deploy.container_ports(compose).select(
        "app_id", "container", "port", F.struct(F.lit(0).alias("later"), F.col("ord.pos").alias("pos"), F.col("ord.at").alias("at")).alias("ord")
    )
    exposed = file_ports.select(
        "app_id", "container", "port", F.struct(F.lit(1).alias("later"), F.col("line_no").alias("pos"), F.lit(0).alias("at")).alias("ord")
    )
    every_port = listed_ports.unionByName(exposed)
    owner = merged.select("app_id", "container", "artifact").join(named, "app_id")
    ports = every_port.join(owner, ["app_id", "container"]).select(
        "app_id", position((F.col("ord.later"), 1), (F.col("ord.pos"), 32), (F.col("ord.at"), 20)).alias("seq"),
        "project", "artifact", "container", "port",
    )
    links = deploy.container_links(compose).join(owner, ["app_id", "container"]).select(
        "app_id", F.col("dep_order").cast("long").alias("seq"), "project", "artifact", "container", "dep_order", "target"
    )

    poms = cut_lineage(read_pom(scan_artifacts(files, "pom.xml")))
    found = discover_modules(containers, files) if module_dirs is None else module_dirs
    modules = cut_lineage(
        build.module_names(found.select("app_id", "directory"), poms).withColumnRenamed("build_file", "artifact")
    )
    every_library, deep = build.library_effects(poms, pom_dependencies(poms))
    owned = every_library.join(
        modules.select("app_id", F.col("artifact").alias("path"), F.col("artifact_id").alias("project")), ["app_id", "path"]
    )
    # Ranks the distinct libraries of one module.
    in_order = Window.partitionBy("app_id", "project").orderBy("place", "group_name", "library_name")
    libraries = owned.select(
        "app_id", F.row_number().over(in_order).cast("long").alias("seq"), "project", F.lit("pom.xml").alias("artifact"), "group_name", "library_name", "scope"
    )
    keys = modules.select("app_id", F.col("artifact_id").alias("module"))
    host_ports = every_port.join(merged.select("app_id", "container", F.col("ord").alias("first")), ["app_id", "container"]).select(
        "app_id", "container", "port", F.struct("first", "ord").alias("ord")
    )
    rows, circular = config.collect_module_properties(files, keys, config_dirs, host_ports)
    config_numbers = file_numbers(files.where(F.col("path").rlike(CONFIG_NAMES)))
    properties = rows.join(config_numbers, ["app_id", "path"]).select(
        "app_id", position((F.col("phase"), 2), (F.col("file_no"), _FILE), (F.col("pos"), 30)).alias("seq"),
        F.col("module").alias("project"), F.col("path").alias("artifact"), "name", "value", "profile",
    )
    project = build.app_projects(apps, poms.where(F.col("path") == "pom.xml")).withColumn("seq", F.lit(0).cast("long"))
    kinds = build.classify_modules(modules.select("app_id", "artifact", "artifact_id"), libraries)
    java_tables, unread, odd_members = java_facts(files, keys)
    facts = Facts.of(
        spark,
        {
            "application": apps.select("app_id", F.lit(0).cast("long").alias("seq"), "app_name", "package_url"),
            "app_project": project,
            "container": containers,
            "container_port": ports,
            "container_link": links,
            "module": kinds.join(named, "app_id").withColumn("seq", F.row_number().over(Window.partitionBy("app_id").orderBy("artifact_id", "artifact")).cast("long")),
            "library": libraries,
            "property": properties,
            **java_tables,
        },
        app_type=dict(files.dtypes)["app_id"],
    )
    inputs = (
        apps.select("app_id", F.col("app_name").alias("name"), F.lit(".").alias("root"), F.lit(".").alias("output"))
        .join(chosen.groupBy("app_id").agg(F.count("*").alias("compose_files")), "app_id", "left")
        .join(found.groupBy("app_id").agg(F.count("*").alias("module_dirs")), "app_id", "left")
    )
    return facts, {
        "applications": validate_app_inputs(inputs).where(F.size("reasons") > 0).select("app_id", "reasons"),
        "build_files": deep,
        "compose_services": rejected_services(entries),
        "compose_files": chosen.select("app_id", "path").join(compose.select("app_id", "path"), ["app_id", "path"], "left_anti"),
        "java_files": unread,
        "java_members": odd_members,
        "placeholders": circular,
        "poms": poms.where("artifact_id IS NULL").select("app_id", "path"),
    }


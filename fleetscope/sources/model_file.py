"""Model files (one XML document per application) as fact tables.

The serialiser leaves out values that equal the declared default, so they are filled in here.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetscope import rules, schema
from fleetscope.functions.ordering import position
from fleetscope.schema import Facts

_OWNED = "_ParentProjectName string, _ArtifactFileName string"


def _attributes(*names: str) -> str:
    return ", ".join(f"_{name} string" for name in names)


_PROPERTY = f"struct<{_attributes('ParentProjectName', 'ArtifactFileName', 'FullyQualifiedPropertyName', 'PropertyValue', 'ConfigurationProfile')}>".replace(" string", ":string")
_LIBRARY = f"struct<{_attributes('ParentProjectName', 'ArtifactFileName', 'LibraryGroupName', 'LibraryName', 'LibraryScope')}>".replace(" string", ":string")
_PORT = "struct<_ExposesPortsField:string>"
_LINK = "struct<_DependencyOrder:string,_LinksDependsOnField:string>"
_PARAMETER = "struct<_ParameterName:string,_ParameterValue:string>"
_ANNOTATIONS = f"annotations:array<struct<_AnnotationName:string,parameters:array<{_PARAMETER}>>>"
_DATA_TYPE = "struct<_ElementIdentifier:string,_PackageName:string,_JsonSchema:string>"
_ARGUMENT = f"struct<_ElementIdentifier:string,_ParameterOrder:string,_FieldValue:string,{_ANNOTATIONS},type:{_DATA_TYPE}>"
_INVOKED = f"struct<_ElementIdentifier:string,_RootCallingMethod:string,parent:{_DATA_TYPE},parameters:array<{_ARGUMENT}>>"
_METHOD = (
    f"struct<_ElementIdentifier:string,_ElementProfile:string,{_ANNOTATIONS},parameters:array<{_ARGUMENT}>,"
    f"returns:{_DATA_TYPE},invokes:array<{_INVOKED}>>"
)
_TYPE = (
    "struct<_type:string,`_xsi:type`:string,_ArtifactFileName:string,_ElementIdentifier:string,_ElementProfile:string,"
    f"_PackageName:string,_JsonSchema:string,{_ANNOTATIONS},methods:array<{_METHOD}>,extends:array<{_DATA_TYPE}>,"
    f"imports:array<{_DATA_TYPE}>,implements:array<{_DATA_TYPE}>>"
)
_MODULE = (
    "struct<_ParentProjectName:string,_ArtifactFileName:string,_ProjectArtifactId:string,_type:string,"
    f"`_xsi:type`:string,properties:array<{_PROPERTY}>,libraries:array<{_LIBRARY}>,layers:array<struct<elements:array<{_TYPE}>>>>"
)
_CONTAINER = (
    "struct<_ParentProjectName:string,_ArtifactFileName:string,_ContainerName:string,_ImageField:string,"
    f"_BuildField:string,_GeneratesLogs:string,ports:array<{_PORT}>,links:array<{_LINK}>>"
)
APPLICATION_SCHEMA = (
    "_ApplicationName string, _ProjectPackageURL string, application_project "
    "struct<_ParentProjectName:string,_ProjectArtifactId:string,_ArtifactFileName:string,"
    f"modules:array<{_MODULE}>>, containers array<{_CONTAINER}>"
)

# Element types of the model file.
_MODULE_KINDS = {"SpringMVC": "SpringMVC", "SpringWebFlux": "WebFlux"}


def read_model_files(spark: SparkSession, path: str) -> Facts:
    """Fact tables of all model files below ``path``."""
    rows = (
        spark.read.format("xml")
        .option("rowTag", "application")
        .option("attributePrefix", "_")
        .schema(APPLICATION_SCHEMA)
        .load(path)
    )
    return model_facts(spark, rows)


def parse_model_texts(texts: DataFrame) -> DataFrame:
    """Column ``content`` holding one ``<application>`` element per row -> parsed rows."""
    parsed = F.from_xml("content", APPLICATION_SCHEMA, {"attributePrefix": "_"})
    return texts.select(parsed.alias("one")).select("one.*")


def _text(name: str, default: str | None = None) -> Column:
    return F.col(name) if default is None else F.coalesce(F.col(name), F.lit(default))


def _identifier(name: str) -> Column:
    """Name of a method without the brackets that model files may put behind it."""
    return F.regexp_replace(name, r"\(\)$", "")


def _known(text: Column) -> Column:
    return F.when(F.coalesce(text, F.lit("")) == "", rules.NOT_AVAILABLE).otherwise(text)


def _java_facts(modules: DataFrame) -> dict[str, DataFrame]:
    """Java tables of the layers of all modules; positions count through a module, from outer to inner elements."""
    layers = modules.select("app_id", F.col("seq").alias("module_no"), F.col("one._ProjectArtifactId").alias("project"), F.posexplode("one.layers").alias("layer_no", "layer"))
    types = layers.select("app_id", "module_no", "project", "layer_no", F.posexplode("layer.elements").alias("type_no", "t"))
    place = position((F.col("layer_no"), 8), (F.col("type_no"), 16))
    types = types.select(
        "app_id", "project", F.coalesce("t._ArtifactFileName", F.lit("")).alias("artifact"), place.alias("type_at"), "t",
        F.concat_ws("#", F.col("module_no"), F.col("layer_no"), F.col("type_no")).alias("type_key"),
        _text("t._ElementProfile", "COMPILE").alias("profile"),
    )
    head = ["app_id", "project", "artifact"]
    seq = F.col("type_at").cast("long")
    declared = F.coalesce("t.`_xsi:type`", "t._type", F.lit(""))
    java_type = types.select(
        *head, seq.alias("seq"), "type_key", F.col("t._ElementIdentifier").alias("type_id"),
        _text("t._PackageName", schema.DEFAULT_PACKAGE).alias("package"),
        F.when(declared.contains("Interface"), "Interface").otherwise("Class").alias("kind"), "profile",
        _text("t._JsonSchema", "").alias("json_schema"),
    )
    related = [
        types.select(*head, "type_at", "type_key", "profile", F.lit(relation).alias("relation"), F.posexplode(f"t.{relation}").alias("no", "one"))
        for relation in ("extends", "implements", "imports")
    ]
    supertypes = reduce(DataFrame.unionByName, related).select(
        *head, position((F.col("type_at"), 24), (F.col("no"), 20)).alias("seq"), "type_key", "relation",
        F.col("one._ElementIdentifier").alias("target_id"),
        _text("one._PackageName", schema.DEFAULT_PACKAGE).alias("target_package"), "profile",
    )
    methods = types.select(*head, "type_at", "type_key", "t", F.posexplode("t.methods").alias("method_no", "m")).select(
        *head, position((F.col("type_at"), 24), (F.col("method_no"), 14)).alias("method_at"), "type_key", "m",
        F.concat_ws("#", F.col("type_key"), F.col("method_no")).alias("method_key"),
        F.coalesce("m._ElementProfile", "t._ElementProfile", F.lit("COMPILE")).alias("profile"),
    )
    java_method = methods.select(
        *head, F.col("method_at").alias("seq"), "type_key", "method_key", _identifier("m._ElementIdentifier").alias("method_name"),
        F.col("m.returns._ElementIdentifier").alias("return_type"),
        F.when(F.col("m.returns").isNotNull(), _text("m.returns._PackageName", schema.DEFAULT_PACKAGE)).alias("return_package"),
        F.when(F.col("m.returns").isNotNull(), _text("m.returns._JsonSchema", "")).alias("return_schema"), "profile",
    )
    params = methods.select(*head, "method_at", "method_key", "profile", F.posexplode("m.parameters").alias("no", "p")).withColumn(
        "param_key", F.concat_ws("#", "method_key", (F.col("no") + 1).cast("string"))
    )
    method_param = params.select(
        "app_id", F.col("no").cast("long").alias("seq"), "method_key", "param_key",
        F.coalesce(F.col("p._ParameterOrder").cast("int"), F.lit(schema.DEFAULT_PARAM_ORDER)).alias("param_order"),
        F.col("p._ElementIdentifier").alias("param_name"), F.col("p.type._ElementIdentifier").alias("type_name"),
        F.when(F.col("p.type").isNotNull(), _text("p.type._PackageName", schema.DEFAULT_PACKAGE)).alias("type_package"),
        F.when(F.col("p.type").isNotNull(), _text("p.type._JsonSchema", "")).alias("json_schema"),
    )
    owners = (
        types.select(*head, position((F.col("type_at"), 24), (F.lit(0), 22)).alias("at"), F.lit("type").alias("owner_kind"), F.col("type_key").alias("owner_key"), "profile", F.col("t.annotations").alias("notes")),
        methods.select(*head, position((F.col("method_at"), 38), (F.lit(0), 8)).alias("at"), F.lit("method").alias("owner_kind"), F.col("method_key").alias("owner_key"), "profile", F.col("m.annotations").alias("notes")),
        params.select(*head, position((F.col("method_at"), 38), (F.col("no") + 1, 8)).alias("at"), F.lit("parameter").alias("owner_kind"), F.col("param_key").alias("owner_key"), "profile", F.col("p.annotations").alias("notes")),
    )
    notes = reduce(DataFrame.unionByName, owners).select("*", F.posexplode("notes").alias("no", "note"))
    notes = notes.withColumn("annotation_key", F.concat_ws("@", "owner_kind", "owner_key", F.col("no").cast("string")))
    annotations = notes.select(
        *head, position((F.col("at"), 46), (F.col("no"), 7)).alias("seq"), "owner_kind", "owner_key", "annotation_key",
        F.col("note._AnnotationName").alias("annotation_name"), "profile",
    )
    annotation_param = notes.select("app_id", "annotation_key", F.posexplode("note.parameters").alias("seq", "one")).select(
        "app_id", F.col("seq").cast("long").alias("seq"), "annotation_key",
        _text("one._ParameterName", schema.DEFAULT_PARAM_NAME).alias("param_name"), F.col("one._ParameterValue").alias("param_value"),
    )
    calls = methods.select(*head, "method_at", "method_key", "profile", "m", F.posexplode("m.invokes").alias("no", "call")).withColumn(
        "invocation_key", F.concat_ws("#", "method_key", F.col("no").cast("string"))
    )
    own_name = F.concat(_identifier("m._ElementIdentifier"), F.lit("()"))
    invocations = calls.select(
        *head, position((F.col("method_at"), 38), (F.col("no"), 15)).alias("seq"), "method_key", "invocation_key",
        F.coalesce("call._RootCallingMethod", own_name).alias("root_method"), _identifier("call._ElementIdentifier").alias("callee"),
        F.col("call.parent._ElementIdentifier").alias("receiver_type"),
        F.when(F.col("call.parent").isNotNull(), _text("call.parent._PackageName", schema.DEFAULT_PACKAGE)).alias("receiver_package"), "profile",
    )
    args = calls.select("app_id", "invocation_key", F.posexplode("call.parameters").alias("seq", "one")).select(
        "app_id", F.col("seq").cast("long").alias("seq"), "invocation_key",
        F.coalesce(F.col("one._ParameterOrder").cast("int"), F.lit(schema.DEFAULT_PARAM_ORDER)).alias("arg_order"),
        _known(F.col("one._ElementIdentifier")).alias("arg_name"), _text("one._FieldValue", schema.DEFAULT_FIELD_VALUE).alias("arg_value"),
    )
    return {
        "java_type": java_type, "java_supertype": supertypes, "java_annotation": annotations, "annotation_param": annotation_param,
        "java_method": java_method, "method_param": method_param, "java_invocation": invocations, "invocation_arg": args,
    }


def model_facts(spark: SparkSession, rows: DataFrame) -> Facts:
    app = F.col("_ApplicationName").alias("app_id")
    applications = rows.select(
        app, F.lit(0).cast("long").alias("seq"), F.col("_ApplicationName").alias("app_name"),
        F.col("_ProjectPackageURL").alias("package_url"),
    )
    project = rows.select(
        app,
        F.lit(0).cast("long").alias("seq"),
        F.col("application_project._ParentProjectName").alias("project"),
        F.col("application_project._ArtifactFileName").alias("artifact"),
        F.col("application_project._ProjectArtifactId").alias("artifact_id"),
    )
    modules = rows.select(app, F.posexplode("application_project.modules").alias("seq", "one"))
    declared = F.coalesce("one.`_xsi:type`", "one._type", F.lit(""))
    kind = F.lit("Microservice")
    for name, mark in _MODULE_KINDS.items():
        kind = F.when(declared.contains(mark), name).otherwise(kind)
    module = modules.select(
        "app_id", F.col("seq").cast("long").alias("seq"), F.col("one._ParentProjectName").alias("project"),
        F.col("one._ArtifactFileName").alias("artifact"), F.col("one._ProjectArtifactId").alias("artifact_id"),
        kind.alias("kind"),
    )
    properties = modules.select("app_id", F.posexplode("one.properties").alias("seq", "p")).select(
        "app_id", F.col("seq").cast("long").alias("seq"), F.col("p._ParentProjectName").alias("project"),
        F.col("p._ArtifactFileName").alias("artifact"), F.col("p._FullyQualifiedPropertyName").alias("name"),
        F.col("p._PropertyValue").alias("value"),
        _text("p._ConfigurationProfile", schema.DEFAULT_PROFILE).alias("profile"),
    )
    libraries = modules.select("app_id", F.posexplode("one.libraries").alias("seq", "p")).select(
        "app_id", F.col("seq").cast("long").alias("seq"), F.col("p._ParentProjectName").alias("project"),
        F.col("p._ArtifactFileName").alias("artifact"), F.col("p._LibraryGroupName").alias("group_name"),
        F.col("p._LibraryName").alias("library_name"), F.col("p._LibraryScope").alias("scope"),
    )
    containers = rows.select(app, F.posexplode("containers").alias("seq", "one"))
    owner = [
        F.col("one._ParentProjectName").alias("project"),
        F.col("one._ArtifactFileName").alias("artifact"),
    ]
    container = containers.select(
        "app_id", F.col("seq").cast("long").alias("seq"), *owner, F.col("one._ContainerName").alias("name"),
        _text("one._ImageField", "").alias("image"), _text("one._BuildField", "").alias("build"),
        (_text("one._GeneratesLogs", "false") == "true").alias("generates_logs"),
    )
    ports = containers.select(
        "app_id", *owner, F.col("one._ContainerName").alias("container"), F.posexplode("one.ports").alias("seq", "p")
    ).select("app_id", F.col("seq").cast("long").alias("seq"), "project", "artifact", "container", F.col("p._ExposesPortsField").alias("port"))
    links = containers.select(
        "app_id", *owner, F.col("one._ContainerName").alias("container"), F.posexplode("one.links").alias("seq", "p")
    ).select(
        "app_id", F.col("seq").cast("long").alias("seq"), "project", "artifact", "container",
        F.coalesce(F.col("p._DependencyOrder").cast("int"), F.lit(schema.DEFAULT_LINK_ORDER)).alias("dep_order"),
        F.col("p._LinksDependsOnField").alias("target"),
    )
    return Facts.of(
        spark,
        {
            "application": applications, "app_project": project, "module": module, "property": properties,
            "library": libraries, "container": container, "container_port": ports, "container_link": links,
            **_java_facts(modules),
        },
    )

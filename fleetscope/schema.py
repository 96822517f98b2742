"""Schemas of the fact tables. Every table starts with ``app_id`` and ``seq``.

``seq`` is the position of a fact in the reading order of its module (or of its application for
containers); it only has to be non-negative and to order facts of one owner. ``*_key`` columns
identify a Java element inside one application. ``app_id`` may be a string or a bigint.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_OWNER = "project string, artifact string"

FACT_SCHEMAS = {
    "application": "seq bigint, app_name string, package_url string",
    "app_project": f"seq bigint, {_OWNER}, artifact_id string",
    "container": f"seq bigint, {_OWNER}, name string, image string, build string, generates_logs boolean",
    "container_port": f"seq bigint, {_OWNER}, container string, port string",
    "container_link": f"seq bigint, {_OWNER}, container string, dep_order int, target string",
    "module": f"seq bigint, {_OWNER}, artifact_id string, kind string",
    "library": f"seq bigint, {_OWNER}, group_name string, library_name string, scope string",
    "property": f"seq bigint, {_OWNER}, name string, value string, profile string",
    "java_type": f"seq bigint, {_OWNER}, type_key string, type_id string, package string, kind string, "
    "profile string, json_schema string",
    "java_supertype": f"seq bigint, {_OWNER}, type_key string, relation string, target_id string, "
    "target_package string, profile string",
    "java_annotation": f"seq bigint, {_OWNER}, owner_kind string, owner_key string, annotation_key string, "
    "annotation_name string, profile string",
    "annotation_param": "seq bigint, annotation_key string, param_name string, param_value string",
    "java_method": f"seq bigint, {_OWNER}, type_key string, method_key string, method_name string, "
    "return_type string, return_package string, return_schema string, profile string",
    "method_param": "seq bigint, method_key string, param_key string, param_order int, param_name string, "
    "type_name string, type_package string, json_schema string",
    "java_invocation": f"seq bigint, {_OWNER}, method_key string, invocation_key string, root_method string, "
    "callee string, receiver_type string, receiver_package string, profile string",
    "invocation_arg": "seq bigint, invocation_key string, arg_order int, arg_name string, arg_value string",
}

# Declared defaults of the model file format.
DEFAULT_PROFILE = "global"
DEFAULT_LINK_ORDER = 1
DEFAULT_PACKAGE = "java.lang"
DEFAULT_PARAM_NAME = "value"
DEFAULT_PARAM_ORDER = 1
DEFAULT_FIELD_VALUE = "NOT_APPLICABLE"


def fact_schema(name: str, app_type: str = "string") -> T.StructType:
    return T.StructType.fromDDL(f"app_id {app_type}, {FACT_SCHEMAS[name]}")


@dataclass(frozen=True)
class Facts:
    """The fact tables of any number of applications."""

    application: DataFrame
    app_project: DataFrame
    container: DataFrame
    container_port: DataFrame
    container_link: DataFrame
    module: DataFrame
    library: DataFrame
    property: DataFrame
    java_type: DataFrame
    java_supertype: DataFrame
    java_annotation: DataFrame
    annotation_param: DataFrame
    java_method: DataFrame
    method_param: DataFrame
    java_invocation: DataFrame
    invocation_arg: DataFrame

    @classmethod
    def of(cls, spark: SparkSession, tables: dict[str, DataFrame], app_type: str = "string") -> Facts:
        """Missing tables are taken as empty."""
        return cls(
            **{
                field.name: tables[field.name]
                if field.name in tables
                else spark.createDataFrame([], fact_schema(field.name, app_type))
                for field in fields(cls)
            }
        )

    def tables(self) -> dict[str, DataFrame]:
        return {field.name: getattr(self, field.name) for field in fields(self)}

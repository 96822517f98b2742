"""Texts that name the fact a derived row comes from."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def container_evidence(name: Column, image: Column, logs: Column) -> Column:
    return F.concat(
        F.lit("DockerContainerDefinition[ContainerName:"), name, F.lit(",ImageField:"), image,
        F.lit(", GeneratesLogs:"), logs.cast("string"), F.lit("]"),
    )


def link_evidence(target: Column) -> Column:
    return F.concat(F.lit("DockerContainerLink[LinksDependsOnField:"), target, F.lit("]"))


def module_evidence(artifact_id: Column) -> Column:
    return F.concat(F.lit("MicroserviceProject[ProjectArtifactId:"), artifact_id, F.lit("]"))


def library_evidence(name: Column) -> Column:
    return F.concat(F.lit("DependencyLibrary[LibraryName:"), name, F.lit("]"))


def property_evidence(name: Column) -> Column:
    return F.concat(F.lit("ConfigurationProperty[FullyQualifiedPropertyName:"), name, F.lit("]"))


def type_evidence(name: Column) -> Column:
    return F.concat(F.lit("JavaUserDefinedType[ElementIdentifier:"), name, F.lit("]"))


def annotation_evidence(name: Column) -> Column:
    return F.concat(F.lit("JavaAnnotation[AnnotationName:"), name, F.lit("]"))


def method_evidence(name: Column) -> Column:
    return F.concat(F.lit("JavaMethod[ElementIdentifier:"), name, F.lit("()]"))

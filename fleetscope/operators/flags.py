"""Order-dependent module flags, and the facts they gate.

A flag never goes back to false, so "was it set before element e" is ``first_<flag> < ord(e)``. One
partial aggregation per module replaces a running window, and a module with a third of all
properties shrinks to a handful of numbers before the shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetscope import rules
from fleetscope.functions import order_key
from fleetscope.functions.ordering import ANNOTATION, LIBRARY, PROPERTY, REGISTRY_PAIR

_NO_REGISTER, _NO_FETCH, _EUREKA_ANNOTATION = "no_register", "no_fetch", "eureka_annotation"
_RUNNING = (rules.ACTUATOR, rules.HYSTRIX, rules.CONFIG_CLIENT, rules.ZUUL, rules.EUREKA)


def matched_test(name: str, tests) -> Column:
    """The text of the test the column ``name`` meets, else null.

    No name meets an exact test and a prefix test of one rule table other than through the longer
    text, so longer texts go first and the rule table is then looked up by a hash join.
    """
    ordered = sorted({(match, text) for match, text in tests}, key=lambda test: (-len(test[1]), test))
    return F.expr(f"CASE {' '.join(f"WHEN {_condition(match, name, text)} THEN '{text}'" for match, text in ordered)} END")


def _condition(match: str, name: str, text: str) -> str:
    return {
        rules.EXACT: f"{name} = '{text}'",
        rules.PREFIX: f"startswith({name}, '{text}')",
        rules.SUFFIX: f"endswith({name}, '{text}')",
    }[match]


def value_passes(test: Column, value: Column) -> Column:
    return (test == rules.ANY_VALUE) | (value != "0")


def _is_false(wanted: str) -> str:
    return f"(name = '{wanted}' AND value = 'false')"


def module_flags(libraries: DataFrame, properties: DataFrame, annotations: DataFrame) -> DataFrame:
    """Per (app_id, project): position at which every flag is set first, null if never.

    ``first_eureka`` covers libraries and the "neither registers nor fetches" property pair;
    ``eureka_annotation`` is the position of the first server annotation, seen by dependencies only.
    """
    library_cases = [
        f"WHEN library_name IN ({', '.join(repr(name) for name in names)}) THEN '{flag}'"
        for names, flag in rules.LIBRARY_FLAGS
    ]
    from_libraries = libraries.select(
        "app_id",
        "project",
        F.expr(f"CASE {' '.join(library_cases)} END").alias("flag"),
        order_key(LIBRARY, F.col("seq")).alias("ord"),
    )

    property_cases = [
        f"WHEN {_condition(match, 'name', text)} {"AND value <> '0'" if check == rules.NOT_ZERO else ''} THEN '{flag}'"
        for match, text, check, flag in rules.PROPERTY_FLAGS
    ]
    property_cases += [
        f"WHEN {_is_false(rules.NO_REGISTER_PROPERTY)} THEN '{_NO_REGISTER}'",
        f"WHEN {_is_false(rules.NO_FETCH_PROPERTY)} THEN '{_NO_FETCH}'",
    ]
    flagged = properties.select(
        "app_id", "project", "seq", F.expr(f"CASE {' '.join(property_cases)} END").alias("flag")
    )
    from_properties = flagged.select(
        "app_id",
        "project",
        "flag",
        F.when(F.col("flag") == _NO_REGISTER, order_key(REGISTRY_PAIR, F.col("seq")))
        .otherwise(order_key(PROPERTY, F.col("seq")))
        .alias("ord"),
    )
    from_annotations = annotations.where(
        (F.col("owner_kind") == "type") & (F.col("annotation_name") == "EnableEurekaServer")
    ).select(
        "app_id",
        "project",
        F.lit(_EUREKA_ANNOTATION).alias("flag"),
        order_key(ANNOTATION, F.col("seq")).alias("ord"),
    )
    triggers = reduce(DataFrame.unionByName, (from_libraries, from_properties, from_annotations))
    firsts = triggers.where(F.col("flag").isNotNull()).groupBy("app_id", "project").agg(
        *[
            F.expr(f"min(ord) FILTER (WHERE flag = '{flag}') AS first_{flag}")
            for flag in (*_RUNNING, _NO_REGISTER, _NO_FETCH)
        ],
        F.expr(f"min(ord) FILTER (WHERE flag = '{_EUREKA_ANNOTATION}') AS {_EUREKA_ANNOTATION}"),
    )
    pair = F.when(F.col(f"first_{_NO_FETCH}").isNotNull(), F.col(f"first_{_NO_REGISTER}"))
    return firsts.withColumn("first_eureka", F.least("first_eureka", pair)).drop(
        f"first_{_NO_REGISTER}", f"first_{_NO_FETCH}"
    )


def registry_pair(properties: DataFrame) -> DataFrame:
    """Modules that neither register with nor fetch from a registry: the first "do not register" property."""
    register = F.expr(_is_false(rules.NO_REGISTER_PROPERTY))
    fetch = F.expr(_is_false(rules.NO_FETCH_PROPERTY))
    return (
        properties.where(register | fetch)
        .groupBy("app_id", "project")
        .agg(
            F.min(F.when(register, F.col("seq"))).alias("seq"),
            F.min_by("profile", F.when(register, F.col("seq"))).alias("profile"),
            F.max(fetch).alias("fetch_off"),
        )
        .where(F.col("fetch_off") & F.col("seq").isNotNull())
        .select("app_id", "project", "seq", "profile", F.lit(rules.NO_REGISTER_PROPERTY).alias("name"))
    )


def gate(candidates: DataFrame, flags: DataFrame) -> DataFrame:
    """Keep candidates whose needed flag was set before them and whose vetoing flag was never set.

    ``needs`` and ``unless`` name a flag or are null; a candidate with neither is kept. Flags are one row a
    module, so candidates meet them in one join, however many rules there are, and are read once.
    """
    cases = " ".join(f"WHEN '{flag}' THEN first_{flag}" for flag in _RUNNING if flag != rules.EUREKA)
    first = F.expr(f"CASE needs {cases} END")
    return (
        candidates.join(flags, ["app_id", "project"], "left")
        .where(F.col("needs").isNull() | (first < F.col("ord")))
        .where(F.col("unless").isNull() | F.col("first_eureka").isNull())
        .select(*candidates.columns)
        .drop("needs", "unless")
    )

"""Collects every query with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from catalog.facts import LazyFacts, with_facts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, used: tuple[str, ...] = ()):
    """Register ``build(facts)`` under ``name``; ``sql`` may use the fact tables as ``f_<name>``."""

    def add(build: Callable[[LazyFacts], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: build(LazyFacts(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_facts(sql, *used).replace("WITH RECURSIVE_", "WITH RECURSIVE ").replace("RECURSIVE_", "")
        return build

    return add


def values(rows) -> str:
    """Rule rows as a SQL VALUES list."""

    def literal(value):
        if value is None:
            return "NULL"
        return str(value) if isinstance(value, int) else "'" + str(value).replace("'", "''") + "'"

    return "(VALUES " + ", ".join("(" + ", ".join(literal(value) for value in row) + ")" for row in rows) + ")"

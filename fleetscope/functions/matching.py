"""Substring and prefix joins as equi joins.

``text contains needle`` inside a group is usually a nested loop over the group. Here every text is
expanded to its substrings, but only in the lengths that needles of the group have, so the join is a
hash join on (group keys, substring) and yields true matches only. Work per text is its length times
the number of distinct needle lengths, whatever the number of needles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _windows(text: Column, length: Column) -> Column:
    last = F.length(text) - length + 1
    starts = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda at: F.substring(text, at, length))


def _by_needle_length(texts: DataFrame, needles: DataFrame, keys: list[str], needle: str) -> DataFrame:
    # A set of lengths is bounded by the longest needle, never by the number of needles.
    lengths = needles.groupBy(*keys).agg(F.collect_set(F.length(needle)).alias("_lengths"))
    return texts.join(lengths, keys)


def join_contains(texts: DataFrame, text: str, needles: DataFrame, needle: str, keys: list[str]) -> DataFrame:
    """Inner join of rows with equal ``keys`` whose ``text`` contains ``needle`` (empty needles never match)."""
    wanted = needles.where(F.length(needle) > 0)
    pieces = F.array_distinct(
        F.flatten(F.transform("_lengths", lambda n: _windows(F.col(text), n)))
    )
    probes = _by_needle_length(texts, wanted, keys, needle).withColumn(needle, F.explode(pieces)).drop("_lengths")
    return probes.join(wanted, [*keys, needle])


def join_prefix(texts: DataFrame, text: str, needles: DataFrame, needle: str, keys: list[str]) -> DataFrame:
    """Inner join of rows with equal ``keys`` whose ``text`` starts with ``needle``."""
    wanted = needles.where(F.length(needle) > 0)
    fitting = F.filter("_lengths", lambda n: n <= F.length(text))
    pieces = F.transform(fitting, lambda n: F.substring(F.col(text), F.lit(1), n))
    probes = _by_needle_length(texts, wanted, keys, needle).withColumn(needle, F.explode(pieces)).drop("_lengths")
    return probes.join(wanted, [*keys, needle])

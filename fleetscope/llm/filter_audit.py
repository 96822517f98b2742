"""Operator 11: how five document filters interact, by the potentials of the removal game of their coalitions.

The players are the filters; what a coalition is worth is the number of documents that it removes. A document is only
the set of filters that it fails (its mask), so per part the 32 masks are counted once, and everything else is
arithmetic on 32 numbers, whatever the corpus:

1. ``worth`` of coalition S: documents whose mask meets S; for all documents, the good and the toxic ones.
2. Hart-Mas-Colell potential: P(empty) = 0, P(S) = (worth(S) + sum over i in S of P(S without i)) / |S|, worked out from
   small coalitions to large ones. It is kept as |S|! P(S), which is whole: (|S|-1)! worth(S) + sum of the smaller ones.
   Shapley of filter i is P(all) - P(all without i); over all 120 orders that is 120 times as much.
3. A step of an order removes worth(before and the filter) - worth(before).

Edge cases: a missing text counts as empty, a missing lang is the part of the empty text. Filter E never fails for the
smallest ``doc_id`` of a text, nor for rows that share it; rows without id neither fail it nor make others fail. A label
counts once for a document however often it is given; labels of unknown documents count nowhere, and rows without id have
none. An empty table has no parts and no rows. Further columns are ignored.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetscope.llm.common import materialize

FILTERS = "ABCDE"
EVERY = (1 << len(FILTERS)) - 1
COUNTS = ("documents", "good", "toxic")


def text_failures(text: Column) -> Column:
    """Mask of the filters A to D, bit by bit; one look at the words of the whole text."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda word: word != "")

    def mask(found: Column) -> Column:
        few = F.size(found) < 200
        repeated = 100 * F.size(F.array_distinct(found)) < 50 * F.size(found)
        capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))
        fails = (few, repeated, 100 * capitals.cast("long") > 3 * F.length(text).cast("long"), text.rlike(r"[#$%&*|]"))
        return sum((failed.cast("int") * (1 << at) for at, failed in enumerate(fails)), F.lit(0))

    return F.get(F.transform(F.array(words), mask), F.lit(0))


def failed_filters(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``part`` and the ``mask`` of all five filters, a row for each row of ``docs``.

    Copies are found by the digest of the text. The first of each text is looked up by id and digest, not by digest, so a
    text that a third of all rows share is combined before the shuffle and never lands in one task.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    read = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("lang"), F.lit("")).alias("part"),
        text_failures(text).alias("some"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
    )
    read = materialize(read, "failures")
    first = read.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    known = read.join(first, ["doc_id", "digest"], "left")
    return known.select("doc_id", "part", (F.col("some") + copy.cast("int") * (1 << FILTERS.index("E"))).alias("mask"))


def mask_counts(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """``part``, ``mask`` and the number of documents, of good and of toxic ones."""
    marks = (
        labels.where("doc_id IS NOT NULL")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    )
    total = [F.sum(F.coalesce(name, F.lit(0))).cast("long").alias(name) for name in ("good", "toxic")]
    return failed.join(marks, "doc_id", "left").groupBy("part", "mask").agg(F.count(F.lit(1)).alias("documents"), *total)


def worths(counts: DataFrame) -> DataFrame:
    """``part``, its number of documents, and arrays with a number for each of the 32 coalitions."""
    cells = counts.groupBy("part").agg(
        F.sum("documents").alias("n"), F.collect_list(F.struct("mask", *COUNTS)).alias("cells")  # 32 cells at most
    )

    def worth(name: str) -> Column:
        def of(coalition: Column) -> Column:
            return F.aggregate(
                "cells", F.lit(0).cast("long"), lambda sum_, cell: sum_ + F.when(cell["mask"].bitwiseAND(coalition) != 0, cell[name]).otherwise(0)
            )

        return F.transform(F.sequence(F.lit(0), F.lit(EVERY)), of).alias(name)

    return cells.select("part", "n", *map(worth, COUNTS))


def potentials(worth: Column) -> Column:
    """|S|! P(S) of every coalition S, in the order of its bits: every part of a coalition comes before it."""

    def next_one(known: Column, coalition: Column) -> Column:
        players = F.bit_count(coalition)
        ways = F.element_at(F.array(*[F.lit(factorial(max(size - 1, 0))).cast("long") for size in range(len(FILTERS) + 1)]), players + 1)
        smaller = [
            F.when(coalition.bitwiseAND(F.lit(1 << at)) != 0, F.get(known, coalition.bitwiseXOR(F.lit(1 << at)))).otherwise(0) for at in range(len(FILTERS))
        ]
        return F.concat(known, F.array(ways * F.get(worth, coalition) + sum(smaller, F.lit(0).cast("long"))))

    return F.aggregate(F.sequence(F.lit(1), F.lit(EVERY)), F.array(F.lit(0).cast("long")), next_one)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """For every part, order of the filters and step what the step removes, and the filter's share over all orders."""
    games = worths(mask_counts(failed_filters(docs), labels)).withColumn("potential", potentials(F.col("documents")))
    orders = F.array(*[F.lit("".join(order)) for order in permutations(FILTERS)])
    rows = games.withColumn("filter_order", F.explode(orders))
    rows = rows.select("*", F.posexplode(F.split("filter_order", "")).alias("at", "letter"))
    bit = F.element_at(F.array(*[F.lit(1 << at) for at in range(len(FILTERS))]), F.instr(F.lit(FILTERS), F.col("letter")))
    before = sum(
        (F.when(F.instr(F.substring("filter_order", F.lit(1), F.col("at")), letter) > 0, 1 << at).otherwise(0) for at, letter in enumerate(FILTERS)), F.lit(0)
    )
    rows = rows.withColumn("bit", bit).withColumn("before", before)
    after = F.col("before") + F.col("bit")

    def gain(name: str) -> Column:
        return F.get(name, after) - F.get(name, F.col("before"))

    removed = gain("documents")
    return rows.select(
        "part",
        "filter_order",
        (F.col("at") + 1).cast("int").alias("step"),
        (F.col("n") - F.get("documents", after)).alias("kept"),
        removed.alias("removed"),
        (F.get("documents", F.col("bit")) - removed).alias("redundant"),
        (F.get("documents", F.lit(EVERY)) - F.get("documents", F.lit(EVERY) - F.col("bit"))).alias("unique_fails"),
        gain("good").alias("good_lost"),
        gain("toxic").alias("toxic_lost"),
        (F.get("potential", F.lit(EVERY)) - len(FILTERS) * F.get("potential", F.lit(EVERY) - F.col("bit"))).alias("shapley"),
    )

"""Closed-form merges against the sequential procedure, on random groups (one application per group)."""

import random

import pytest
from pyspark.sql import functions as F

from fleetscope import rules
from fleetscope.functions.matching import join_contains, join_prefix
from fleetscope.operators import build, components, dependencies


def components_by_hand(rows):
    found = []
    for technology, environment, evidence, _ in rows:
        same = [c for c in found if c["t"] == technology] if technology else found[:1]
        if technology and not same:
            same = [c for c in found if c["t"] is None]
        if same:
            target = same[0]
        else:
            target = {"t": None, "env": environment, "ev": []}
            found.append(target)
        if technology:
            target["t"] = technology
        if evidence not in target["ev"]:
            target["ev"].append(evidence)
    return {(c["t"], c["env"], tuple(c["ev"])) for c in found}


def test_components(spark):
    rng = random.Random(3)
    groups = {
        str(app): [
            (rng.choice(["", "", "A", "B", "C"]), rng.choice(["X", "Y"]), f"e{rng.randrange(5)}", position)
            for position in range(rng.randrange(1, 12))
        ]
        for app in range(150)
    }
    rows = [
        (app, "s", rules.CLIENT, rules.CACHE, *row) for app, members in groups.items() for row in members
    ]
    rng.shuffle(rows)
    df = spark.createDataFrame(
        rows,
        "app_id string, service string, kind string, category string, technology string, environment string, "
        "evidence string, ord long",
    )
    merged = components.merge_components(df.repartition(5))
    links = {}
    for row in merged.evidence.orderBy("ord").collect():
        links.setdefault((row.app_id, row.technology), []).append(row.evidence)
    got = {}
    for row in merged.rows.collect():
        got.setdefault(row.app_id, set()).add(
            (row.technology, row.environment, tuple(links[row.app_id, row.technology]))
        )
    assert got == {app: components_by_hand(members) for app, members in groups.items()}


def dependencies_by_hand(rows):
    found = []
    for destination, operation, environment, overwrites, evidence, _ in rows:
        same = [d for d in found if d["d"] == destination or d["d"] in ("", None)]
        if destination is not None and same:
            target = same[0]
        else:
            target = {"env": environment, "op": None, "ev": []}
            found.append(target)
        target["d"] = destination
        if overwrites:
            target["env"] = environment
        if operation:
            target["op"] = operation
        if evidence not in target["ev"]:
            target["ev"].append(evidence)
    return {(d["d"], d["op"], d["env"], tuple(d["ev"])) for d in found}


@pytest.mark.parametrize("block_bits", [1, 2, 20])
def test_dependencies(spark, block_bits, monkeypatch):
    monkeypatch.setattr(dependencies, "_BLOCK_BITS", block_bits)
    rng = random.Random(5)
    groups = {}
    for app in range(150):
        rows = []
        if rng.random() < 0.5:
            rows.append((None, None, None, False, "link", 0))
        for position in range(1, rng.randrange(2, 14)):
            destination = rng.choice(["", "", "A", "B", "C"])
            if rng.random() < 0.5:
                rows.append((destination, None, rng.choice(["X", "Y"]), True, f"p{rng.randrange(4)}", position))
            else:
                rows.append((destination, f"m{rng.randrange(3)}()", "J", False, f"m{rng.randrange(4)}", position))
        groups[str(app)] = rows
    flat = [
        (app, "s", "p", row[0], row[1], row[2], row[3], row[1] is not None, row[4], row[5])
        for app, rows in groups.items()
        for row in rows
    ]
    df = spark.createDataFrame(
        flat,
        "app_id string, service string, provider string, destination string, operation string, environment string, "
        "overwrites boolean, from_method boolean, evidence string, ord long",
    )
    merged = dependencies.merge_dependencies(df.repartition(5))
    links = {}
    for row in merged.evidence.orderBy("ord").collect():
        links.setdefault((row.app_id, row.destination), []).append(row.evidence)
    got = {app: set() for app in groups}
    for row in merged.rows.collect():
        evidence = tuple(links[row.app_id, row.destination or ""])
        got[row.app_id].add((row.destination, row.operation, row.environment, evidence))
    assert got == {app: dependencies_by_hand(rows) for app, rows in groups.items()}


def scopes_by_hand(rows):
    scope, place = "", None
    for seq, new in rows:
        if scope == "":
            scope, place = new, seq
        else:
            scope = {"-": ""}.get(*[rules.SCOPE_TABLE.get(scope, {}).get(new, scope)] * 2)
    return (scope, place) if scope else None


@pytest.mark.parametrize("width", [1, 3, 100])
def test_scopes(spark, width):
    rng = random.Random(7)
    kinds = ["COMPILE", "PROVIDED", "RUNTIME", "TEST", "IMPORT"]
    groups = {str(app): [(seq, rng.choice(kinds)) for seq in range(rng.randrange(1, 12))] for app in range(150)}
    rows = [(app, seq, "g", "l", scope) for app, members in groups.items() for seq, scope in members]
    df = spark.createDataFrame(rows, "app_id string, seq long, group_name string, library_name string, scope string")
    block = F.floor(F.col("seq") / width)
    merged = build.merge_scopes(df, ["app_id"], block=block).collect()
    expected = {app: scopes_by_hand(members) for app, members in groups.items()}
    assert {row.app_id: (row.scope, row.seq) for row in merged} == {a: e for a, e in expected.items() if e}


def test_scopes_of_short_blocks_move_as_they_are(spark):
    """A table of effects is longer than a few entries; only long blocks become one."""
    rows = [(1, "g", "l", seq, scope) for seq, scope in enumerate(["TEST", "COMPILE", "TEST", "RUNTIME"] * 3 + ["COMPILE"])]
    df = spark.createDataFrame(rows, "app_id long, group_name string, library_name string, seq long, scope string")
    merged = build.merge_scopes(df, ["app_id"], block=F.when(F.col("seq") < 9, 0).otherwise(F.col("seq")))  # one of nine, four of one
    found, place = scopes_by_hand([(row[3], row[4]) for row in rows])
    assert [(row.scope, row.seq) for row in merged.collect()] == [(found, place)]
    assert "entries" in merged._jdf.queryExecution().executedPlan().toString().split("collect_list(struct(block")[1][:60]


def test_text_joins(spark):
    texts = spark.createDataFrame([(1, "abcabc"), (1, "xbc"), (2, "abc"), (1, "a")], "app_id int, text string")
    needles = spark.createDataFrame([(1, "bc"), (1, "abcabc"), (1, "zz"), (2, "c"), (1, "")], "app_id int, needle string")
    found = {tuple(row) for row in join_contains(texts, "text", needles, "needle", ["app_id"]).select("app_id", "text", "needle").collect()}
    assert found == {(1, "abcabc", "bc"), (1, "abcabc", "abcabc"), (1, "xbc", "bc"), (2, "abc", "c")}
    starts = {tuple(row) for row in join_prefix(texts, "text", needles, "needle", ["app_id"]).select("text", "needle").collect()}
    assert starts == {("abcabc", "abcabc")}

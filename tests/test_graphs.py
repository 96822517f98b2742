"""Graphs, build files and placeholders against step-by-step procedures."""

import random

import pytest

from fleetscope import rules
from fleetscope.functions.graph import connected, ending_nodes
from fleetscope.operators import build, config


def reach(edges, start):
    seen, left = set(), [start]
    while left:
        for one, other in edges:
            if one == left[-1] and other not in seen:
                break
        else:
            left.pop()
            continue
        seen.add(other)
        left.append(other)
    return seen


def random_edges(draw, nodes, count):
    return sorted({(f"n{draw.randrange(nodes)}", f"n{draw.randrange(nodes)}") for _ in range(count)})


@pytest.mark.parametrize("seed", range(2))
def test_ending_nodes_and_groups(spark, seed):
    draw = random.Random(seed)
    graphs = {"a": random_edges(draw, 40, 36), "b": random_edges(draw, 12, 8), "c": [(f"n{at}", f"n{at + 1}") for at in range(70)], "d": [("n1", "n2"), ("n2", "n3"), ("n3", "n1"), ("n0", "n1"), ("n0", "n9")]}
    df = spark.createDataFrame([(key, *edge) for key, edges in graphs.items() for edge in edges], "app_id string, node string, to string")
    ending, endless = ending_nodes(df, ["app_id"])
    reached = {(key, node): reach(edges, node) for key, edges in graphs.items() for node in {one for one, _ in edges}}
    circular = {place for place, seen in reached.items() if any(node in reached.get((place[0], node), ()) for node in {place[1], *seen})}
    assert {tuple(row) for row in endless.collect()} == circular
    assert {tuple(row) for row in ending.collect()} == set(reached) - circular
    groups = {(row.app_id, row.node): row.group for row in connected(df, ["app_id"]).collect()}
    for key, edges in graphs.items():
        both = edges + [(other, one) for one, other in edges]
        for node in {node for edge in edges for node in edge}:
            same = {other for (app, other), group in groups.items() if app == key and group == groups[key, node]}
            assert same == reach(both, node) | {node}


def test_long_chains_take_few_rounds(spark, monkeypatch):
    from fleetscope.functions import graph

    cuts = []
    monkeypatch.setattr(graph, "written", lambda df, keep=graph.written: cuts.append(1) or keep(df))
    chain = spark.range(1000).selectExpr("1 AS app_id", "concat('n', id) AS node", "concat('n', id + 1) AS to")
    ending, endless = ending_nodes(chain, ["app_id"])
    assert ending.count() == 1000 and endless.count() == 0
    assert len(cuts) <= 2 * 12 + 3


# Build files


def libraries_step_by_step(files, path, seen=()):
    """(group, artifact) -> scope, in the order of the list that a reader of the files would keep."""
    kept = {}

    def read(name, trail):
        parent, deps = files[name]
        for kind, value in [("file", parent)] * (parent is not None) + deps:
            if kind == "file":
                if value not in trail:
                    read(value, (*trail, value))
                continue
            key, scope = value
            if key not in kept:
                kept[key] = scope
            else:
                result = rules.SCOPE_TABLE.get(kept[key], {}).get(scope, kept[key])
                if result == "-":
                    del kept[key]
                else:
                    kept[key] = result

    read(path, (path,))
    return kept


def pom_tables(spark, files):
    poms = [("a", f"{name}/pom.xml", name, parent) for name, (parent, _) in files.items()]
    deps = [
        ("a", f"{name}/pom.xml", at, "g", value if kind == "file" else value[0], "COMPILE" if kind == "file" else value[1])
        for name, (_, listed) in files.items()
        for at, (kind, value) in enumerate(listed)
    ]
    return (
        spark.createDataFrame(poms, "app_id string, path string, artifact_id string, parent_artifact_id string"),
        spark.createDataFrame(deps, "app_id string, path string, pos int, group_name string, library_name string, scope string"),
    )


def random_files(seed, circular):
    draw = random.Random(seed)
    names = [f"file{chr(97 + at)}x" for at in range(7)]
    files = {}
    for at, name in enumerate(names):
        others = names if circular else names[:at]
        parent = draw.choice([None, *others]) if others else None
        deps = []
        for _ in range(draw.randint(0, 6)):
            if others and draw.random() < 0.3:
                deps.append(("file", draw.choice(others)))
            else:
                deps.append(("library", (draw.choice(["p", "q", "r"]), draw.choice(["COMPILE", "PROVIDED", "RUNTIME", "TEST", "IMPORT"]))))
        files[name] = (parent, deps)
    return files


@pytest.mark.parametrize(("seed", "circular"), [(1, False), (4, True), (5, True)])
def test_library_effects_like_reading_step_by_step(spark, seed, circular):
    files = random_files(seed, circular)
    libraries, rejected = build.library_effects(*pom_tables(spark, files))
    found = {}
    for row in sorted(libraries.collect(), key=lambda row: (row.path, row.place)):
        found.setdefault(row.path.removesuffix("/pom.xml"), []).append((row.library_name, row.scope))
    want = {name: list(libraries_step_by_step(files, name).items()) for name in files}
    assert found == {name: listed for name, listed in want.items() if listed}
    assert circular or rejected.count() == 0


def test_build_files_never_go_to_the_driver(spark):
    """Numbered files pack to a few bytes each: millions of them would be broadcast for the size of their table."""
    poms = spark.createDataFrame([(1, "a/pom.xml", "a", "b"), (1, "b/pom.xml", "b", None)], "app_id long, path string, artifact_id string, parent_artifact_id string")
    named = spark.createDataFrame([(1, "b/pom.xml", 0, "g", "lib", "COMPILE")], "app_id long, path string, pos int, group_name string, library_name string, scope string")
    plans = []
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(build, "written", lambda df, keep=build.written: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df))
        assert build.library_effects(poms, named)[0].where("path = 'a/pom.xml'").first().library_name == "lib"
    assert len(plans) > 6 and not any("BroadcastHashJoin" in plan for plan in plans[1:])


def test_library_effects_report_circles(spark):
    files = {"xx": ("yy", []), "yy": ("xx", [("library", ("lib", "TEST"))]), "zz": ("xx", [("library", ("lib", "COMPILE"))])}
    libraries, rejected = build.library_effects(*pom_tables(spark, files))
    assert {tuple(row)[1:] for row in rejected.collect()} == {("xx/pom.xml", "xx/pom.xml"), ("yy/pom.xml", "yy/pom.xml")}
    assert {(row.path, row.scope) for row in libraries.collect()} == {("xx/pom.xml", "TEST"), ("yy/pom.xml", "TEST"), ("zz/pom.xml", "TEST")}


def test_shared_parents_cost_one_evaluation_each(spark):
    """20 levels that name the level below twice: 2**20 ways, 40 files."""
    files = {"a0": (None, [("library", ("c", "COMPILE")), ("library", ("t", "TEST"))]), "b0": (None, [("library", ("c", "RUNTIME"))])}
    for level in range(1, 21):
        files |= {f"{side}{level}": (f"a{level - 1}", [("file", f"b{level - 1}")]) for side in "ab"}
    poms, deps = pom_tables(spark, files)
    # Names are looked for inside of directories, so each needs an end of its own.
    names = {name: f"{name}z" for name in files}
    poms = poms.selectExpr("app_id", "concat(artifact_id, 'z/pom.xml') AS path", "concat(artifact_id, 'z') AS artifact_id", "concat(parent_artifact_id, 'z') AS parent_artifact_id")
    deps = deps.selectExpr("app_id", "concat(substring_index(path, '/', 1), 'z/pom.xml') AS path", "pos", "group_name", "CASE WHEN length(library_name) > 1 THEN concat(library_name, 'z') ELSE library_name END AS library_name", "scope")
    libraries, rejected = build.library_effects(poms, deps)
    found = {}
    for row in libraries.collect():
        found.setdefault(row.path.removesuffix("/pom.xml"), {})[row.library_name] = row.scope
    assert rejected.count() == 0
    assert found["a20z"] == found["b20z"] == {"c": "RUNTIME"}
    assert found["a0z"] == {"c": "COMPILE", "t": "TEST"} and len(names) == 42


# Placeholders


def resolved_step_by_step(rows):
    """Values of (doc, pos, name, value) with their references followed one at a time; None where they run in a circle."""
    def lookup(doc, name):
        near = [value for one, _, key, value in sorted(rows) if one == doc and key == name]
        far = [value for _, _, key, value in sorted(rows) if key == name]
        return near[0] if near else far[0] if far else None

    def fill(doc, text, trail):
        import re

        for name in dict.fromkeys(re.findall(r"\$\{(\w+)\}", text)):
            value = lookup(doc, name)
            if value is None:
                continue
            if name in trail:
                return None
            value = fill(doc, value, (*trail, name))
            if value is None:
                return None
            text = text.replace("${" + name + "}", value)
        return text

    return {(doc, pos): fill(doc, value, ()) for doc, pos, _, value in rows}


@pytest.mark.parametrize("seed", range(2))
def test_placeholders_like_following_them_one_by_one(spark, seed):
    draw = random.Random(seed)
    names = [f"k{at}" for at in range(9)]

    def value(at):
        return "".join(draw.choice(["x", "-", "${" + draw.choice([*names[at + 1 :], names[at]] if draw.random() < 0.1 else [*names[at + 1 :], "none"]) + "}"]) for _ in range(draw.randint(0, 4)))

    rows = [(doc, pos, names[at], value(at)) for doc in range(4) for pos, at in enumerate(draw.sample(range(9), 6))]
    df = spark.createDataFrame([("a", *row) for row in rows], "app_id string, doc_order int, pos_order int, name string, value string")
    out, rejected = config.resolve_placeholders(df, ["app_id"])
    want = resolved_step_by_step(rows)
    circular = {place for place, text in want.items() if text is None}
    assert {(row.doc_order, row.pos_order) for row in rejected.collect()} == circular
    given = {(doc, pos): text for doc, pos, _, text in rows}
    assert {(row.doc_order, row.pos_order): row.value for row in out.collect()} == {place: given[place] if text is None else text for place, text in want.items()}


def test_placeholders_a_thousand_deep(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(config, "written", lambda df, keep=config.written: rounds.append(1) or keep(df))
    links = spark.range(1001).selectExpr("'a' AS app_id", "0 AS doc_order", "int(id) AS pos_order", "concat('k', id) AS name", "IF(id = 1000, 'end', concat('${k', id + 1, '}-')) AS value")
    out, rejected = config.resolve_placeholders(links, ["app_id"])
    assert rejected.count() == 0
    assert {row.pos_order: row.value for row in out.collect()} == {at: "end" + "-" * (1000 - at) for at in range(1001)}
    assert len(rounds) <= 2 * 11 + 12

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fleetscope.operators import config as config_ops
from fleetscope.sources import config


YAML_CASES = [
    ("a: 1", ["a=1"]),
    ("a:\n  b: 1", ["a.b=1"]),
    ("a:\n  b:\n    c: 1\nd: 2", ["a.b.c=1", "d=2"]),  # back to the outer level
    ("a:\n\n  b: 1\n", ["a.b=1"]),  # blank lines count for nothing
    ("url: http://x:80/y", ["url=http://x:80/y"]),  # only the first colon splits
    ("e:f", ["e=f"]),  # no blank is needed behind it
    ("d: v # c", ["d=v"]),  # a comment behind a value
    ("key: # c", ["key="]),  # nothing but a comment
    ("# note: 1", []),  # a comment line
    ("a:\n  - x\n  - y", ["a=x", "a=y"]),  # items belong to the name above
    ("a:\n  - y: 2", ["a.y=2"]),  # an item with a name of its own
    ("- c: x:y", ["c=x:y"]),
    ("lonely", []),  # a value without a name
    ("---", ["---"]),
    ("a: 1\n---\nb: 2", ["a=1", "---", "b=2"]),
    ("a:\n  b:", []),  # names without value
    ("spring:\n  profiles: p,q # c\nz: # only", ["spring.profiles=p,q", "z="]),
]


LINE = st.tuples(
    st.sampled_from(["", "  ", "    ", "      "]),
    st.sampled_from(["a:", "b: 1", "- c: x:y", "- item", "# note: 1", "key: # c", "d: v # c", "---", "", "e:f", "-"]),
).map("".join)


def flattened(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "no int, content string")
    got = df.select("no", config.flatten_yaml(F.col("content")).alias("lines")).collect()
    return [row.lines for row in sorted(got)]


def test_yaml_cases(spark):
    got = flattened(spark, [text for text, _ in YAML_CASES])
    for (text, want), lines in zip(YAML_CASES, got, strict=True):
        assert lines == want, text


def test_yaml_of_any_lines(spark):
    texts = []

    @settings(max_examples=120, deadline=None, suppress_health_check=list(HealthCheck), database=None)
    @given(st.lists(LINE, max_size=150))
    def gather(lines):
        texts.append(lines)

    gather()
    whole = flattened(spark, ["\n".join(lines) for lines in texts])
    spread = flattened(spark, ["\n\n".join(lines) for lines in texts])
    longer = flattened(spark, ["\n".join([*lines, *lines, "end: 1"]) for lines in texts])
    for lines, got, blank, more in zip(texts, whole, spread, longer, strict=True):
        assert got == blank  # blank lines change nothing
        assert len(got) <= sum(bool(line.strip()) for line in lines)
        assert got.count("---") == sum(line.strip() == "---" for line in lines)
        assert all("=" in line for line in got if line != "---")
        # A name has as many parts as its line is indented, itself and an item mark counted.
        assert all(line.partition("=")[0].count(".") <= 4 for line in got)
        assert more[: len(got)] == got and more[-1] == "end=1"  # later lines change nothing before them


def test_properties_and_profiles(spark):
    files = spark.createDataFrame(
        [
            ("m", "m/application.yml", "a: 1\n---\nspring.profiles: x,y\nb: 2\n---\nc: 3\n", ""),
            ("m", "conf/shop-prod.yml", "a: b=c\n", "shop"),
            ("m", "m/bootstrap.properties", "a=1\nb=2 # no\n\n c : d \n", ""),
        ],
        "module string, path string, content string, app_name string",
    )
    rows = config.file_properties(config.config_lines(files)).collect()
    got = {(row.path, row.doc, row.pos, row.name, row.value, row.profile) for row in rows}
    assert got == {
        ("m/application.yml", 0, 0, "a", "1", "COMPILE"),
        ("m/application.yml", 1, 1, "spring.profiles", "x,y", "X;Y"),
        ("m/application.yml", 1, 2, "b", "2", "X;Y"),
        ("m/application.yml", 2, 3, "c", "3", "X;Y"),
        ("conf/shop-prod.yml", 0, 0, "a", "b=c", "PROD"),
        ("m/bootstrap.properties", 0, 0, "a", "1", "COMPILE"),
        ("m/bootstrap.properties", 0, 1, "c", "d", "COMPILE"),
    }


def test_placeholder_joins_never_go_to_the_driver(spark):
    """Resolved texts pack well: small files of them would be broadcast for their size."""
    properties = spark.createDataFrame(
        [("m", 0, 0, "a", "${b}-"), ("m", 0, 1, "b", "c"), ("m", 0, 2, "x", "${y}"), ("m", 0, 3, "y", "${x}")], "app string, doc_order int, pos_order int, name string, value string"
    )
    resolved, circular = config_ops.resolve_placeholders(properties, ["app"])
    assert sorted(row.value for row in resolved.collect()) == ["${x}", "${y}", "c", "c-"] and circular.count() == 2
    for df in (resolved, circular):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()

"""Compose texts in the forms that people write."""

from fleetscope.operators import deploy
from fleetscope.sources.compose import compose_entries, read_compose, read_dockerfiles, rejected_services

TEXT = """x-base: &base
  image: base:1
  logging: {driver: json}
services:
  plain:
    image: one:1 # {not a map}
    environment:
      - "*.example"
      - '&x'
    labels:
      note: "{braces}"
  merged:
    <<: *base
    build: .
  chained: &chained
    <<: *base
    image: own:2
  same: *chained
  flow: {image: 'two:2', build: {context: ./flow, args: [a, {b: c}]}, links: [plain, "merged"]}
  other:
    volumes: []
  lost:
    image: *nowhere
"""


def containers(spark, text):
    rows = read_compose(spark.createDataFrame([("a", "compose.yml", text)], "app_id string, path string, content string"))
    return rows, {row.container: (row.image, row.build, row.generates_logs) for row in deploy.merge_containers(rows).collect()}


def test_anchors_and_flow_maps(spark):
    rows, found = containers(spark, TEXT)
    assert found == {
        "plain": ("one:1", "", False),
        "merged": ("base:1", ".", True),
        "chained": ("own:2", "", True),
        "same": ("own:2", "", True),
        "flow": ("two:2", "./flow", False),
        "lost": ("*nowhere", "", False),
    }
    assert [(row.container, row.target) for row in deploy.container_links(rows).orderBy("dep_order").collect()] == [("flow", "plain"), ("flow", "merged")]


def test_rejects_name_the_service(spark):
    text = TEXT + "  broken: {image: x,\n    build: y}\n"
    files = spark.createDataFrame([("a", "compose.yml", text), ("a", "empty.yml", ""), ("a", "none.yml", None)], "app_id string, path string, content string")
    assert {tuple(row) for row in rejected_services(compose_entries(files)).collect()} == {
        ("a", "compose.yml", "lost", "alias without anchor"),
        ("a", "compose.yml", "broken", "flow map over several lines"),
    }


def test_without_services_key(spark):
    assert containers(spark, "db: {image: mysql}\nweb:\n  build: ./web\n")[1] == {"db": ("mysql", "", False), "web": ("", "./web", False)}


def test_compose_files_of_one_partition_are_parsed_in_several_tasks(spark):
    text = "services:\n  a:\n    image: x\n" + "# filler\n" * 2000
    files = spark.range(200).selectExpr("id AS app_id", "'compose.yml' AS path", f"'{text}' AS content").coalesce(1)
    rows = read_compose(files)
    assert rows.rdd.getNumPartitions() == 4  # 3.6 MB
    assert rows.count() == 200
    dockerfiles = spark.range(200).selectExpr("id AS app_id", "'a/Dockerfile' AS path", f"'FROM b\n{text}' AS content").coalesce(1)
    assert read_dockerfiles(dockerfiles).rdd.getNumPartitions() == 4


def test_dockerfiles_are_not_broadcast(spark):
    files = spark.createDataFrame([(1, "a/b/Dockerfile", "FROM x\nFROM y\nEXPOSE 9")], "app_id long, path string, content string")
    containers = spark.createDataFrame([(1, "c", "old", "./b"), (1, "d", "kept", "")], "app_id long, container string, image string, build string")
    overlaid, ports = deploy.dockerfile_overlay(containers, read_dockerfiles(files))
    assert {(row.container, row.image) for row in overlaid.collect()} == {("c", "y"), ("d", "kept")}
    assert [(row.container, row.port) for row in ports.collect()] == [("c", "9")]
    assert overlaid._jdf.queryExecution().optimizedPlan().toString().count("shuffle_hash") == 2

"""Which placeholders are filled in, and which directory a build path names."""

from pyspark.sql import functions as F

from fleetscope.operators import config, deploy

DEFAULTS = {
    "${server.port:8080}": "8080",
    "${a_b.c+1:x:y}": "x:y",
    "${name:a+b}/x": "a+b/x",
    "${my-name:x}": "${my-name:x}",  # a dash before a default
    "${name:a.b}": "${name:a.b}",  # a dot in a default
    "${name:}": "${name:}",
    "${:x}": "${:x}",
    "${.a:x}": "${.a:x}",
}
REFERENCES = {
    "${a.b}-${c-d}": ["a.b", "c-d"],
    "${a+1}${a+1}": ["a+1"],
    "${a[0}": ["a[0"],
    "${a b}": [],
    "${}": [],
    "$a": [],
}
PLACES = {
    "./users": "users",
    "../../svc/api/": "svc/api",
    "**/users": "users",
    "users.v1//": "users.v1",
    "/": "",
    ".": ".",
    "./": "",
    "..": ".",
    "": "",
}


def of(spark, texts, change):
    rows = spark.createDataFrame([(text,) for text in texts], "text string")
    return {row.text: row.made for row in rows.select("text", change(F.col("text")).alias("made")).collect()}


def test_defaults(spark):
    assert of(spark, DEFAULTS, config.apply_placeholder_defaults) == DEFAULTS


def test_references(spark):
    assert of(spark, REFERENCES, config._references) == REFERENCES


def test_places(spark):
    assert of(spark, PLACES, deploy.build_place) == PLACES

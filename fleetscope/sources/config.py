"""Configuration files as property rows. A file is one row, so lines are folded without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetscope.functions import let, running_states
from fleetscope.sources.files import file_name, text_lines

DOCUMENT_MARK = "---"
START_PROFILE = "COMPILE"
PROFILE_PROPERTY = "spring.profiles"

_STATE = "struct<path:array<string>,out:string>"


def _trimmed(line: Column) -> Column:
    return F.regexp_replace(line, r"^\s+|\s+$", "")


def flatten_yaml(content: Column) -> Column:
    """YAML text -> array of ``dotted.path=value`` lines and document marks, in file order.

    The path follows the indentation: one level per two blanks in front of the key, one more for a
    list dash. A line without a colon is a list item under the current path.
    """

    def parsed(line: Column) -> Column:
        def split(text: Column) -> Column:
            head = F.substring_index(text, ":", 1)
            has_colon = text.contains(":")
            key = _trimmed(head)
            indent = F.length(F.regexp_extract(line, r"^(\s*)", 1))
            level = F.floor(indent / 2).cast("int") + F.when(key.startswith("-"), 1).otherwise(0)
            behind = F.regexp_extract(text, "(?s)^[^:]*:([^#]*)", 1)
            raw_behind = F.regexp_extract(text, "(?s)^[^:]*:(.+)$", 1)
            return F.struct(
                (text == DOCUMENT_MARK).alias("mark"),
                has_colon.alias("keyed"),
                key.alias("key"),
                level.alias("level"),
                F.when(has_colon, behind).otherwise(F.regexp_replace(head, "^-+", "")).alias("value"),
                # An empty value is emitted when only a comment follows the colon.
                F.when(has_colon, (raw_behind != "") & (F.length(behind) > 0))
                .otherwise(F.length(F.regexp_replace(head, "^-+", "")) > 0)
                .alias("emits"),
                ((text != "") & ((text == DOCUMENT_MARK) | ~head.contains("#"))).alias("kept"),
            )

        return let(_trimmed(line), split)

    def step(state: Column, line: Column) -> Column:
        path = F.when(
            line["keyed"],
            F.concat(
                F.slice(state["path"], F.lit(1), F.least(line["level"], F.size(state["path"]))), F.array(line["key"])
            ),
        ).otherwise(state["path"])
        return let(
            path,
            lambda grown: F.struct(
                grown.alias("path"),
                F.when(line["mark"], F.lit(DOCUMENT_MARK))
                .when(
                    line["emits"] & (F.size(grown) > 0),
                    F.concat(
                        F.regexp_replace(F.regexp_replace(F.array_join(grown, "."), r"^\.+", ""), r"-\s", ""),
                        F.lit("="),
                        _trimmed(line["value"]),
                    ),
                )
                .alias("out"),
            ),
        )

    def fold(rows: Column) -> Column:
        zero = F.struct(F.array().cast("array<string>").alias("path"), F.lit(None).cast("string").alias("out"))
        states = running_states(rows, zero.cast(_STATE), lambda state, row: step(state, row).cast(_STATE))
        return F.array_compact(F.transform(states, lambda state: state["out"]))

    lines = F.filter(F.transform(text_lines(content), parsed), lambda row: row["kept"])
    return fold(lines)


def properties_lines(content: Column) -> Column:
    """Lines of a ``.properties`` file; a line with a ``#`` anywhere is dropped."""
    lines = F.transform(text_lines(content), _trimmed)
    return F.filter(lines, lambda line: (line != "") & ~line.contains("#"))


def config_lines(files: DataFrame) -> DataFrame:
    """Adds ``lines``, read by file extension; other files are dropped."""
    name = F.col("path")
    yaml = name.endswith(".yml") | name.endswith(".yaml")
    return files.where(yaml | name.endswith(".properties")).withColumn(
        "lines", F.when(yaml, flatten_yaml(F.col("content"))).otherwise(properties_lines(F.col("content")))
    )


def split_documents(lines: Column) -> Column:
    """Lines -> array of (doc, line): a mark closes a document and a leading mark leaves an empty one."""
    def numbered(rows: Column) -> Column:
        numbers = running_states(rows, F.lit(0), lambda doc, line: doc + F.when(line == DOCUMENT_MARK, 1).otherwise(0))
        return F.zip_with(numbers, rows, lambda doc, line: F.struct(doc.alias("doc"), line.alias("line")))

    return F.filter(let(lines, numbered), lambda pair: pair["line"] != DOCUMENT_MARK)


def split_key_value(line: Column) -> tuple[Column, Column]:
    """Split at the first ``=`` if there is one anywhere, else at the first ``:``; both sides trimmed."""
    key = F.when(line.contains("="), F.substring_index(line, "=", 1)).otherwise(F.substring_index(line, ":", 1))
    value = F.when(line.contains("="), F.regexp_extract(line, "(?s)^[^=]*=(.*)$", 1)).otherwise(
        F.regexp_extract(line, "(?s)^[^:]*:(.*)$", 1)
    )
    return _trimmed(key), _trimmed(value)


def start_profile(path: Column, app_name: Column) -> Column:
    """Text behind the application name in the file name, without dashes; else the default.

    The extension is stripped as a set of characters, like the original reader does.
    """
    name = file_name(path)
    stripped = F.when(name.endswith(".properties"), F.regexp_replace(name, "[.properties]+$", "")).otherwise(
        F.regexp_replace(name, "[.yml]+$", "")
    )
    behind = F.when(
        (F.coalesce(app_name, F.lit("")) != "") & (F.instr(stripped, app_name) > 0),
        F.substring(stripped, F.instr(stripped, app_name) + F.length(app_name), F.length(stripped)),
    )
    return F.when(behind != "", F.upper(F.regexp_replace(behind, "^-+", ""))).otherwise(START_PROFILE)


def file_rows(configs: DataFrame) -> DataFrame:
    """Rows with ``lines`` -> one row per property: doc, pos, name, value, profile.

    The profile is sticky: from a profile property on it holds to the end of the file, across
    documents. Before the first one it is missing, as the start profile depends on who reads the file.
    """
    keys = [column for column in configs.columns if column not in ("content", "lines")]

    def parsed(pair: Column) -> Column:
        name, value = split_key_value(pair["line"])
        return F.struct(pair["doc"].alias("doc"), name.alias("name"), value.alias("value"))

    def next_profile(profile: Column, row: Column) -> Column:
        return F.when(row["name"] == PROFILE_PROPERTY, F.upper(F.replace(row["value"], F.lit(","), F.lit(";")))).otherwise(
            profile
        )

    def with_profiles(rows: Column) -> Column:
        profiles = running_states(rows, F.lit(None).cast("string"), next_profile)
        return F.zip_with(
            rows, profiles, lambda row, profile: F.struct(row.alias("row"), profile.alias("profile"))
        )

    documents = configs.select(*keys, split_documents(F.col("lines")).alias("pairs"))
    rows = documents.select(*keys, F.posexplode(let(F.transform("pairs", parsed), with_profiles)).alias("pos", "item"))
    return rows.select(*keys, "pos", "item.row.doc", "item.row.name", "item.row.value", "item.profile")


def with_start_profile(rows: DataFrame) -> DataFrame:
    """Fill the missing profiles; an optional ``app_name`` column counts for centrally kept files."""
    app_name = F.col("app_name") if "app_name" in rows.columns else F.lit(None).cast("string")
    filled = F.coalesce("profile", start_profile(F.col("path"), app_name))
    return rows.withColumn("profile", filled).drop("app_name")


def file_properties(configs: DataFrame) -> DataFrame:
    """``file_rows`` with the start profile of every file."""
    return with_start_profile(file_rows(configs))


def application_name(properties: DataFrame, keys: list[str]) -> DataFrame:
    """First value per document, last document wins, in (phase, path, doc, pos) order."""
    order = F.struct("phase", "path", "doc", (-F.col("pos")).alias("pos"))
    return (
        properties.where(F.col("name") == "spring.application.name")
        .groupBy(*keys)
        .agg(F.max_by("value", order).alias("app_name"))
    )

"""Compose files and Dockerfiles as rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetscope.functions import let, running_states
from fleetscope.sources.files import balanced, directory, scan_artifacts, text_lines

_STATE = "struct<stack:array<struct<indent:int,key:string>>,value:string,item:boolean,mark:string>"
# ``mark`` is the first character of an unquoted value that is an alias, an anchor or a flow map; ``origin`` is empty for
# what a file says itself and has the places of the merges that a copied entry came through, outermost first.
_ENTRIES = "array<struct<path:array<string>,value:string,item:boolean,mark:string,origin:array<int>>>"
_FLOW = "struct<stack:array<struct<key:string,list:boolean>>,keyed:boolean,value:string>"
_FLOW_TOKEN = r"""("[^"]*"|'[^']*'|[{}\[\],]|[^{}\[\],"']+)"""
_MERGE = "<<"
COMPOSE_COLUMNS = ("app_id", "path", "pos", "container", "key", "sub", "value", "item")


def _unquoted(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\s+#.*$", ""), "^[\"']|[\"']$", "")


def _mark(raw: Column) -> Column:
    return F.regexp_extract(raw, r"^\s*([*&{])", 1)


def _flow_entries(entry: Column) -> Column:
    """A flow map on one line -> its entries below the path of ``entry``, whatever its depth.

    Brackets are levels of a stack; text in a map is a key up to its colon and then a value, text in a list is an item.
    """

    def step(state: Column, token: Column) -> Column:
        stack, top = state["stack"], F.get(state["stack"], F.size(state["stack"]) - 1)
        below = F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 1, F.lit(0)))
        nothing = F.lit(None).cast("string")

        def made(levels: Column, keyed: bool, value: Column) -> Column:
            return F.struct(levels.alias("stack"), F.lit(keyed).alias("keyed"), value.alias("value")).cast(_FLOW)

        def level(key: Column, is_list: bool) -> Column:
            return F.array(F.struct(key.alias("key"), F.lit(is_list).alias("list")))

        named = F.regexp_extract(token, r"^([^:]*?)\s*:(?:\s|$)", 1)
        behind = F.trim(F.regexp_extract(token, r"^[^:]*:\s*(.*)$", 1))
        return (
            F.when(token == "{", made(F.concat(stack, level(nothing, False)), False, nothing))
            .when(token == "[", made(F.concat(stack, level(nothing, True)), False, nothing))
            .when(token.isin("}", "]"), made(below, False, nothing))
            .when(token == ",", made(stack, False, nothing))
            .when(top["list"], made(stack, False, token))
            .when(state["keyed"], made(stack, True, token))
            .when(token.startswith(":"), made(stack, True, F.nullif(behind, F.lit(""))))
            .when(token.rlike("^[\"']"), made(F.concat(below, level(_unquoted(token), False)), False, nothing))
            .otherwise(made(F.concat(below, level(named, False)), True, behind))
        )

    def fold(tokens: Column) -> Column:
        zero = F.struct(F.array().alias("stack"), F.lit(False).alias("keyed"), F.lit(None).alias("value")).cast(_FLOW)
        states = F.filter(running_states(tokens, zero, step), lambda state: state["value"].isNotNull())
        return F.transform(
            states,
            lambda state: F.struct(
                F.concat(
                    entry["path"],
                    F.transform(F.filter(state["stack"], lambda one: one["key"].isNotNull()), lambda one: one["key"]),
                ).alias("path"),
                _unquoted(state["value"]).alias("value"),
                F.element_at(state["stack"], -1)["list"].alias("item"),
                _mark(state["value"]).alias("mark"),
                F.array().cast("array<int>").alias("origin"),
            ),
        )

    flow = F.regexp_replace(entry["value"], r"^&\S+\s+", "")
    tokens = F.transform(F.regexp_extract_all(flow, F.lit(_FLOW_TOKEN), F.lit(1)), lambda token: F.trim(token))
    return let(F.filter(tokens, lambda token: token != ""), fold)


def _with_flow_maps(entries: Column) -> Column:
    is_map = r"^(&\S+\s+)?\{.*\}$"
    return F.flatten(
        F.transform(
            entries,
            lambda entry: F.when(
                entry["mark"].isin("&", "{") & entry["value"].rlike(is_map),
                F.concat(
                    F.array(
                        entry.withField("value", F.regexp_replace(entry["value"], r"\{.*$", "")).withField(
                            "mark", F.regexp_replace(entry["mark"], r"\{", "")
                        )
                    ),
                    _flow_entries(entry),
                ).cast(_ENTRIES),
            ).otherwise(F.array(entry).cast(_ENTRIES)),
        )
    )


def _with_aliases(entries: Column) -> Column:
    """Entries with aliases replaced by what their anchors name, and merge keys by the entries of theirs.

    An anchor stands in front of its aliases, so one pass in file order is enough, also where anchors use each other.
    An alias without anchor stays as it is.
    """

    def copies(done: Column, entry: Column, merge: Column, name: Column, at: Column) -> Column:
        target = F.when(merge, F.slice(entry["path"], F.lit(1), F.size(entry["path"]) - 1)).otherwise(entry["path"])

        def of_anchor(anchor: Column) -> Column:
            depth = F.size(anchor["path"])
            inner = F.filter(
                done,
                lambda one: ~anchor["item"]
                & ((F.size(one["path"]) > depth) | ((F.size(one["path"]) == depth) & one["item"]))
                & (F.slice(one["path"], F.lit(1), depth) == anchor["path"]),
            )
            moved = F.transform(
                inner,
                lambda one: F.struct(
                    F.concat(target, F.slice(one["path"], depth + 1, F.size(one["path"]))).alias("path"),
                    one["value"].alias("value"), one["item"].alias("item"), one["mark"].alias("mark"),
                    F.concat(entry["origin"], F.when(merge, F.array(F.size(done) + at)).otherwise(F.array().cast("array<int>")), one["origin"]).alias("origin"),
                ),
            )
            plain = F.struct(
                target.alias("path"), F.regexp_replace(anchor["value"], r"^&\S+\s*", "").alias("value"),
                entry["item"].alias("item"), F.lit("").alias("mark"), entry["origin"].alias("origin"),
            )
            return F.concat(F.when(merge, F.array().cast(_ENTRIES)).otherwise(F.array(plain).cast(_ENTRIES)), moved.cast(_ENTRIES))

        anchors = F.filter(done, lambda one: (one["mark"] == "&") & (F.regexp_extract(one["value"], r"^&(\S+)", 1) == name))
        found = let(F.try_element_at(anchors, F.lit(-1)), lambda anchor: F.when(anchor.isNotNull(), of_anchor(anchor)))
        return F.coalesce(found, F.array(entry).cast(_ENTRIES))

    def step(done: Column, entry: Column) -> Column:
        merge = F.element_at(entry["path"], -1) == _MERGE
        names = F.regexp_extract_all(entry["value"], F.lit(r"\*([^\s,\]]+)"), F.lit(1))
        added = F.when(
            ~entry["item"] & merge | (entry["mark"] == "*"),
            F.flatten(F.transform(names, lambda name, at: copies(done, entry, merge, name, at))),
        ).otherwise(F.array(entry).cast(_ENTRIES))
        return F.concat(done, added)

    used = F.exists(entries, lambda entry: (entry["mark"] == "*") | (F.element_at(entry["path"], -1) == _MERGE))
    expanded = F.when(used, F.aggregate(entries, F.array().cast(_ENTRIES), step)).otherwise(entries)
    # What an anchor stands before is the value.
    return F.transform(
        expanded,
        lambda entry: entry.withField(
            "value", F.when(entry["mark"] == "&", F.regexp_replace(entry["value"], r"^&\S+\s*", "")).otherwise(entry["value"])
        ),
    )


def yaml_entries(content: Column) -> Column:
    """YAML -> array of (path, value, item, mark, origin): one entry per key and per list item.

    Block style, flow maps on one line, anchors, aliases and merge keys. Flow lists in block style stay values.
    """

    def parsed(line: Column) -> Column:
        bare = F.trim(line)
        item = bare.startswith("- ")
        body = F.when(item, F.trim(F.substring(bare, F.lit(2), F.length(bare)))).otherwise(bare)
        raw = F.trim(F.regexp_extract(body, r"^(?:\"[^\"]*\"|'[^']*'|[^:]*):(?:\s+(.*))?$", 1))
        return F.struct(
            F.length(F.regexp_extract(line, r"^( *)", 1)).alias("indent"),
            item.alias("item"),
            _unquoted(F.regexp_extract(body, r"^(\"[^\"]*\"|'[^']*'|[^:]*):(?:\s|$)", 1)).alias("key"),
            F.when(item, _unquoted(body)).otherwise(_unquoted(raw)).alias("value"),
            _mark(F.when(item, body).otherwise(raw)).alias("mark"),
        )

    def step(state: Column, line: Column) -> Column:
        # A list may start in the column of its own key, so an item keeps keys up to its own column.
        kept = F.filter(
            state["stack"],
            lambda entry: (entry["indent"] < line["indent"]) | (line["item"] & (entry["indent"] == line["indent"])),
        )
        pushed = F.concat(kept, F.array(F.struct(line["indent"].alias("indent"), line["key"].alias("key"))))
        return F.struct(
            F.when(line["item"], kept).otherwise(pushed).alias("stack"),
            line["value"].alias("value"),
            line["item"].alias("item"),
            line["mark"].alias("mark"),
        )

    def fold(rows: Column) -> Column:
        zero = F.struct(
            F.array().cast("array<struct<indent:int,key:string>>").alias("stack"),
            F.lit(None).cast("string").alias("value"),
            F.lit(False).alias("item"),
            F.lit("").alias("mark"),
        ).cast(_STATE)
        states = running_states(rows, zero, lambda state, row: step(state, row).cast(_STATE))
        return F.transform(
            states,
            lambda state: F.struct(
                F.transform(state["stack"], lambda entry: entry["key"]).alias("path"),
                state["value"].alias("value"),
                state["item"].alias("item"),
                state["mark"].alias("mark"),
                F.array().cast("array<int>").alias("origin"),
            ),
        )

    lines = F.filter(
        text_lines(content),
        lambda line: (F.trim(line) != "") & ~F.trim(line).startswith("#") & (F.trim(line) != "---"),
    )
    return let(let(let(F.transform(lines, parsed), fold), _with_flow_maps), _with_aliases)


def compose_entries(files: DataFrame) -> DataFrame:
    """(app_id, path, pos, container, key, sub, value, item, mark, usable): everything below a service, whatever it holds.

    Services stand at top level (version 1) or below ``services``. A key that a service has itself goes before a merged one,
    and of merged ones that of the earlier merge.
    """

    def of_file(entries: Column) -> Column:
        base = F.when(F.exists(entries, lambda e: F.get(e["path"], F.lit(0)) == "services"), 1).otherwise(0)
        return let(base, lambda at: of_services(entries, at))

    def of_services(entries: Column, base: Column) -> Column:
        numbered = F.transform(
            entries,
            lambda e, no: F.struct(
                no.alias("pos"),
                F.get(e["path"], base).alias("container"),
                F.get(e["path"], base + 1).alias("key"),
                F.get(e["path"], base + 2).alias("sub"),
                e["value"].alias("value"),
                e["item"].alias("item"),
                e["mark"].alias("mark"),
                e["origin"].alias("origin"),
                ((base == 0) | (F.get(e["path"], F.lit(0)) == "services")).alias("inside"),
            ),
        )
        # The line of the service itself stays for a map that could not be read.
        inside = F.filter(numbered, lambda e: e["inside"] & (e["key"].isNotNull() | (e["container"].isNotNull() & (e["mark"] != ""))))
        return let(inside, nearest)

    def nearest(entries: Column) -> Column:
        def first_said(entry: Column) -> Column:
            same = F.filter(entries, lambda e: e["container"].eqNullSafe(entry["container"]) & e["key"].eqNullSafe(entry["key"]))
            return F.array_min(F.transform(same, lambda e: e["origin"])) == entry["origin"]

        said = F.when(F.exists(entries, lambda e: F.size(e["origin"]) > 0), F.filter(entries, first_said)).otherwise(entries)
        return let(said, with_use)

    def with_use(entries: Column) -> Column:
        def containers(wanted: Callable[[Column], Column]) -> Column:
            return F.array_distinct(F.transform(F.filter(entries, wanted), lambda e: e["container"]))

        def marked(known: Column) -> Column:
            return F.transform(
                entries,
                lambda e: e.withField(
                    "usable",
                    e["key"].isNotNull() & F.array_contains(known["named"], e["container"]) & ~F.array_contains(known["broken"], e["container"]),
                ),
            )

        named, broken = containers(lambda e: e["key"].isin("build", "image")), containers(lambda e: e["mark"] == "{")
        return let(F.struct(named.alias("named"), broken.alias("broken")), marked)

    # Bound once by let(): a column used inside a lambda would be parsed again for every element.
    return (
        balanced(files.where(F.col("path").rlike(r"\.ya?ml$")).select("app_id", "path", "content"))
        .select("app_id", "path", F.inline(let(yaml_entries(F.col("content")), of_file)))
        .drop("inside", "origin")
    )


def services_of(entries: DataFrame) -> DataFrame:
    """Compose rows: the entries of services with ``build`` or ``image``, without those whose map could not be read."""
    return entries.where("usable").select(*COMPOSE_COLUMNS)


def rejected_services(entries: DataFrame) -> DataFrame:
    """(app_id, path, container, reason): aliases without anchor, and flow maps that don't end on their line."""
    unknown = (F.col("mark") == "*") | ((F.col("key") == _MERGE) & F.col("value").contains("*"))
    reason = F.when(unknown, "alias without anchor").when(F.col("mark") == "{", "flow map over several lines")
    return entries.select("app_id", "path", "container", reason.alias("reason")).where("reason IS NOT NULL").distinct()


def read_compose(files: DataFrame) -> DataFrame:
    """Compose rows: (app_id, path, pos, container, key, sub, value, item) of the services with ``build`` or ``image``."""
    return services_of(compose_entries(files))


def read_dockerfiles(files: DataFrame) -> DataFrame:
    """(app_id, path, line_no, directory, image, port): a line is a FROM or, without one, an EXPOSE."""
    lines = balanced(scan_artifacts(files, "Dockerfile").select("app_id", "path", "content")).select(
        "app_id",
        "path",
        directory(F.col("path")).alias("directory"),
        F.posexplode(F.transform(text_lines(F.col("content")), lambda line: F.trim(line))).alias("line_no", "line"),
    )
    image = F.regexp_extract("line", r"FROM\s+(.+)", 1)
    port = F.regexp_extract("line", r"EXPOSE\s+(.+)", 1)
    return (
        lines.select(
            "app_id",
            "path",
            "line_no",
            "directory",
            F.when(image != "", image).alias("image"),
            F.when((image == "") & (port != ""), port).alias("port"),
        )
        .where(F.col("image").isNotNull() | F.col("port").isNotNull())
    )

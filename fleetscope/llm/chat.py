"""Operator 10: chat formatting by incremental rendering of a black-box template.

The template is any function from turns to one string. It is rendered for the first turn, the first two and so on; what
a longer rendering adds to the one before is the span of its last turn. A template whose longer rendering doesn't begin
with the shorter one rewrites history (``rewrites_history``); its spans then begin where the two part. The text of a
turn is found inside its span as the template's escaped form, and the loss mask covers the texts of assistants.

The template here marks turns with ``<|im_start|>`` and ``<|im_end|>``. In texts a bar is added to every ``<|``, so no
text can hold a marker, and taking that bar away gives the text back. Roles escape line ends and backslashes as well.

Edge cases: a missing text or role counts as empty. Turns come in order of ``turn`` (missing first), then role and
text; repeated rows are turns of their own. Rows without ``conv_id`` form one conversation. A conversation is one
output record, so it has to fit a row; rendering all prefixes takes time with the square of its number of turns.
"""

from __future__ import annotations

from collections.abc import Callable
from hashlib import sha256
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
Turns = list[tuple[str, str]]


def escape(text: str) -> str:
    return text.replace("<|", "<||")


def unescape(text: str) -> str:
    return text.replace("<||", "<|")


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    parts = unescape(role).split("\\\\")
    return "\\".join(part.replace("\\n", "\n") for part in parts)


def render(turns: Turns) -> str:
    return "".join(f"{START}{escape_role(role)}\n{escape(text)}{END}\n" for role, text in turns)


def locate(turns: Turns, template: Callable[[Turns], str] = render) -> tuple[str, list[tuple[int, int]], bool]:
    """The whole rendering, the span of every turn in it, and whether the template rewrites earlier turns."""
    before, begins, rewrites = template([]), [], False
    for count in range(1, len(turns) + 1):
        after = template(turns[:count])
        if after.startswith(before):
            begins.append(len(before))
        else:
            rewrites = True
            begins.append(len(commonprefix([before, after])))
        before = after
    begins = [min(begins[at:]) for at in range(len(begins))] if rewrites else begins
    return before, list(zip(begins, [*begins[1:], len(before)], strict=True)), rewrites


def loss_spans(
    turns: Turns, whole: str, spans: list[tuple[int, int]], escaped: Callable[[str], str] = escape, closing: str = END + "\n"
) -> list[tuple[int, int]]:
    """Where the texts of the assistant's turns stand, before ``closing``; an empty span at -1 for a text that the
    template has changed."""
    made = []
    for (role, text), (start, end) in zip(turns, spans, strict=True):
        if role == "assistant":
            body, limit = escaped(text), end - len(closing)
            at = whole.rfind(body, start, limit) if body else limit
            made.append((at, at + len(body)) if at >= 0 else (-1, -1))
    return made


def read_turns(formatted: str, spans: list[tuple[int, int]]) -> Turns:
    """Roles and texts out of the formatted string alone, given the spans of the turns."""
    turns = []
    for start, end in spans:
        role, _, body = formatted[start:end].removeprefix(START).partition("\n")
        turns.append((unescape_role(role), unescape(body.removesuffix("\n").removesuffix(END))))
    return turns


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
FORMATTED = "conv_id long, formatted string, spans array<struct<start: long, end: long>>, loss array<struct<start: long, end: long>>, rewrites_history boolean"


def as_structs(spans: list[tuple[int, int]]) -> list[dict]:
    return [{"start": start, "end": end} for start, end in spans]


def format_conversations(
    rows: DataFrame, template: Callable[[Turns], str] = render, escaped: Callable[[str], str] = escape, closing: str = END + "\n"
) -> DataFrame:
    """One row per conversation: ``formatted``, the ``spans`` of its turns and of its ``loss`` mask in code points."""
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = rows.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    grouped = grouped.select("conv_id", F.col("turns.role").alias("roles"), F.col("turns.text").alias("texts"))

    def work(batches):
        for batch in batches:
            made = []
            for roles, texts in zip(batch.column("roles").to_pylist(), batch.column("texts").to_pylist(), strict=True):
                turns = list(zip(roles, texts, strict=True))
                whole, spans, rewrites = locate(turns, template)
                made.append((whole, as_structs(spans), as_structs(loss_spans(turns, whole, spans, escaped, closing)), rewrites))
            columns = [list(values) for values in zip(*made, strict=True)] or [[], [], [], []]
            kinds = (pa.string(), SPANS, SPANS, pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), *(pa.array(values, kind) for values, kind in zip(columns, kinds, strict=True))],
                ["conv_id", "formatted", "spans", "loss", "rewrites_history"],
            )

    return grouped.mapInArrow(work, FORMATTED)


def read_conversations(formatted: DataFrame) -> DataFrame:
    """Digests of the turns and of the loss mask, read back from ``formatted`` and its spans alone."""

    def work(batches):
        for batch in batches:
            rows = []
            for text, spans, loss in zip(*(batch.column(name).to_pylist() for name in ("formatted", "spans", "loss")), strict=True):
                turns = read_turns(text, [(span["start"], span["end"]) for span in spans])
                learned = "".join(unescape(text[span["start"] : span["end"]]) for span in loss)
                digest = sha256("".join(f"{role}\n{body}\n" for role, body in turns).encode()).hexdigest()
                rows.append((len(turns), digest, len(learned), sha256(learned.encode()).hexdigest(), len(text)))
            columns = [list(values) for values in zip(*rows, strict=True)] or [[]] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *(pa.array(v, k) for v, k in zip(columns, kinds, strict=True))], names)

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return formatted.select("conv_id", "formatted", "spans", "loss").mapInArrow(work, schema)

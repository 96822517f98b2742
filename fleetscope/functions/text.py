"""String expressions with the "no match gives the empty string" rule of the derivation language.

Each mentions its input once, so that nested use stays small in generated code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _literal(mark: str) -> str:
    return rf"\Q{mark}\E"


def after(text: Column, mark: str) -> Column:
    """Text behind the first ``mark``; empty when there is none."""
    return F.regexp_extract(text, f"(?s)^.*?{_literal(mark)}(.*)$", 1)


def before(text: Column, mark: str) -> Column:
    """Text in front of the first ``mark``; empty when there is none."""
    return F.regexp_extract(text, f"(?s)^(.*?){_literal(mark)}", 1)


def between(text: Column, left: str, right: str) -> Column:
    """Text behind the first ``left`` and in front of the first ``right`` after it."""
    return F.regexp_extract(text, f"(?s)^.*?{_literal(left)}(.*?){_literal(right)}", 1)


def quoted(text: Column) -> Column:
    """Content of the first pair of double quotes."""
    return between(text, '"', '"')


def contains_lit(text: Column, part: str) -> Column:
    return F.instr(text, part) > 0


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")

"""A single sortable long for "when, in the sequential reading of the facts, does this happen"."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Reading phases of one service, in order.
CONTAINER, LIBRARY, REGISTRY_PAIR, PROPERTY, TYPE, ANNOTATION, METHOD, REST_TEMPLATE, LISTENER, ASYNC = range(10)

_RULE_BITS = 6
_SEQ_LIMIT = 1 << 53
_PHASE_UNIT = 1 << 59


def order_key(phase: int, seq: Column, rule: Column | int = 0) -> Column:
    """Pack (phase, seq, rule) into one long so that min/max stay in hash aggregation.

    ``seq`` must be in [0, 2^53) and ``rule`` in [0, 64); anything else is an error, not another order.
    """
    rule_col = F.lit(rule) if isinstance(rule, int) else rule
    packed = F.lit(phase * _PHASE_UNIT) + seq.cast("long") * (1 << _RULE_BITS) + rule_col.cast("long")
    in_range = (seq >= 0) & (seq < _SEQ_LIMIT) & (rule_col >= 0) & (rule_col < 1 << _RULE_BITS)
    return F.when(in_range, packed).otherwise(F.raise_error(F.lit("seq outside [0, 2^53) or rule outside [0, 64)")).cast("long"))


def position(*parts: tuple[Column, int]) -> Column:
    """Numbers from outer to inner, each with its width in bits, as one long; a number that is too wide is an error."""
    if sum(width for _, width in parts) > 53:
        raise ValueError("a position has at most 53 bits")
    made = F.lit(0).cast("long")
    for number, width in parts:
        value = number.cast("long")
        fits = (value >= 0) & (value < 1 << width)
        checked = F.when(fits, value).otherwise(F.raise_error(F.lit(f"a position is wider than {width} bits")).cast("long"))
        made = made * (1 << width) + checked
    return made

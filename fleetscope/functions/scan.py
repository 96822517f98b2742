"""Running state over an array inside one row.

A text file is one row, so line-by-line state machines need neither a shuffle nor a window.
Appending to one long array copies it at every step; the scan therefore works on blocks:
first the state in front of every block, then every block from its own start state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def blocks_of(items: Column, width: int = BLOCK) -> Column:
    """Cut an array into sub-arrays of at most ``width`` elements."""
    count = F.floor((F.size(items) + F.lit(width - 1)) / F.lit(width)).cast("int")
    starts = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(items, i * F.lit(width) + 1, F.lit(width)))


def running_states(items: Column, zero: Column, step: Callable[[Column, Column], Column]) -> Column:
    """Inclusive running states: element i is the state after items 0..i."""

    def in_block(block: Column, start: Column) -> Column:
        grown = F.aggregate(
            block, F.array(start), lambda seen, item: F.concat(seen, F.array(step(F.element_at(seen, -1), item)))
        )
        return F.slice(grown, F.lit(2), F.size(block))

    def over_blocks(cut: Column) -> Column:
        starts = F.aggregate(
            cut,
            F.array(zero),
            lambda seen, block: F.concat(seen, F.array(F.aggregate(block, F.element_at(seen, -1), step))),
        )
        # One state per block plus the final one, which zip_with pairs with a null block.
        return F.flatten(F.zip_with(cut, F.slice(starts, F.lit(1), F.size(cut)), in_block))

    return let(items, lambda xs: let(blocks_of(xs), over_blocks))

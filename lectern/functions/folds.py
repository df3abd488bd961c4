"""Folds over long arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def collecting_fold(items: Column, start: Column, step: Callable[[Column, Column], Column], last: Callable[[Column], Column], done_type: str, block: int = 512) -> Column:
    """The lists that step puts into the state's field `done` (of type done_type, empty in start), one after the other, then last(state).

    Adding to a list copies it, so the items are folded in blocks and a list never holds more than a block's results.
    """
    none = F.array().cast(done_type)
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.size(items) - 1, F.lit(0)), F.lit(block)), lambda k: F.slice(items, k + 1, F.lit(block)))

    def whole_block(outer: Column, own: Column) -> Column:
        after = F.aggregate(own, outer["state"], step)
        # an array of one element, so that the block is folded once
        return F.element_at(F.transform(F.array(after), lambda s: F.struct(F.concat(outer["lists"], F.array(s["done"])).alias("lists"), s.withField("done", none).alias("state"))), 1)

    begin = F.struct(F.array().cast(f"array<{done_type}>").alias("lists"), start.alias("state"))
    return F.aggregate(blocks, begin, whole_block, lambda outer: F.concat(F.flatten(outer["lists"]), last(outer["state"])))

"""Positions, running sums and neighbours over groups of any size.

A window over a group puts it into one task. Here rows are dealt into ranges of their order, so that a hot group spans many tasks, and written
once; what the ranges need of each other is one row a range (their number is that of the session's shuffle partitions), summed up and
broadcast. Orders must be total.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.stages import Stages

_LOCAL = (1 << 33) - 1


class Dealt:
    """Rows of df in one order over all of them, written in ranges. Column __at rises with the order; __range is the range's number."""

    def __init__(self, df: DataFrame, order: Sequence[str]):
        self.space = Stages(df.sparkSession, "ranks")
        rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
        self.rows = self.space.put(rows, "rows").withColumn("__range", F.shiftright("__at", 33))

    def _before(self, sums: DataFrame, value: str, name: str) -> DataFrame:
        """Of a row a range: what the ranges before add up to."""
        span = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
        return self.space.put(sums.select("__range", F.coalesce(F.sum(value).over(span), F.lit(0)).alias("__before")), name)

    def numbered(self, out: str) -> DataFrame:
        """The rows with their number, from 0."""
        sizes = self.rows.groupBy("__range").agg(F.count("*").alias("n"))
        # one row a range
        before = F.broadcast(self._before(sizes, "n", "sizes"))
        return self.rows.join(before, "__range").withColumn(out, F.col("__before") + F.col("__at").bitwiseAND(F.lit(_LOCAL))).drop("__before", "__at", "__range")


def numbered(df: DataFrame, order: Sequence[str], out: str = "number") -> DataFrame:
    """df with the number of each row in the order, from 0."""
    return Dealt(df, order).numbered(out)


def positions(df: DataFrame, group: Sequence[str], order: Sequence[str], out: str = "position") -> DataFrame:
    """df with the place of each row in its group, from 0. Nulls in a group's columns are one group."""
    # read twice from the ranges, which are written: their first numbers without the other columns
    whole = numbered(df, [*group, *order], "__number")
    first = whole.groupBy(*[F.col(c).alias(f"__{c}") for c in group]).agg(F.min("__number").alias("__first"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in group])
    return whole.join(first, same).withColumn(out, F.col("__number") - F.col("__first")).select(*df.columns, out)


def running(df: DataFrame, order: Sequence[str], value: Column, out: str) -> DataFrame:
    """df with the sum of value over the rows up to and with this one."""
    dealt = Dealt(df.withColumn("__value", value), order)
    sums = dealt.rows.groupBy("__range").agg(F.sum("__value").alias("n"))
    before = F.broadcast(dealt._before(sums, "n", "sums"))
    inside = F.sum("__value").over(Window.partitionBy("__range").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0))
    return dealt.rows.withColumn("__own", inside).join(before, "__range").withColumn(out, F.col("__before") + F.col("__own")).drop("__before", "__own", "__value", "__at", "__range")


def with_previous(df: DataFrame, group: Sequence[str], order: Sequence[str], columns: Mapping[str, str]) -> DataFrame:
    """df with values of the row before in the group: {new column: column}; null in a group's first row."""
    own = Stages(df.sparkSession, "previous").put(numbered(df, [*group, *order], "__number"), "numbered")
    names = [f"__{c}" for c in group]
    last = own.select((F.col("__number") + 1).alias("__number"), *[F.col(c).alias(n) for c, n in zip(group, names)], *[F.col(c).alias(new) for new, c in columns.items()])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(n)) for c, n in zip(group, names)], F.lit(True))
    joined = own.join(last, "__number", "left").withColumn("__same", same)
    return joined.select(*df.columns, *[F.when(F.col("__same"), F.col(new)).alias(new) for new in columns])

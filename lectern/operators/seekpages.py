"""Deep pages over a table written once in its order.

The rows are dealt into ranges of the order, sorted and written, a folder a range; a second table has the number of rows before each
range. A page opens the folders of the ranges that it overlaps, whatever its offset, where sorting would read everything again.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.errors import InvalidParams
from lectern.stages import Stages

_LOCAL = (1 << 33) - 1


class SeekTable:
    """Pages of df in an order that must be total."""

    def __init__(self, df: DataFrame, order: list[Column], ranges: int | None = None):
        spark = df.sparkSession
        self.columns = df.columns
        space = Stages(spark, "pages")
        dealt = df.repartitionByRange(ranges, *order) if ranges else df.repartitionByRange(*order)
        at = F.monotonically_increasing_id()
        rows = dealt.sortWithinPartitions(*order).withColumns({"__range": F.shiftright(at, 33).cast("int"), "__place": at.bitwiseAND(F.lit(_LOCAL))})
        rows.write.partitionBy("__range").parquet(f"{space.path}/rows")
        self.rows = spark.read.schema(rows.select(*df.columns, "__place", "__range").schema).parquet(f"{space.path}/rows")
        sizes = self.rows.groupBy("__range").agg(F.count("*").alias("n"))
        # one row a range
        before = F.coalesce(F.sum("n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        self.ranges = space.put(sizes.withColumn("before", before), "ranges")

    @property
    def total(self) -> int:
        return self.ranges.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def page(self, limit: int, offset: int = 0) -> DataFrame:
        """Rows offset..offset+limit in the order."""
        if offset < 0 or limit < 0:
            raise InvalidParams("limit and offset can't be negative")
        # a page's ranges: as many as it has rows at most, and those of the whole table
        own = {r["__range"]: r["before"] for r in self.ranges.where((F.col("before") < offset + limit) & (F.col("before") + F.col("n") > offset)).select("__range", "before").collect()}
        before = F.lit(None).cast("long")
        for k, n in own.items():
            before = F.when(F.col("__range") == k, F.lit(n).cast("long")).otherwise(before)
        number = before + F.col("__place")
        rows = self.rows.where(F.col("__range").isin(list(own))).withColumn("__number", number)
        return rows.where((F.col("__number") >= offset) & (F.col("__number") < offset + limit)).orderBy("__number").select(*self.columns)

    def pages(self, limit: int) -> Iterator[DataFrame]:
        """All pages, one after the other."""
        if limit < 1:
            raise InvalidParams("a page needs a row")
        for offset in range(0, self.total, limit):
            yield self.page(limit, offset)

"""Pages of a written table against slices of the sorted rows."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.errors import InvalidParams
from lectern.operators.seekpages import SeekTable


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    return [(k, r.choice([None, "a", "b", "c"]), r.randint(0, 50)) for k in range(1003)]


def ordered(rows):
    return sorted(rows, key=lambda x: (-x[2], x[1] is not None, x[1] or "", x[0]))


@pytest.fixture(scope="module")
def seek(spark, rows):
    return SeekTable(spark.createDataFrame(rows, "k int, a string, n int").repartition(5), [F.desc("n"), F.asc_nulls_first("a"), F.asc("k")], ranges=13)


@pytest.mark.parametrize("limit, offset", [(0, 5), (1, 0), (10, 0), (50, 495), (400, 333), (10, 998), (5, 1003), (2000, 0)])
def test_pages(seek, rows, limit, offset):
    assert [tuple(x) for x in seek.page(limit, offset).collect()] == ordered(rows)[offset : offset + limit]


def test_all_pages_and_total(seek, rows):
    assert seek.total == 1003
    assert [tuple(x) for p in seek.pages(250) for x in p.collect()] == ordered(rows)
    for bad in ((-1, 0), (1, -1)):
        with pytest.raises(InvalidParams):
            seek.page(*bad)


def test_a_deep_page_opens_few_files(spark):
    deep = SeekTable(spark.range(2_000_000).select("id", F.md5(F.col("id").cast("string")).alias("h")), [F.col("h")], ranges=64)
    page = deep.page(50, 1_000_000)
    plan = page._jdf.queryExecution().executedPlan().toString()
    opened = page.select(F.input_file_name().alias("f")).distinct().count()
    assert "__range#" in plan.split("PartitionFilters: [")[1].split("PushedFilters")[0] and opened <= 2 and page.count() == 50


def test_empty(spark):
    none = SeekTable(spark.createDataFrame([], "k int"), [F.col("k")])
    assert none.total == 0 and none.page(10).count() == 0 and list(none.pages(5)) == []

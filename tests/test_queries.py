"""Every registered query of the engine against its SQL on DuckDB, at the smallest scale."""

import os

import duckdb
import pandas as pd
import pytest

from lectern.plans.catalogue import QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in sorted(os.listdir(DATA)):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    return con


def cell(v) -> str:
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return "NULL"
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return str(int(v)) if v.is_integer() else f"{v:.6g}"
    return str(v)


def rows(df: pd.DataFrame) -> list[str]:
    return sorted("|".join(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name].run(spark, DATA).toPandas()
    want = duck.execute(QUERIES[name].sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_imports_without_llm(spark):
    import __spark_entry__

    assert "lexical_hits" in __spark_entry__.queries() and "lexical_hits" in __spark_entry__.oracle_sql()

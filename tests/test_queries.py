"""Every query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


def rows(df: pd.DataFrame) -> list:
    def one(x):
        if x is None or x is pd.NaT or (isinstance(x, float) and x != x):
            return "NULL"
        return f"{x:.6g}" if isinstance(x, float) else str(x)

    return sorted(tuple(one(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if not n.startswith("op") and n != "pipeline"])
def test_query(spark, duck, name):
    got, want = entry.queries()[name](spark, DIR).toPandas(), duck.execute(entry.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0

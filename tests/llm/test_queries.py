"""Every corpus query with SQL against DuckDB on the smallest tables."""

import pytest

import __spark_entry__ as entry

from ..test_queries import DIR, duck, pytestmark, rows  # noqa: F401


@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if n.startswith("op")])
def test_query(spark, duck, name):  # noqa: F811
    got, want = entry.queries()[name](spark, DIR).toPandas(), duck.execute(entry.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_each_operator_has_one_query():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and "pipeline" in entry.queries()

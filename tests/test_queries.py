"""Every query with SQL against DuckDB on the smallest tables; every other query gives rows."""

from __future__ import annotations

import datetime
from pathlib import Path

import duckdb
import pytest
from lintel import queries

SMALL = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for p in SMALL.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, bool | datetime.datetime):
        return str(v)
    return f"{v:.6f}" if isinstance(v, float) else str(v)


def sorted_rows(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, tables, name):
    df = queries.queries()[name](spark, str(SMALL))
    found = tables.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(columns)
    got, want = sorted_rows(df.collect(), df.columns), sorted_rows(found.fetchall(), columns)
    assert len(got) == len(want)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_query_gives_rows(spark, name):
    assert queries.queries()[name](spark, str(SMALL)).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

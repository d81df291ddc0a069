import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from loomline.plans import registry


@pytest.fixture(scope="module")
def tables(small):
    con = duckdb.connect()
    for name in os.listdir(small):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{small}/{name}'")
    return con


def plain(rows):
    cell = lambda v: None if pd.isna(v) else f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted((tuple(map(cell, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_queries_equal_their_sql(spark, small, tables, name):
    out = entry.queries()[name](spark, small)
    columns = sorted(out.columns)
    rows = [tuple(r) for r in out.select(*columns).collect()]
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    found = tables.sql(sql).df().astype(object)
    assert sorted(found.columns) == columns
    assert plain(rows) == plain(found[columns].values.tolist())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())

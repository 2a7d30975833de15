"""Every registered query that has SQL equals it in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from gridloom import queries as cube_queries

SF = "/root/testdata/sf0.001"


def rows_of(names, rows):
    """Rows with columns in the order of their names, as comparable values."""
    at = sorted(range(len(names)), key=lambda i: names[i])
    plain = lambda x: None if x is None or isinstance(x, float) and math.isnan(x) else round(x + 0.0, 6) if isinstance(x, float) else x
    return sorted((tuple(plain(r[i]) for i in at) for r in rows), key=str)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in os.listdir(SF):
        c.execute(f"create view {name.removesuffix('.parquet')} as select * from '{SF}/{name}'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(cube_queries.oracle_sql()))
def test_equals_sql(spark, con, name):
    df = entry_module.queries()[name](spark, SF)
    rel = con.sql(cube_queries.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(rel.columns, rel.fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_entry(spark):
    assert entry_module.entry(spark).count() == 10
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())

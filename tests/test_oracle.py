"""Every registered query with SQL gives the rows that the SQL gives in another engine, over the smallest tables."""

import math
import os
from collections import Counter

import duckdb
import pytest

from loomspan import suite
from loomspan.sources.tables import SCHEMAS

SF = "/root/testdata/sf0.001"
QUERIES, SQL = suite.queries(), suite.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for name in SCHEMAS:
        path = f"{SF}/{name}.parquet"
        c.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return c


def cell(v):
    if isinstance(v, float):
        return None if math.isnan(v) else f"{v + 0.0:.5f}"
    return v if v is None or isinstance(v, (str, bool)) else str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, con, name):
    df = QUERIES[name](spark, SF)
    relation = con.sql(SQL[name])
    names = sorted(df.columns)
    assert names == sorted(relation.columns)
    got = Counter(tuple(cell(r[c]) for c in names) for r in df.collect())
    want = Counter(tuple(cell(v) for v in row) for row in relation.select(*[duckdb.ColumnExpression(c) for c in names]).fetchall())
    assert got == want


def test_the_flagship_query(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["Factory", "Unit", "Line", "checked", "dhu"]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_queries_without_sql_run(spark, name):
    assert QUERIES[name](spark, SF).columns

"""Every registered query of the log engine against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from logweave.plans import oracles, queries

SF = "/root/testdata/sf0.001"
QUERIES, SQL = queries.queries(), oracles.oracle_sql()


def normal(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return bytes(v) if isinstance(v, bytearray) else v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    return c


def test_sql_is_for_queries():
    assert SQL.keys() == QUERIES.keys()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(repr(tuple(normal(r[c]) for c in columns)) for r in df.collect())
    if name not in SQL:
        assert rows
        return
    result = con.execute(SQL[name])
    at = [x[0] for x in result.description]
    assert sorted(at) == columns
    assert sorted(repr(tuple(normal(r[at.index(c)]) for c in columns)) for r in result.fetchall()) == rows

"""Every field query against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from tensorfold.queries import ORACLES, QUERIES

TABLES = "orders lineitem events embeddings"


@pytest.fixture(scope="module")
def duck(tiny):
    con = duckdb.connect()
    for name in TABLES.split():
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tiny}/{name}.parquet'")
    return con


def order(row):
    return tuple((v is None, v) for v in row)


def test_queries_without_sql_run(spark, tiny):
    for name in QUERIES.keys() - ORACLES.keys():
        assert QUERIES[name](spark, tiny).count() > 0


@pytest.mark.parametrize("name", ORACLES)
def test_query(spark, duck, tiny, name):
    found = QUERIES[name](spark, tiny)
    columns = sorted(found.columns)
    expected = sorted((r for r in duck.sql(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall()), key=order)
    got = sorted((tuple(r[c] for c in columns) for r in found.collect()), key=order)
    assert len(got) == len(expected)
    for a, b in zip(got, expected):
        assert a == b or all(x == y or (x is not None and y is not None and math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-6)) for x, y in zip(a, b)), (a, b)

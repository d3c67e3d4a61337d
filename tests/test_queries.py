"""Each query with SQL against DuckDB, over the smallest tables."""

import math
import os

import pytest

from strandframe.plans import queries, sequence_queries  # noqa: F401  it adds to the queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("no test data")
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return con


def rows(found, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    show = lambda v: f"{v:.9g}" if isinstance(v, float) and not math.isnan(v) else str(v)
    return sorted(tuple(show(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    sql = duck.sql(queries.ORACLE[name])
    assert sorted(df.columns) == sorted(sql.columns)
    assert rows(df.collect(), df.columns) == rows(sql.fetchall(), sql.columns)

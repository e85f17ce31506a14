"""Every registered query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from meshlens.plans import assembly_queries, graph_queries, history_queries, ingest_queries, registry, review_queries, search_queries, tool_queries, traversal_queries  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def text(v):
    return repr(v) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(text(r[c]) for c in cols) for r in df.collect())
    r = duck.execute(registry.ORACLES[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    want = sorted(tuple(text(x[names.index(c)]) for c in cols) for x in r.fetchall())
    assert got == want

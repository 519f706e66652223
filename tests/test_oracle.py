"""Every query with SQL against DuckDB, at the smallest scale."""

import os

import duckdb
import pytest

from cairn.plans.registry import QUERIES, SQL

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(D):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{D}/{f}'")
    return c


def plain(v):
    if v is None or v != v:
        return None
    return float(v) if isinstance(v, float) else int(v) if isinstance(v, (bool, int)) else str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, D)
    cols = sorted(df.columns)
    rel = duck.sql(SQL[name])
    assert sorted(rel.columns) == cols
    key = lambda r: tuple((x is None, str(x)) for x in r)
    ours = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=key)
    at = [rel.columns.index(c) for c in cols]
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=key)
    assert ours == theirs

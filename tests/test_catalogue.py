"""Registered queries against their SQL, on the smallest tables."""

import os

import pytest

from sedgeflow import catalogue

DATA = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in os.listdir(DATA):
        if t.endswith(".parquet"):
            c.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{t}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    made = catalogue.queries()[name](spark, DATA)
    cur = duck.execute(catalogue.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(made.columns)
    rows = sorted(tuple(repr(r[c]) for c in sorted(cols)) for r in made.collect())
    want = sorted(tuple(repr(r[cols.index(c)]) for c in sorted(cols)) for r in cur.fetchall())
    assert rows == want

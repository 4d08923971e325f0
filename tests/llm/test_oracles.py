"""Queries that SQL can express against their SQL twins, on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from lumentide.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    df = QUERIES[name](spark, DATA)
    names = sorted(df.columns)
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    out = c.sql(ORACLES[name])
    assert sorted(out.columns) == names
    kinds = dict(df.dtypes)
    assert {n: str(t) for n, t in zip(out.columns, out.types)} == {n: {"bigint": "BIGINT", "string": "VARCHAR", "boolean": "BOOLEAN"}[kinds[n]] for n in names}
    want = c.sql(f"SELECT {', '.join(names)} FROM out").fetchall()
    assert sorted((tuple(r) for r in df.select(*names).collect()), key=repr) == sorted(want, key=repr)

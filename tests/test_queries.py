"""Every registered query against its SQL twin, on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from lumentide.plans.catalogue import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(v):
    return round(v, 9) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, DATA)
    names = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*names).toArrow().to_pandas(integer_object_nulls=True).astype(object).where(lambda d: d.notna(), None).itertuples(index=False)), key=repr) if name in ORACLES else df.collect()
    if name not in ORACLES:
        assert got
        return
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    out = c.sql(ORACLES[name])
    assert sorted(out.columns) == names
    want = c.sql(f"SELECT {', '.join(names)} FROM out").fetchall()
    assert got == sorted((tuple(map(plain, r)) for r in want), key=repr)

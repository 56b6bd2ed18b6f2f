"""Every query with SQL gives the rows of DuckDB on the same tables; the others give rows."""

import glob
import math
import os

import duckdb
import pytest

from codepend import registry

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for p in glob.glob(f"{DIR}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return v


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, db, name):
    got = registry.queries()[name](spark, DIR)
    rows = got.collect()
    if name not in registry.oracle_sql():
        return
    want = db.sql(registry.oracle_sql()[name])
    names = sorted(want.columns)
    assert sorted(got.columns) == names
    at = [want.columns.index(c) for c in names]
    key = lambda r: tuple(map(str, r))
    a = sorted((tuple(plain(r[c]) for c in names) for r in rows), key=key)
    b = sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=key)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert all(p == q or (isinstance(p, float) and isinstance(q, (int, float)) and abs(p - q) < 2e-5) for p, q in zip(x, y)), (x, y)

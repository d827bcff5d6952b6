"""Every core query with SQL against DuckDB on the smallest tables."""

import glob
import math
import os
from collections import Counter

import pytest

from tidewatch.plans import registry

DATA = "/root/testdata/sf0.001"


def _tidy(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 4)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_tidy(x) for x in v)
    return round(float(v), 4) if type(v).__name__ == "Decimal" else v


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def compare(spark, duck, query, sql):
    df = query(spark, DATA)
    columns = sorted(df.columns)
    cur = duck.execute(sql)
    theirs = [d[0] for d in cur.description]
    assert sorted(theirs) == columns
    at = [theirs.index(c) for c in columns]
    want = Counter(repr(tuple(_tidy(r[i]) for i in at)) for r in cur.fetchall())
    got = Counter(repr(tuple(_tidy(r[c]) for c in columns)) for r in df.collect())
    assert got == want


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, duck, name):
    compare(spark, duck, registry.QUERIES[name], registry.ORACLES[name])

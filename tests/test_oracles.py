"""Every query that has SQL gives the rows of that SQL."""

import glob
import math
import os
from collections import Counter
from datetime import date, datetime
from decimal import Decimal

import duckdb
import pytest

from tidewell import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


def plain(v):
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if isinstance(v, date) and not isinstance(v, datetime):
        return datetime(v.year, v.month, v.day)
    if isinstance(v, list):
        return tuple(map(plain, v))
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p).removesuffix('.parquet')} AS SELECT * FROM '{p}'")
    return con


def test_all_queries_have_sql():
    assert set(SQL) <= set(QUERIES)
    assert len(SQL) >= 60


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_its_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    cur = duck.execute(SQL[name])
    names = [c[0] for c in cur.description]
    want = cur.fetchall()
    assert sorted(got.columns) == sorted(names)
    cols = sorted(names)
    a = Counter(tuple(plain(r[c]) for c in cols) for r in got.collect())
    b = Counter(tuple(plain(dict(zip(names, r, strict=True))[c]) for c in cols) for r in want)
    assert a == b
    assert a, "an empty result checks nothing"

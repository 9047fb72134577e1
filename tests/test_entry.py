"""Every registered query runs on the smallest tables and agrees with its SQL."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return str(v)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, sql, name):
    df = entry.queries()[name](spark, DATA)
    rows = df.collect()
    if name not in entry.oracle_sql():
        return
    cur = sql.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    want = sorted(tuple(plain(dict(zip(cols, r, strict=True))[c]) for c in sorted(cols)) for r in cur.fetchall())
    assert sorted(tuple(plain(r[c]) for c in sorted(cols)) for r in rows) == want

"""Every registered query runs on the smallest data; those with SQL agree with it."""

import decimal
import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()


def plain(v):
    if isinstance(v, float):
        return None if v != v else v + 0.0
    if isinstance(v, decimal.Decimal):
        return float(v)
    return str(v) if isinstance(v, (list, tuple, dict)) or hasattr(v, "asDict") else v


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def test_names():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith("p") or n.startswith(("p1_", "p2_"))))
def test_query(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    assert len(set(df.columns)) == len(df.columns)
    if name in SQL:
        cur = duck.execute(SQL[name])
        names = [d[0] for d in cur.description]
        assert sorted(names) == cols
        want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=str)
        assert len(got) == len(want)
        for g, w in zip(got, want):
            assert g == w or all(a == b or (isinstance(a, float) and isinstance(b, float) and abs(a - b) <= 2e-6 * max(1, abs(b))) for a, b in zip(g, w)), (g, w)


def test_entry(spark, data):
    assert entry.entry(spark).columns

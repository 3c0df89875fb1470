"""Registered queries against their SQL on the smallest tables; the driver does the same on larger ones."""

import decimal
import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()


def normal(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(normal, v))
    return v


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    rows = df.collect()
    r = duck.execute(SQL[name])
    columns = [x[0] for x in r.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    mine = sorted(repr(tuple(normal(x[c]) for c in order)) for x in rows)
    theirs = sorted(repr(tuple(normal(x[columns.index(c)]) for c in order)) for x in r.fetchall())
    assert mine == theirs


def test_names():
    assert set(SQL) <= set(QUERIES) and {"p2_found", "p4_found"} <= set(QUERIES)


def test_entry(spark, data):
    assert entry.entry(spark).columns[0] == "gt_id"

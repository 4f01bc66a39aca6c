"""Every query against its SQL in DuckDB over the small tables."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_point

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return 0.0 if v == 0 else round(v, 9)
    return v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


ENGINE = [n for n in entry_point.catalog.QUERIES]


@pytest.mark.parametrize("name", ENGINE)
def test_query(spark, duck, name):
    got = entry_point.queries()[name](spark, DATA)
    data = [tuple(r) for r in got.collect()]
    assert data
    sql = entry_point.oracle_sql().get(name)
    if sql:
        want = duck.execute(sql)
        names = [c[0] for c in want.description]
        there = want.fetchall()
        assert sorted(names) == sorted(got.columns)
        a, b = rows(got.columns, data), rows(names, there)
        assert len(a) == len(b)
        for x, y in zip(a, b, strict=True):
            assert all(p == q or isinstance(p, float) and math.isclose(p, q, abs_tol=1e-6) for p, q in zip(x, y, strict=True)), (x, y)


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0

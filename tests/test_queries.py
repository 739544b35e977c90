"""Every registered core query runs; those with SQL give the same rows on a second engine."""

import math
import os

import duckdb
import pytest

from mossgrid.plans.oracle import ORACLE
from mossgrid.plans.queries import QUERIES

D = os.environ.get("MOSSGRID_TEST_DATA", "/root/testdata/sf0.001")


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    return round(float(value), 5) if isinstance(value, float) else value


@pytest.fixture(scope="module")
def engine():
    con = duckdb.connect()
    for f in os.listdir(D):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{D}/{f}'")
    return con


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, engine, name):
    df = QUERIES[name](spark, D)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in ORACLE:
        return
    result = engine.execute(ORACLE[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    want = [dict(zip(names, row, strict=True)) for row in result.fetchall()]
    assert got == sorted((tuple(plain(r[c]) for c in columns) for r in want), key=repr)


def test_sql_belongs_to_queries():
    assert set(ORACLE) <= set(QUERIES)

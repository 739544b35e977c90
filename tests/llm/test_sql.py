"""The queries with SQL give the same rows on a second engine."""

import os

import duckdb
import pytest

from mossgrid.llm.queries import ORACLE, QUERIES

D = os.environ.get("MOSSGRID_TEST_DATA", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", list(ORACLE))
def test_query(spark, name):
    con = duckdb.connect()
    for f in os.listdir(D):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{D}/{f}'")
    df = QUERIES[name](spark, D)
    columns = sorted(df.columns)
    got = sorted(tuple(r[c] for c in columns) for r in df.collect())
    result = con.execute(ORACLE[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(dict(zip(names, r, strict=True))[c] for c in columns) for r in result.fetchall())


@pytest.mark.parametrize("name", [q for q in QUERIES if q not in ORACLE])
def test_others_run(spark, name):
    assert QUERIES[name](spark, D).count() > 0

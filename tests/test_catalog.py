"""Registered queries against their SQL twins on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest
from conftest import TESTDATA

import __spark_entry__ as entry_module

QUERIES, ORACLES = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{TESTDATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-6)
    return a == b


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, TESTDATA)
    columns = sorted(df.columns)
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    result = duck.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = [tuple(r[names.index(c)] for c in columns) for r in result.fetchall()]

    def key(row):  # rows are matched on everything but the last digits of floats
        return tuple((v is None, "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)) for v in row)

    got.sort(key=key)
    want.sort(key=key)
    assert len(got) == len(want)
    assert all(all(map(same, a, b)) for a, b in zip(got, want))


def test_entry_runs(spark):
    df = entry_module.entry(spark)
    assert df.count() == 4 and "r2_mean" in df.columns

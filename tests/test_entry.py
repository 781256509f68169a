import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from sparkloom.plans.queries import ORACLE, QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def cell(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    return f"{float(v):.4f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v).removesuffix(" 00:00:00")


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    rows = [r.asDict() for r in df.collect()]
    if name not in ORACLE:
        assert rows
        return
    result = duck.sql(ORACLE[name])
    names = sorted(result.columns)
    assert sorted(df.columns) == names
    at = [result.columns.index(n) for n in names]
    want = sorted([cell(r[i]) for i in at] for r in result.fetchall())
    assert sorted([cell(r[n]) for n in names] for r in rows) == want

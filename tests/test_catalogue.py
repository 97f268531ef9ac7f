"""Every core query against its SQL on the smallest tables, and the driver contract."""

import collections
import glob
import math
import os

import pytest

import __spark_entry__ as entry
from quaesta.plans import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def norm(v):
    if isinstance(v, bool) or v is None or isinstance(v, (int, str)):
        return v
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    if hasattr(v, "__float__"):
        return "nan" if math.isnan(v) else round(float(v), 5) + 0.0
    return v


@pytest.fixture(scope="module")
def con():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_same_as_sql(spark, con, name):
    df = catalogue.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rel = con.sql(catalogue.SQL[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    got = collections.Counter(tuple(norm(r[c]) for c in cols) for r in df.collect())
    assert got == collections.Counter(tuple(norm(r[i]) for i in at) for r in rel.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_runs(spark, name):
    catalogue.QUERIES[name](spark, SF).count()


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0

"""Every analytics query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__
from voxelry.plans import catalogue

def plain(v):
    return round(v, 6) + 0.0 if isinstance(v, float) else v


@pytest.fixture(scope="module")
def oracle(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{sf}/{f}')")
    return con


@pytest.mark.parametrize("name", list(catalogue.oracle_sql()))
def test_matches_sql(spark, sf, oracle, name):
    df = catalogue.queries()[name](spark, sf)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    result = oracle.execute(catalogue.oracle_sql()[name])
    there = [d[0] for d in result.description]
    want = sorted((tuple(plain(r[there.index(c)]) for c in names) for r in result.fetchall()), key=repr)
    assert names == sorted(there)
    assert got == want


def test_all_have_sql():
    assert set(catalogue.queries()) == set(catalogue.oracle_sql())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

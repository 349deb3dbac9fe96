"""The entry point: names, and each query against its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__
from tessera.plans.catalogue import ORACLES, QUERIES

TABLES = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_names():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(QUERIES) <= set(__spark_entry__.queries())


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(TABLES):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{TABLES}/{f}'")
    return con


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, duck, name):
    got = QUERIES[name](spark, TABLES).toPandas()
    want = duck.execute(ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda df: sorted(map(str, df[columns].astype(str).values.tolist()))
    assert rows(got) == rows(want)


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no tables")
def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0

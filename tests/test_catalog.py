"""Every registered query of the library against its SQL, at the smallest scale."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from statuta.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(x):
    return round(x, 9) if isinstance(x, float) and math.isfinite(x) else x


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    want = duck.sql(catalog.SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    got = sorted(repr([plain(r[c]) for c in want.columns]) for r in df.collect())
    assert got == sorted(repr([plain(x) for x in r]) for r in want.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_filter_and_columns_reach_the_scan(spark):
    plan = catalog.QUERIES["metadata_filter_scan"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_totalprice" in plan and "In(o_orderstatus" in plan and "o_comment" not in plan.split("ReadSchema")[1].split("\n")[0]

"""Every registered query against its oracle SQL on the smallest supplied tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from check_oracles import TABLES, canonical
from gridsonde.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="supplied tables not present")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_every_query_has_an_oracle():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)
    assert set(catalog.QUERIES) <= set(entry.queries()) and set(catalog.ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_oracle(spark, con, name):
    df = entry.queries()[name](spark, SF)
    got, columns = canonical(df.collect(), df.columns)
    cur = con.execute(entry.oracle_sql()[name])
    want, names = canonical(cur.fetchall(), [d[0] for d in cur.description])
    assert columns == names
    assert got == want
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["cid", "d26", "z20", "mld", "ild", "blt", "tchp"] and df.count() > 0

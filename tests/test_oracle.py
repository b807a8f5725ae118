"""Every registered query against its DuckDB oracle on the smallest driver tables."""

import os

import duckdb
import pytest

from tools.check_oracle import TABLES, normalise

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")

from __spark_entry__ import entry, oracle_sql, queries  # noqa: E402

QUERIES = queries()
ORACLES = oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def test_every_query_has_an_oracle():
    from threadwatch.plans import catalog
    assert set(catalog.QUERIES) == set(catalog.ORACLES) and set(ORACLES) <= set(QUERIES)


def test_entry_smoke(spark):
    df = entry(spark)
    assert df.count() >= 0 and "offensive_score" in df.columns


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    exp = duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(exp.columns)
    assert normalise(got) == normalise(exp)

"""Every query of the catalog against its SQL on the smallest tables; those on text have tests of their own."""

import duckdb
import pytest

import __spark_entry__ as contract
from barloom.catalog import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages".split()
SLOW = {"fit_huber_windows", "score_ml"}  # covered by tests/test_scoring.py


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SLOW))
def test_query_matches_sql(spark, duck, name):
    df = contract.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    sql = contract.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    cursor = duck.execute(sql)
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    places = [names.index(c) for c in df.columns]
    expected = [tuple(row[i] for i in places) for row in cursor.fetchall()]
    assert sorted(map(repr, rows)) == sorted(map(repr, expected))


def test_entry_is_the_daily_top_ten(spark):
    df = contract.entry(spark)
    assert df.columns == ["date", "ticker", "score", "rank"]
    assert df.agg({"rank": "max"}).first()[0] <= 10

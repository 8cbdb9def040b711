"""Every named query against its SQL, over whole tables."""

import compare
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return compare.duck(SF)


def test_every_sql_has_a_query():
    assert not set(SQL) - set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in SQL:
        assert not compare.differences(df, SQL[name], con)
    else:
        assert df.count() > 0


def test_entry(spark):
    rows = entry.entry(spark).collect()
    scores = [r["Score"] for r in rows]
    assert scores and scores == sorted(scores, reverse=True) and min(scores) >= 6000

"""Queries over many more orders than usual, whose longitudes run on past 180, against their SQL."""

import compare
import pytest

import __spark_entry__ as entry

SHIFTS = (0, 7_859_700, 8_400_000)  # the second one lies on both sides of 180
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def far(tmp_path_factory):
    folder, con = str(tmp_path_factory.mktemp("far")), compare.duck("/root/testdata/sf0.001")
    for t in compare.TABLES:
        key = {"lineitem": "l_orderkey", "orders": "o_orderkey"}.get(t)
        rows = f"select t.* replace ({key} + s as {key}) from {t} t, (values {', '.join(f'({s})' for s in SHIFTS)}) r(s)" if key else f"select * from {t}"
        if t == "lineitem":  # lines that the order of an order's lines leaves open would be a difference
            rows += " qualify row_number() over (partition by l_orderkey + s, l_linenumber, l_partkey, l_suppkey order by l_extendedprice) = 1"
        con.execute(f"copy ({rows}) to '{folder}/{t}.parquet'")
    return folder


@pytest.mark.parametrize("name", ["assign_chunks_long_edges", "near_dup_pairs", "climb_metrics", "category_counts", "run_metrics", "connectivity_report"])
def test_far_longitudes(spark, far, name):
    assert not compare.differences(QUERIES[name](spark, far), SQL[name], compare.duck(far))

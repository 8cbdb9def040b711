"""Duplicate removal against a plain restatement."""

import random

import pytest
from greedy import first_kept

from spark_climbs.operators import dedup

METRE = 1 / 111194.93
SCHEMA = "seq long, start_lat double, start_lon double, end_lat double, end_lon double"


def kept(spark, segments):
    rows = [(seq, *start, *end) for seq, start, end in segments]
    return sorted(r.seq for r in dedup.dedup_near(spark.createDataFrame(rows, SCHEMA)).collect())


def crowd(seed, n, spread_m, lat=45.0, lon=7.0):
    rnd = random.Random(seed)

    def near(lat, lon):
        return (lat + rnd.uniform(0, spread_m) * METRE, lon + rnd.uniform(0, spread_m) * METRE)

    return [(seq, near(lat, lon), near(lat + 0.01, lon)) for seq in range(n)]


def test_drops_only_what_a_kept_segment_rules_out(spark):
    end = (45.1, 7.0)
    line = [(k, (45.0 + 8 * k * METRE, 7.0), end) for k in range(3)]
    assert kept(spark, line) == [0, 2]


@pytest.mark.parametrize("seed,n,spread", [(1, 60, 30), (2, 80, 25), (3, 60, 12)])
def test_same_as_one_scan(spark, seed, n, spread):
    segments = crowd(seed, n, spread)
    segments += [(1000 + s, a, b) for s, a, b in segments[:20]]  # exact copies
    random.Random(seed).shuffle(segments)
    segments = [(k, a, b) for k, (_, a, b) in enumerate(segments)]
    assert kept(spark, segments) == first_kept(segments)


def test_antimeridian_and_pole(spark):
    segments = [
        (0, (10.0, 179.99999), (10.1, 0.0)),
        (1, (10.0, -179.99999), (10.1, 0.0)),
        (2, (89.99999, 10.0), (10.1, 0.0)),
        (3, (89.99999, -170.0), (10.1, 0.0)),
    ]
    assert kept(spark, segments) == first_kept(segments) == [0, 2]


def test_invalid_ends_stay(spark):
    rows = [(0, 95.0, 0.0, 1.0, 1.0), (1, 95.0, 0.0, 1.0, 1.0), (2, None, None, 1.0, 1.0)]
    assert dedup.dedup_near(spark.createDataFrame(rows, SCHEMA)).count() == 3


def test_exact(spark):
    rows = [(0, [1, 2]), (1, [2, 1]), (2, []), (3, [])]
    df = spark.createDataFrame(rows, "seq long, way_ids array<long>")
    assert sorted(r.seq for r in dedup.dedup_exact(df).collect()) == [0, 2, 3]


def test_near_duplicates_explain(spark):
    segments = crowd(5, 40, 20)
    rows = [(seq, *a, *b) for seq, a, b in segments]
    pairs = dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    survivors = first_kept(segments)
    assert sorted(p.dropped_seq for p in pairs) == sorted({s[0] for s in segments} - set(survivors))
    assert all(p.kept_seq in survivors and p.kept_seq < p.dropped_seq for p in pairs)

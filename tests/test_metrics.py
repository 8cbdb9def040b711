import pytest
from greedy import metres
from pyspark.sql import functions as F

from spark_climbs.operators import metrics

NODES = "seq long, pos int, lat double, lon double, elevation double"


def climbs(spark, rows, **kw):
    nodes = metrics.single_piece_nodes(spark.createDataFrame(rows, NODES))
    return metrics.climb_profiles(metrics.piece_profiles(nodes)).collect()


def test_gain_only_counts_ascent_in_node_order(spark):
    row = climbs(spark, [(1, k, 0.001 * k, 0.0, 300.0 - 100 * k) for k in range(3)])[0]
    assert (row.elevation_gain, row.height, row.prominence) == (0.0, 200.0, 200.0)


def test_nodes_without_elevation_are_bridged(spark):
    row = climbs(spark, [(1, 0, 0.0, 0.0, 10.0), (1, 1, 0.5, 0.5, None), (1, 2, 0.001, 0.0, 20.0)])[0]
    assert row.length_km * 1000 == pytest.approx(metres((0, 0), (0.001, 0)))


def test_no_distance_is_no_climb(spark):
    assert climbs(spark, [(1, 0, 0.0, 0.0, 10.0), (1, 1, 0.0, 0.0, 50.0)]) == []
    assert climbs(spark, [(1, 0, 0.0, 0.0, 10.0), (1, 1, 0.1, 0.0, None)]) == []


def test_standing_pair_has_no_grade(spark):
    row = climbs(spark, [(1, 0, 0.0, 0.0, 10.0), (1, 1, 0.0, 0.0, 50.0), (1, 2, 0.001, 0.0, 60.0)])[0]
    assert row.max_grade == pytest.approx(10 / metres((0, 0), (0.001, 0)) * 100)


def test_pieces_combine_like_one_line(spark):
    line = [(0.001 * k, 0.0005 * (k % 3), 100.0 + (37 * k) % 29) for k in range(12)]
    whole = climbs(spark, [(1, k, *p) for k, p in enumerate(line)])[0]
    rows = []
    for piece, (start, stop, turned) in enumerate([(0, 5, False), (5, 9, True), (9, 12, False)]):
        part = line[start:stop][::-1] if turned else line[start:stop]
        rows += [(piece, k, *p, 1, piece, turned) for k, p in enumerate(part)]
    nodes = spark.createDataFrame(rows, NODES + ", road_id long, road_pos int, reversed boolean")
    split = metrics.climb_profiles(metrics.piece_profiles(nodes)).first()
    for name in whole.__fields__:
        a, b = whole[name], split[name]
        assert a == b or a == pytest.approx(b, rel=1e-12), name


def test_minimum_score_is_inclusive(spark):
    df = spark.createDataFrame([(1, 6000.0), (2, 5999.99)], "road_id long, climb_score double")
    assert [r.road_id for r in metrics.rank_climbs(df).collect()] == [1]


def test_single_segments_are_roads_of_one_piece_without_a_second_shuffle(spark):
    rows = [(s, 0, False, s, p, 35.0 + p * 0.01 * s, -82.0 + p * 0.02, e) for s, heights in enumerate(([1.0, 5.5, 3.25], [7.0, None, 9.0], [2.0], [None], [4.0, 4.0])) for p, e in enumerate(heights)]
    nodes = spark.createDataFrame(rows, "road_id long, road_pos int, reversed boolean, seq long, pos int, lat double, lon double, elevation double")
    single = metrics.climbing(metrics.single_profiles(nodes.drop("road_id", "road_pos", "reversed")))
    merged = metrics.climb_profiles(metrics.piece_profiles(nodes))
    assert single._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert single.dtypes == merged.dtypes
    assert sorted(map(tuple, single.collect())) == sorted(map(tuple, merged.collect())) and single.count() == 3

"""What is shuffled and read how often."""

import pytest

from spark_climbs import fixtures as X
from spark_climbs import materialize
from spark_climbs.operators import merge, roads
from spark_climbs.plans import catalog
from spark_climbs.sources import overpass

SF = "/root/testdata/sf0.001"


def test_nodes_of_ways_are_shuffled_once(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = X.plain_ways(spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange hashpartitioning") == 2  # lines and orders


def test_tags_of_ways_are_made_once(spark):
    named = roads.derive_road_attributes(X.with_tags(spark, SF, spark.range(9).withColumnRenamed("id", "way_id")))
    plan = named._jdf.queryExecution().executedPlan().toString()
    assert plan.count("map_from_entries") == 1  # not in the filter by name too


def test_scan_tasks_carry_more_rows_than_they_cost(spark):
    assert merge._scan_tasks(spark.range(30_000)) == 1
    assert merge._scan_tasks(spark.range(200_000)) == 10


def test_node_merge_reads_its_segments_once(spark):
    assert not any("lineitem" in f for f in catalog.merge_by_node_id(spark, SF).inputFiles())


@pytest.fixture
def written(monkeypatch):
    """Labels of the tables that ``materialize`` writes, whoever calls it."""
    labels = []

    def note(df, label, *more):
        labels.append(label)
        return materialize.materialize(df, label, *more)

    for module in (catalog, overpass):
        monkeypatch.setattr(module, "materialize", note, raising=False)
    return labels


def test_documents_are_parsed_once(spark, written):
    ways = catalog.overpass_ways(spark, SF)
    assert written == ["elements"] and not any("lineitem" in f for f in ways.inputFiles())


def test_elevation_cache_writes_coordinates_and_source_once(spark, written):
    catalog.elevation_cache(spark, SF)
    assert written == ["coords", "elevation"]


def test_near_duplicates_store_ends_only(spark, written):
    catalog.near_dup_pairs(spark, SF)
    assert written == ["ends", "exact"]


def test_nodes_of_single_ways_are_made_once_and_stay_long(spark, written):
    climbs = catalog.single_way_climbs(spark, SF)
    assert written == ["nodes", "climbs"] and not any("lineitem" in f for f in climbs.inputFiles())
    report = catalog.single_way_report(spark, SF)
    assert written == ["nodes", "climbs", "nodes"]  # its climbs are written by the pipeline
    assert not any("lineitem" in f for f in report.inputFiles())

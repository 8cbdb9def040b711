"""Nothing in, nothing out."""

from spark_climbs import fixtures as X
from spark_climbs.operators.graph import components
from spark_climbs.operators.merge import merge_by_node_id
from spark_climbs.operators.roads import segments_from_ways
from spark_climbs.plans.pipeline import analyze_area

SF = "/root/testdata/sf0.001"


def test_components_without_edges(spark):
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
    assert components(spark.createDataFrame([(3, 3)], "u long, v long")).collect() == [(3, 3)]


def test_area_without_roads(spark):
    report = analyze_area(X.plain_ways(spark, SF), X.elevation(spark, SF), X.places(spark, SF), (-60.0, 10.0), 5.0)
    assert report.count() == 0 and len(report.columns) == 17


def test_in_chunk_merge_without_ways(spark):
    assert merge_by_node_id(segments_from_ways(X.plain_ways(spark, SF).filter("way_id < 0"))).count() == 0

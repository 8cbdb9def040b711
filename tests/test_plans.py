"""What plans must and must not contain, and behaviour under skew."""

import random

import pytest
from pyspark.sql import functions as F

from spark_climbs import fixtures as X
from spark_climbs.materialize import discard, drop_intermediates, materialize
from spark_climbs.operators import area, dedup, elevation, metrics, places, roads
from spark_climbs.plans import catalog

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name",
    ["dedup_exact", "assign_chunks", "assign_chunks_circle", "climb_metrics", "attach_location", "resolve_region", "geocode", "run_metrics", "sample_elevation_grid"],
)
def test_no_cross_joins(spark, name):
    text = plan(catalog.all_queries()[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_radius_reaches_the_scan(spark, tmp_path):
    """By nodes alone, and by edges of a known length."""
    X.way_nodes(spark, SF).write.parquet(str(tmp_path / "nodes"))
    nodes = spark.read.parquet(str(tmp_path / "nodes"))
    for df, edge, columns in ((nodes.drop("idx"), None, ""), (nodes, 10.0, "idx:int,")):
        text = plan(area.within_radius(df, 36.0, -81.9, 5.0, longest_edge_km=edge))
        assert "PushedFilters: [IsNotNull(lat), IsNotNull(lon), GreaterThanOrEqual(lat" in text
        assert f"ReadSchema: struct<way_id:bigint,{columns}lat:double,lon:double>" in text


def test_whole_ways_need_no_shuffle(spark, tmp_path):
    X.plain_ways(spark, SF).write.parquet(str(tmp_path / "ways"))
    ways = spark.read.parquet(str(tmp_path / "ways"))
    ends = roads.segment_ends(roads.segments_from_ways(area.ways_within_radius(ways, 36.0, -81.9, 5.0)))
    assert "Exchange" not in plan(ends)


def test_profiles_sort_and_shuffle_once(spark):
    nodes = spark.range(10).selectExpr(
        "id % 3 as seq", "id as pos", "1.0D as lat", "2.0D as lon", "3.0D as elevation", "id as road_id", "0 as road_pos", "false as reversed"
    )
    text = plan(metrics.piece_profiles(nodes))
    assert text.count("Exchange") == 1 and text.count(" Sort [") == 1


def test_a_third_of_all_rows_in_one_place(spark):
    """Copies, and near copies, of one segment."""
    rnd = random.Random(1)
    far = [(k, 40.0 + k * 0.01, 7.0, 41.0, 7.0) for k in range(2000)]
    copies = [(10_000 + k, 50.0, 7.0, 50.1, 7.0) for k in range(1000)]
    near = [(20_000 + k, 50.0 + rnd.uniform(0, 2e-5), 7.0, 50.1, 7.0) for k in range(1000)]
    df = spark.createDataFrame(far + copies + near, "seq long, start_lat double, start_lon double, end_lat double, end_lon double")
    kept = {r.seq for r in dedup.dedup_near(df).collect()}
    assert kept == set(range(2000)) | {10_000}


def test_crowded_coordinate_joins_whole(spark):
    nodes = spark.range(3000).select(F.lit(1.0).alias("lat"), (F.when(F.col("id") % 3 == 0, 1.0).otherwise(F.col("id") * 0.01)).alias("lon"))
    elev = elevation.distinct_coords(nodes).withColumn("elevation", F.lit(5.0))
    assert elevation.attach_elevation(nodes, elev).filter("elevation = 5").count() == 3000


def test_intermediates_can_be_dropped(spark):
    table = materialize(spark.range(3).toDF("x"), "t")
    assert table.count() == 3
    folder = table.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
    import os

    assert os.path.isdir(folder)
    drop_intermediates(spark)
    assert not os.path.isdir(folder)


def test_tables_of_earlier_rounds_can_be_deleted(spark):
    import os

    table = materialize(spark.range(3).toDF("x"), "t")
    folder = table.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
    discard(table, None, spark.range(2))
    assert not os.path.isdir(folder)


def test_areas_of_addresses_and_regions(spark):
    """What an address or a name leads to is analysed, each as if alone."""
    from spark_climbs import fixtures as X
    from spark_climbs.operators import places
    from spark_climbs.plans import pipeline

    sf = "/root/testdata/sf0.001"
    gazetteer = spark.createDataFrame([("1 Hill Rd, USA", 35.3, -82.0, "1 Hill Rd")], "query string, lat double, lon double, address string")
    addresses = spark.createDataFrame([("home", "1 Hill Rd", "USA"), ("lost", "Nowhere", None)], "address_id string, address string, country string")
    bounds = spark.createDataFrame([("state", 0, "highland", 35.6, -82.0, 30.0)], "kind string, ord int, name string, lat double, lon double, radius_km double")
    regions = places.resolve_region(spark.createDataFrame([("Highland",)], "name string"), bounds, "state")
    areas = places.address_areas(places.geocode(addresses, gazetteer), 25.0).unionByName(places.region_areas(regions))
    rows = {r["area_id"]: r for r in areas.collect()}
    assert set(rows) == {"home", "Highland"}
    ways, elevation, towns = X.ways(spark, sf), X.elevation(spark, sf), X.places(spark, sf)
    many = pipeline.analyze_areas(ways, elevation, towns, areas, seq=X.seq()).toPandas()
    for name, r in rows.items():
        alone = pipeline.analyze_area(ways, elevation, towns, (r["center_lat"], r["center_lon"]), r["radius_km"], seq=X.seq()).toPandas()
        mine = many[many.area_id == name].drop(columns="area_id").reset_index(drop=True)
        assert len(alone) and mine.equals(alone)

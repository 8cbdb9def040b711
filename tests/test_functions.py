"""Hand cases of scalar functions."""

import pytest
from pyspark.sql import functions as F

from spark_climbs.functions import geo, scoring, tags, text
from spark_climbs.operators import roads


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def tag_map(values):
    if values is None:
        return F.lit(None).cast("map<string,string>")
    flat = [F.lit(v) for pair in values.items() for v in pair]
    return F.create_map(*flat) if flat else F.create_map().cast("map<string,string>")


@pytest.mark.parametrize(
    "values,name",
    [
        ({"name": "  ", "ref": "A1"}, ""),
        ({"name": "", "ref": "A1"}, "A1"),
        ({"highway": "track"}, "track"),
        ({"name": "　Main\t", "highway": "service"}, "Main"),
        (None, None),
    ],
)
def test_street_name(spark, values, name):
    assert one(spark, tags.street_name(tag_map(values))) == name


@pytest.mark.parametrize(
    "values,surface",
    [
        ({"surface": " Asphalt "}, "asphalt"),
        ({"highway": "trunk_link"}, "unknown"),
        ({"highway": " Track "}, "unpaved"),
        ({"highway": "service"}, "paved"),
        ({}, "unknown"),
        (None, "unknown"),
    ],
)
def test_surface(spark, values, surface):
    assert one(spark, tags.surface(tag_map(values))) == surface


@pytest.mark.parametrize(
    "values,kind,definition",
    [
        ({"highway": "track", "tracktype": "Grade2 "}, "grade2", tags.TRACKTYPE_DEFINITIONS["grade2"]),
        ({"highway": "track", "tracktype": "gradeX"}, "gradex", "Unknown tracktype: gradex"),
        ({"highway": "track"}, "unspecified", "Track with unspecified surface quality"),
        ({"highway": "path"}, "not_applicable", "Not a track"),
        (None, "unknown", "No tracktype information"),
    ],
)
def test_tracktype(spark, values, kind, definition):
    assert one(spark, tags.tracktype(tag_map(values))) == kind
    assert one(spark, tags.tracktype_definition(tag_map(values))) == definition


@pytest.mark.parametrize(
    "kind,highway,surface,kept",
    [
        ("paved", "trunk_link", None, True),
        ("paved", "track", None, False),
        ("paved", "service", "fine_gravel", False),
        ("gravel", "service", "fine_gravel", True),
        ("gravel", "service", None, False),
        ("dirt", "path", "asphalt", True),
        ("all", "footway", None, False),
        ("anything", "path", None, True),
    ],
)
def test_surface_filter(spark, kind, highway, surface, kept):
    test = roads.surface_predicate(F.lit(highway), F.lit(surface).cast("string"), kind)
    assert bool(one(spark, test)) == kept


@pytest.mark.parametrize(
    "score,category",
    [(80000.0, "1"), (80000.01, "HC"), (64000.5, "1"), (32000.0, "3"), (8000.0, "N/A"), (8000.01, "4")],
)
def test_category(spark, score, category):
    assert one(spark, scoring.climb_category(F.lit(score))) == category


@pytest.mark.parametrize(
    "name,renamed",
    [
        ("USGS_13_n06e162.tif", "USGS_13_n05e162_renamed.tif"),
        ("USGS_13_n00e010.tif", "USGS_13_s01e010_renamed.tif"),
        ("USGS_13_s14w170.tif", "USGS_13_s15w170_renamed.tif"),
        ("USGS_13_s00w170.tif", "USGS_13_s01w170_renamed.tif"),
        ("readme.txt", None),
    ],
)
def test_shifted_tile_name(spark, name, renamed):
    assert one(spark, text.shifted_tile_name(F.lit(name))) == renamed


@pytest.mark.parametrize(
    "name,converted", [("a.hgt.zip", "a.tif"), ("a.hgt", "a.tif"), ("a.zip", "a.tif"), ("a.b.c", "a.b.tif"), ("a", "a.tif")]
)
def test_converted_file_name(spark, name, converted):
    assert one(spark, text.converted_file_name(F.lit(name))) == converted


def test_tile_names(spark):
    assert one(spark, text.tile_url(F.lit("s14w170.tif"), "base")) == "base/s14w170/USGS_13_s14w170.tif"
    assert one(spark, text.repacked_tile_name(F.lit("N37E051"))) == "N37E051.SRTMGL1.repacked.hgt.zip"
    assert one(spark, text.url_file_name(F.lit("http://x/y/z.zip"))) == "z.zip"


def test_analysis_names(spark):
    base = text.analysis_base_id(F.lit("1 Elm St, Old Fort"), F.lit("all"), F.lit(16.0934))
    assert one(spark, base) == "1ElmStOldFort_all_160934km"
    export = text.export_name(F.lit("1 Elm St., Old "), F.lit("all"), F.lit("address"), F.lit(16.5))
    assert one(spark, export) == "climbs_1_Elm_St_Old_all_address_16km"


def test_geo(spark):
    assert one(spark, geo.haversine_km(0.0, 0.0, 0.0, 1.0)) == pytest.approx(111.19492664)
    assert one(spark, geo.haversine_km(0.0, 179.5, 0.0, -179.5)) == pytest.approx(111.19492664)
    assert one(spark, geo.coord_key(F.lit(-35.1234567))) == -35123457
    assert one(spark, geo.valid_coord(F.lit(91.0), F.lit(0.0))) is None
    assert one(spark, geo.valid_coord(F.lit(None).cast("double"), F.lit(0.0))) is None
    assert one(spark, geo.lon_difference(F.lit(-179.0), 179.0)) == pytest.approx(2.0)


def test_osm_link(spark):
    assert one(spark, scoring.osm_link(F.lit(7))) == "[7](https://www.openstreetmap.org/way/7)"


def test_long_addresses_keep_their_analyses_apart(spark):
    rows = [("a very long address of more than forty letters, somewhere", kind, radius) for kind in ("paved", "dirt") for radius in (10.0, 50.0)]
    df = spark.createDataFrame(rows, "address string, kind string, radius double")
    args = (F.col("address"), F.col("kind"), F.col("radius"))
    assert df.select(text.analysis_base_id(*args)).distinct().count() == 1
    assert df.select(text.analysis_key(*args)).distinct().count() == 4

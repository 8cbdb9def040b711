import pytest
from pyspark.sql import functions as F

from spark_climbs import schemas
from spark_climbs.operators import places
from spark_climbs.operators.elevation import sample_elevation_grid
from spark_climbs.operators.report import connectivity_report, observed, report


def test_geocode_candidates(spark):
    rows = [(1, "12 Elm St, Town, NC", "us"), (2, "Elm St,  Town", None), (3, "Town", "")]
    df = spark.createDataFrame(rows, "address_id long, address string, country string")
    got = {(r.address_id, r.rank): r.query for r in places.geocode_candidates(df).collect()}
    assert got == {
        (1, 0): "12 Elm St, Town, NC, us",
        (1, 1): "Elm St, Town, NC, us",
        (1, 2): "Town, NC, us",
        (2, 0): "Elm St, Town",
        (2, 2): "Town",
        (3, 0): "Town",
    }
    gazetteer = spark.createDataFrame([("Town,  NC,us", 1.0, 2.0, "Town!")], schemas.GAZETTEER)
    hits = {r.address_id: (r.lat, r.matched_by) for r in places.geocode(df, gazetteer).collect()}
    assert hits == {1: (1.0, 2), 2: (None, None), 3: (None, None)}


def test_resolve_region(spark):
    bounds = spark.createDataFrame(
        [("state", 0, "north carolina", 35.0, -79.0, 300.0), ("state", 1, "colorado", 39.0, -105.5, 400.0), ("state", 2, "carolina", 1.0, 1.0, 1.0)],
        schemas.REGION_BOUNDS,
    )
    names = spark.createDataFrame([(n,) for n in ("colo", " Carolina ", "zz", "State of Colorado", "")], "name string")
    got = {r.name: (r.matched_name, r.matched_by, r.radius_km) for r in places.resolve_region(names, bounds, "state").collect()}
    assert got == {
        "colo": ("colorado", "partial", 400.0),
        " Carolina ": ("carolina", "exact", 1.0),
        "zz": (None, "default", 400.0),
        "State of Colorado": ("colorado", "partial", 400.0),
        "": ("north carolina", "partial", 300.0),
    }
    assert [r.name for r in places.suggest_regions(bounds, "state", 2).collect()] == ["carolina", "colorado"]


CLIMB = "road_id long, climb_score double, start_lat double, start_lon double"


def located(spark, center=(35.0, -82.0), places_rows=None):
    climbs = spark.createDataFrame([(1, 9000.0, 35.1001, -82.1), (2, 8000.0, 35.1003, -82.1), (3, 7000.0, None, None), (4, 1.0, 36.0, -82.0)], CLIMB)
    rows = [(35100, -82100, {"city": "", "town": "T", "region": "R"}, "x", None), (36000, -82000, {}, "x", "timeout")]
    table = spark.createDataFrame(rows, "lat_e3 long, lon_e3 long, address map<string,string>, full_address string, error string")
    return {r.road_id: r for r in places.attach_location(climbs, table, center).collect()}


def test_climbs_of_a_cell_share_the_last_start(spark):
    got = located(spark)
    assert got[1].center_km == got[2].center_km == pytest.approx(14.391, abs=0.01)
    assert (got[1].city, got[1].state) == ("T", "R")
    assert (got[3].city, got[3].state, got[3].center_km) == ("Unknown", "Unknown", 0.0)
    assert got[4].city == "Lookup Failed"
    assert located(spark, center=None)[1].city == "N/A"


def test_grid_sampling(spark):
    grid = spark.createDataFrame([(i, j, 10.0 * i + j) for i in range(4) for j in range(4)], schemas.ELEVATION_GRID)
    points = spark.createDataFrame([(150, 250), (100, 200), (399, 0), (300, 300), (160, 240)], "lat_e6 long, lon_e6 long")
    got = {(r.lat_e6, r.lon_e6): r.elevation for r in sample_elevation_grid(points, grid, 100).collect()}
    assert got[150, 250] == pytest.approx(17.5) and got[100, 200] == 12.0 and got[300, 300] == 33.0
    assert got[399, 0] is None
    near = {(r.lat_e6, r.lon_e6): r.elevation for r in sample_elevation_grid(points, grid, 100, "nearest").collect()}
    assert near[160, 240] == 22.0


def test_connectivity(spark):
    ends = ["start_lat", "start_lon", "end_lat", "end_lon"]
    schema = "pair_id long, " + ", ".join(f"{s}_{c} double" for s in "ab" for c in ends)
    rows = [(1, 0.0, 0.0, 0.01, 0.0, 0.01, 0.0, 0.02, 0.0), (2, None, None, None, None, 0.0, 0.0, 1.0, 1.0), (3, 0.0, 0.0, 0.1, 0.0, 0.105, 0.0, 0.2, 0.0)]
    out = connectivity_report(spark.createDataFrame(rows, schema)).collect()
    first = [r for r in out if r.pair_id == 1]
    assert [(r.a_end, r.b_end) for r in first][0] == ("end", "start") and first[0].status == "CONNECTABLE"
    assert {r.verdict for r in first} == {"SHOULD MERGE"} and len(first) == 4
    assert [r.verdict for r in out if r.pair_id == 2] == ["ERROR"]
    assert {r.verdict for r in out if r.pair_id == 3} == {"GAP TOO LARGE"}


def test_report_units(spark):
    columns = "road_id long, street_name string, city string, state string, center_km double, climb_category string, climb_score double, elevation_gain double, height double, prominence double, length_km double, distance_km double, avg_grade double, max_grade double, surface string, tracktype string, first_way_id long"
    df = spark.createDataFrame([(1, "A", "C", "S", 1.0, "HC", 99999.9, 100.9, 10.5, 10.5, 1.0, 1.0, 1.234, 5.678, "x", "y", None)], columns)
    imperial, metric = report(df).first(), report(df, "metric").first()
    assert (imperial["Score"], imperial["Elev Gain (ft)"], imperial["Length (mi)"], imperial["Way ID"]) == (99999, 331, 0.62, "N/A")
    assert (metric["Elev Gain (m)"], metric["Length (km)"], metric["From Center (km)"]) == (100, 1.0, 1.0)
    assert len(df.columns) == 17 and len(report(df).columns) == 17


def test_observed_counts(spark):
    seen, counts = observed(spark.range(10), "run", n=F.count("*"), even=F.count_if(F.col("id") % 2 == 0))
    seen.write.format("noop").mode("overwrite").save()
    assert counts.get == {"n": 10, "even": 5}


def test_all_states_and_the_first_countries(spark):
    rows = [(f"{kind} {k:02d}", kind) for kind in ("state", "country") for k in range(25)]
    bounds = spark.createDataFrame(rows, "name string, kind string")
    assert places.suggest_regions(bounds, "state").count() == 25
    assert [r.name for r in places.suggest_regions(bounds, "country").collect()] == [f"country {k:02d}" for k in range(20)]

import math
import random

import pytest
from greedy import metres
from pyspark.sql import functions as F

from spark_climbs.functions import geo
from spark_climbs.operators import area


def grid(spark, radius, size, lat=35.0, lon=-82.0):
    one = spark.createDataFrame([(1, lat, lon, float(radius))], "area_id long, center_lat double, center_lon double, radius_km double")
    return area.chunk_grid(one, size)


@pytest.mark.parametrize("radius,n,chunk_radius", [(5, 1, 5.0), (16, 9, 4.0), (20, 21, 4.0)])
def test_chunk_grid(spark, radius, n, chunk_radius):
    rows = grid(spark, radius, 8.0).collect()
    assert len(rows) == n and {r.chunk_radius_km for r in rows} == {chunk_radius}
    assert sorted(r.chunk_index for r in rows) == list(range(n))


@pytest.mark.parametrize("lat,lon", [(35.0, -82.0), (70.0, 179.9)])
@pytest.mark.parametrize("cover", ["square", "circle"])
def test_assign_chunks_against_all_pairs(spark, cover, lat, lon):
    chunks = grid(spark, 40.0, 8.0, lat, lon)
    nodes = [(1, k, lat + (k % 23 - 11) * 0.03, (lon + (k // 23 - 11) * 0.05 + 180) % 360 - 180) for k in range(23 * 23)]
    df = spark.createDataFrame(nodes, "area_id long, way_id long, lat double, lon double")
    got = {(r.chunk_index, r.way_id) for r in area.assign_chunks(df, chunks, 8.0, cover).collect()}
    cells = chunks.collect()
    if cover == "circle":
        want = {
            (c.chunk_index, k) for _, k, y, x in nodes for c in cells if metres((y, x), (c.lat, c.lon)) <= c.chunk_radius_km * 1000
        }
        assert got == want
    else:
        # Every node of the inner area is in exactly one chunk, the nearest column and row.
        assert len({k for _, k in got}) == len(got)
        inner = {k for _, k, y, x in nodes if metres((y, x), (lat, lon)) < 25000}
        assert inner <= {k for _, k in got}


def test_radius_across_the_antimeridian(spark):
    df = spark.createDataFrame([(1, 0.0, 179.99), (2, 0.0, -179.99), (3, 0.0, 179.0)], "way_id long, lat double, lon double")
    assert sorted(r.way_id for r in area.within_radius(df, 0.0, 180.0, 5.0).collect()) == [1, 2]


def vector(lat, lon):
    lat, lon = math.radians(lat), math.radians(lon)
    return (math.cos(lat) * math.cos(lon), math.cos(lat) * math.sin(lon), math.sin(lat))


def along(a, b, n=4000):
    """Places of the great-circle arc between two others."""
    u, v = vector(*a), vector(*b)
    angle = math.acos(max(-1.0, min(1.0, sum(x * y for x, y in zip(u, v)))))
    for k in range(n + 1):
        t = k / n
        f, g = (1 - t, t) if angle < 1e-9 else (math.sin((1 - t) * angle) / math.sin(angle), math.sin(t * angle) / math.sin(angle))
        x, y, z = (f * p + g * q for p, q in zip(u, v))
        yield math.degrees(math.atan2(z, math.hypot(x, y))), math.degrees(math.atan2(y, x))


def random_edges(seed, n, center, spread):
    rnd = random.Random(seed)
    place = lambda: (center[0] + rnd.uniform(-spread, spread), (center[1] + rnd.uniform(-spread, spread) + 180) % 360 - 180)
    return [(place(), place()) for _ in range(n)]


@pytest.mark.parametrize("center", [(35.0, -82.0), (-70.0, 179.9), (0.0, 0.0), (88.5, 10.0)])
def test_edges_within_radius(spark, center):
    edges = random_edges(1, 200, center, 1.4)
    near = [min(metres(center, p) for p in along(a, b)) / 1000 for a, b in edges]
    # the nearest of the places tried lies a little behind the nearest of all
    near = [d if abs(d - 40) > 0.5 else None for d in near]
    nodes = [(k, idx, *p) for k, e in enumerate(edges) for idx, p in enumerate(e)] + [(999, 0, *center)]
    df = spark.createDataFrame(nodes, "way_id long, idx int, lat double, lon double")
    got = {r.way_id for r in area.within_radius(df, *center, 40.0).collect()}
    assert 999 in got
    assert all((k in got) == (d <= 40) for k, d in enumerate(near) if d is not None)
    by_end = {k for k, e in enumerate(edges) if min(metres(center, p) for p in e) <= 40_000}
    assert by_end < got
    assert got == {r.way_id for r in area.within_radius(df, *center, 40.0, longest_edge_km=800.0).collect()}
    whole = df.groupBy("way_id").agg(F.array_sort(F.collect_list(F.struct("idx", "lat", "lon"))).alias("nodes"))
    assert got == {r.way_id for r in area.ways_within_radius(whole, *center, 40.0).collect()}


def test_arc_distance(spark):
    rows = [(0.0, 0.0, 0.0, 1.0, 2.0), (0.0, 3.0, 0.0, 1.0, 2.0), (1.0, 1.5, 0.0, 1.0, 2.0), (5.0, 5.0, 5.0, 5.0, 5.0)]
    df = spark.createDataFrame([(*r[:3], r[3], r[2], r[4]) for r in rows], "p double, q double, a double, b double, c double, d double")
    got = [r[0] for r in df.select(geo.arc_distance_km(*[F.col(c) for c in "pqabcd"])).collect()]
    degree = geo.KM_PER_DEGREE
    assert got == pytest.approx([degree, degree, degree, 0.0], abs=1e-6)


@pytest.mark.parametrize("center", [(35.0, -82.0), (60.0, 179.9)])
@pytest.mark.parametrize("cover", ["square", "circle"])
def test_edges_in_chunks(spark, cover, center):
    chunks = grid(spark, 40.0, 8.0, *center)
    edges = random_edges(2, 60, center, 0.9)
    nodes = [(k, idx, *p) for k, e in enumerate(edges) for idx, p in enumerate(e)]
    df = spark.createDataFrame(nodes, "way_id long, idx int, lat double, lon double")
    got = {(r.chunk_index, r.way_id) for r in area.assign_chunks(df, chunks, 8.0, cover).collect()}
    cells = chunks.collect()
    if cover == "circle":
        for c in cells:
            for k, (a, b) in enumerate(edges):
                d = min(metres((c.lat, c.lon), p) for p in along(a, b, 600)) / 1000
                assert abs(d - c.chunk_radius_km) < 0.1 or ((c.chunk_index, k) in got) == (d <= c.chunk_radius_km)
    else:
        # cells that a straight line passes, seen at many places of it
        of = {(c.i, c.j): c.chunk_index for c in cells}
        step = 8.0 / 111.0, 8.0 / (111.0 * math.cos(math.radians(center[0])))
        seen = set()
        for k, (a, b) in enumerate(edges):
            x0 = (a[1] - center[1] + 180) % 360 - 180
            x1 = x0 + (b[1] - a[1] + 180) % 360 - 180
            for t in range(4001):
                y, x = a[0] + (b[0] - a[0]) * t / 4000 - center[0], x0 + (x1 - x0) * t / 4000
                cell = math.floor(y / step[0] + 0.5), math.floor(x / step[1] + 0.5)
                if cell in of:
                    seen.add((of[cell], k))
        assert seen <= got and len(got - seen) <= 8  # a corner may be cut between two places


AREA = "area_id string, center_lat double, center_lon double, radius_km double"


def test_ways_of_many_areas(spark):
    """Areas of all sizes, over each other, over the antimeridian and round a pole."""
    rnd = random.Random(3)
    centers = [(35.0, -82.0), (0.0, 179.95), (-0.3, -179.9), (88.9, 20.0), (-70.0, 0.0)]
    areas = [(f"{k}", *rnd.choice(centers), rnd.choice([0.5, 5.0, 40.0, 300.0])) for k in range(25)]
    edges = [e for k, c in enumerate(centers) for e in random_edges(k, 25, c, 0.9)]
    nodes = [(k, idx, *p) for k, e in enumerate(edges) for idx, p in enumerate(e)] + [(999, 0, *centers[1]), (998, 0, None, None)]
    df = spark.createDataFrame(nodes, "way_id long, idx int, lat double, lon double")
    got = {(r.area_id, r.way_id) for r in area.ways_of_areas(df, spark.createDataFrame(areas, AREA)).collect()}
    for k, (a, b) in enumerate([*edges, (centers[1], centers[1])]):
        way = k if k < len(edges) else 999
        of = list(along(a, b, 500))
        for name, lat, lon, radius in areas:
            d = min(metres((lat, lon), p) for p in of) / 1000
            assert abs(d - radius) < 0.3 or ((name, way) in got) == (d <= radius), (name, way, d, radius)
    # one area alone is what the radius predicate finds
    for name, lat, lon, radius in areas[:4]:
        assert {w for n, w in got if n == name} == {r.way_id for r in area.within_radius(df, lat, lon, radius).collect()}
    assert area.ways_of_areas(df, spark.createDataFrame([], AREA)).count() == 0


def test_long_edges_cost_rows_where_areas_are(spark):
    """A way across half the globe is looked up in some cells, not in all that it crosses."""
    areas = spark.createDataFrame([("a", 10.0, 20.0, 2.0)], AREA)
    nodes = [(1, 0, 10.0, 20.0), (1, 1, 11.0, 150.0), (2, 0, -60.0, -170.0), (2, 1, 60.0, -30.0), (3, 0, 10.0, 20.0)]
    edges = area.with_edges(spark.createDataFrame(nodes, "way_id long, idx int, lat double, lon double"))
    got = area.ways_of_areas(spark.createDataFrame(nodes, "way_id long, idx int, lat double, lon double"), areas)
    assert sorted(r.way_id for r in got.collect()) == [1, 3]
    inside = edges
    for level, (i, j) in ((3, (2, 4)), (5, (8, 17)), (7, (35, 71))):
        inside = area._cells_inside(inside, level)
        assert inside.count() < 40
        inside = inside.filter((F.col("i") == i) & (F.col("j") == j))
    assert {r.way_id for r in inside.collect()} == {1, 3}

"""Endpoint merging, exact against a plain restatement of the greedy rules."""

import random

import pytest
from greedy import build_roads, chains
from pyspark.sql import functions as F

from spark_climbs.operators import merge

SCHEMA = (
    "seq long, way_ids array<long>, street_name string, surface string, tracktype string, tracktype_definition string,"
    " nodes array<struct<idx int, node_id string, lat double, lon double>>"
)


def segments(spark, pieces, surface="asphalt"):
    rows = [
        (seq, [seq], street, surface if isinstance(surface, str) else surface[seq], "not_applicable", "Not a track",
         [(k, f"{seq}_{k}", lat, lon) for k, (lat, lon) in enumerate(nodes)])
        for seq, street, nodes in pieces
    ]
    return spark.createDataFrame(rows, SCHEMA)


def merged(spark, pieces, **options):
    out = merge.merge_by_endpoint(segments(spark, pieces), **options).collect()
    return sorted((list(r.way_ids), [(n.lat, n.lon) for n in r.nodes]) for r in out)


def random_pieces(seed, n, box):
    rnd = random.Random(seed)
    pieces = []
    for seq in range(n):
        a = (rnd.uniform(0, box), rnd.uniform(0, box))
        b = (a[0] + rnd.uniform(-0.006, 0.006), a[1] + rnd.uniform(-0.006, 0.006))
        middle = [((a[0] + b[0]) / 2 + k * 1e-7, (a[1] + b[1]) / 2) for k in range(rnd.choice([0, 0, 1, 2]))]
        pieces.append((seq, rnd.choice("AAB"), [a, *middle, b]))
    return pieces


@pytest.mark.parametrize(
    "seed,n,box,options",
    [
        (1, 150, 0.1, {}),
        (2, 150, 0.05, {"tile_deg": 0.02}),
        (3, 120, 0.05, {"tile_deg": 0.01}),
    ],
)
def test_same_roads_as_one_scan(spark, seed, n, box, options):
    pieces = random_pieces(seed, n, box)
    ends = merge.segment_ends(segments(spark, pieces))
    members = merge.endpoint_members(ends, **options).collect()
    want = sorted(build_roads(pieces))
    got = {}
    for m in members:
        got.setdefault(m.road_id, []).append(m)
    by_seq = {p[0]: p[2] for p in pieces}
    roads = []
    for group in got.values():
        nodes = []
        for m in sorted(group, key=lambda m: m.road_pos):
            own = by_seq[m.seq][int(m.drop_head): len(by_seq[m.seq]) - int(m.drop_tail)]
            nodes += own[::-1] if m.reversed else own
        roads.append(([m.seq for m in sorted(group, key=lambda m: m.attach_no)], nodes))
    assert sorted(roads) == want


def test_three_roads_in_one_point(spark):
    meet = (0.05, 0.05)
    pieces = [(k, "A", [meet, (0.05 + dx, 0.05 + dy)]) for k, (dx, dy) in enumerate([(0.01, 0), (0, 0.01), (-0.01, -0.01)])]
    roads = merged(spark, pieces)
    assert [ids for ids, _ in roads] == [[0, 1], [2]]
    # Start to start: the first is turned round, the second loses its first node.
    assert roads[0][1] == [(0.060000000000000005, 0.05), meet, (0.05, 0.060000000000000005)]


def test_tolerance_is_strict(spark):
    pieces = [(0, "A", [(0.0, 0.0), (0.01, 0.0)]), (1, "A", [(0.01, 0.002), (0.02, 0.0)])]
    assert [ids for ids, _ in merged(spark, pieces)] == [[0], [1]]
    pieces[1] = (1, "A", [(0.01, 0.0019), (0.02, 0.0)])
    assert [ids for ids, _ in merged(spark, pieces)] == [[0, 1]]


def test_surface_of_merged_road(spark):
    pieces = [(k, "A", [(0.01 * k, 0.0), (0.01 * (k + 1), 0.0)]) for k in range(3)]
    surface = {0: "unknown", 1: "gravel", 2: "asphalt"}
    row = merge.merge_by_endpoint(segments(spark, pieces, surface)).first()
    assert (row.surface, row.first_way_id, row.n_pieces, row.n_nodes) == ("gravel", 0, 3, 4)
    split = merge.merge_by_endpoint(segments(spark, pieces, surface), split_on_surface=True)
    assert split.count() == 3


def test_crowded_street_has_no_pairs(spark):
    """Many pieces from one point: joined two by two, in order."""
    rnd = random.Random(4)
    pieces = [(k, "service", [(1.0, 1.0), (1.0 + rnd.uniform(0.01, 0.5), 1.0 + rnd.uniform(0.01, 0.5))]) for k in range(400)]
    roads = build_roads(pieces)
    members = merge.endpoint_members(merge.segment_ends(segments(spark, pieces)))
    assert members.select("road_id").distinct().count() == len(roads)


def test_merge_by_node_id(spark):
    rows = [
        (0, [0], "A", "x", "y", "z", [(0, "c", 0.0, 0.0), (1, "d", 0.0, 1.0)]),
        (1, [1], "A", "x", "y", "z", [(0, "a", 0.0, 0.0), (1, "b", 0.0, 1.0)]),
        (2, [2], "A", "x", "y", "z", [(0, "b", 0.0, 1.0), (1, "c", 0.0, 2.0)]),
        (3, [3], "A", "x", "y", "z", [(0, "b", 0.0, 1.0), (1, "e", 0.0, 3.0)]),
        (4, [4], "B", "x", "y", "z", [(0, "d", 0.0, 1.0), (1, "a", 0.0, 3.0)]),
    ]
    out = merge.merge_by_node_id(spark.createDataFrame(rows, SCHEMA)).collect()
    # 0 is taken as a start before 2 could reach it; 3 begins where 2 does.
    assert sorted(list(r.way_ids) for r in out) == [[0], [1, 2], [3], [4]]
    joined = next(r for r in out if r.road_id == 1)
    assert [n.node_id for n in joined.nodes] == ["a", "b", "c"]


def test_pieces_without_ends_are_roads_of_their_own(spark):
    pieces = [(0, "A", []), (1, "A", []), (2, "A", [(0.0, 0.0), (0.01, 0.0)]), (3, "A", [(0.01, 0.0), (0.02, 0.0)])]
    members = merge.endpoint_members(merge.segment_ends(segments(spark, pieces))).collect()
    roads = {}
    for m in members:
        roads.setdefault(m.road_id, set()).add(m.seq)
    assert sorted(map(sorted, roads.values())) == [[0], [1], [2, 3]]


def _members(spark, pieces, **options):
    found = {}
    for m in merge.endpoint_members(merge.segment_ends(segments(spark, pieces)), **options).collect():
        found.setdefault(m.road_id, []).append(m)
    return sorted([m.seq for m in sorted(group, key=lambda m: m.attach_no)] for group in found.values())


def test_a_road_over_many_tiles_takes_few_scans(spark, monkeypatch):
    scans, play = [], merge._play
    monkeypatch.setattr(merge, "_play", lambda *a: scans.append(1) or play(*a))
    # over 64 tiles of 0.16 degrees, along the edge of a coarse cell
    pieces = [(k, "A", [(0.1 * k - 5.0, 0.001 * (k % 2) - 0.0005), (0.1 * (k + 1) - 5.0, 0.001 * ((k + 1) % 2) - 0.0005)]) for k in range(110)]
    assert _members(spark, pieces) == sorted(ids for ids, _ in build_roads(pieces))
    assert len(scans) <= 8


@pytest.mark.parametrize("rows", [1, 40])
def test_groups_that_may_not_grow(spark, monkeypatch, rows):
    """Groups at their limit go on handing claims to each other, with the same result."""
    monkeypatch.setattr(merge, "GROUP_ROWS", rows)
    pieces = random_pieces(5, 100, 0.04)
    assert _members(spark, pieces, tile_deg=0.01) == sorted(ids for ids, _ in build_roads(pieces))


WAY_SCHEMA = "seq long, scope int, street_name string, head_id string, tail_id string"


def _chains(spark, ways):
    rows = spark.createDataFrame([(seq, *inside, head, tail) for seq, inside, head, tail in ways], WAY_SCHEMA)
    found = {}
    for r in merge.node_members(rows).collect():
        found.setdefault(r.road_id, []).append((r.attach_no, r.seq))
    return sorted([seq for _, seq in sorted(c)] for c in found.values())


@pytest.mark.parametrize("seed, n, nodes", [(1, 60, 8), (2, 80, 40), (3, 40, 3)])
def test_chains_as_one_scan(spark, seed, n, nodes):
    """Many ways at few nodes: loops, closed chains, and arrivals that depend on each other."""
    rnd = random.Random(seed)
    insides = [(0, "A"), (0, "B"), (1, "A"), (0, None)]
    ways = [(seq, rnd.choice(insides), f"n{rnd.randrange(nodes)}", f"n{rnd.randrange(nodes)}") for seq in rnd.sample(range(1000), n)]
    assert _chains(spark, ways) == sorted(chains(ways))


def test_closed_chains_are_opened(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (5, 5), (7, 9), (9, 8)], "seq long, next long")
    seqs = spark.createDataFrame([(k,) for k in range(1, 10)], "seq long")
    times = {r.seq: (r.seed, r.step) for r in merge._ranked(seqs, links).collect()}
    assert times == {1: (1, 0), 2: (1, 1), 3: (1, 2), 4: (4, 0), 5: (5, 0), 6: (6, 0), 7: (7, 0), 9: (7, 1), 8: (7, 2)}


def test_ways_without_ends_stay_alone(spark):
    ways = [(0, (0, "A"), None, None), (1, (0, "A"), None, "x"), (2, (0, "A"), "x", None), (3, (0, "A"), None, None)]
    assert _chains(spark, ways) == [[0], [1, 2], [3]]


def test_a_long_street_of_ways(spark):
    """100,000 ways of one street: one chain in order, and one whose ways all come before the last."""
    n = 100_000
    ways = spark.range(n).select(
        F.col("id").alias("seq"),
        F.lit(0).alias("scope"),
        F.lit("A").alias("street_name"),
        # up to the middle, a way ends where the next begins; from there on, where the one before begins
        F.when(F.col("id") < n // 2, F.col("id")).otherwise(F.col("id") * 10 + 10).cast("string").alias("head_id"),
        F.when(F.col("id") < n // 2, F.col("id") + 1).otherwise(F.col("id") * 10).cast("string").alias("tail_id"),
    )
    roads = merge.node_members(ways).groupBy("road_id").agg(F.count("*").alias("n"), F.max("attach_no").alias("last")).collect()
    assert sorted((r.n, r.last) for r in roads) == [(1, 0)] * (n // 2) + [(n // 2, n // 2 - 1)]

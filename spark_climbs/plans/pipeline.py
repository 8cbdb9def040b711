"""The analysis end to end: ways to a ranked report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spark_climbs.functions.scoring import DEFAULT_MIN_SCORE
from spark_climbs.materialize import materialize
from spark_climbs.operators.area import ways_of_areas, ways_within_radius
from spark_climbs.operators.dedup import dedup_exact, dedup_near
from spark_climbs.operators.elevation import attach_elevation
from spark_climbs.operators.merge import endpoint_members, merged_roads, road_nodes
from spark_climbs.operators.metrics import climb_metrics
from spark_climbs.operators.places import attach_location
from spark_climbs.operators.report import report
from spark_climbs.operators.roads import first_of_ways, segment_ends, segments_from_ways, surface_filter

DEFAULT_RADIUS_KM = 15.0


def long_nodes(segments: DataFrame) -> DataFrame:
    """Nodes of segments in long form, ``pos`` from 0."""
    return segments.select(
        "seq", F.size("nodes").alias("n_nodes"), F.posexplode("nodes").alias("pos", "node")
    ).select("seq", "n_nodes", "pos", "node.lat", "node.lon")


def merged_members(segments: DataFrame, split_on_surface: bool = False, unrolled: bool = False) -> tuple[DataFrame, DataFrame]:
    """Unique segments (narrow) and the road each belongs to, both written once."""
    unique = materialize(dedup_near(materialize(dedup_exact(segment_ends(segments)), "exact"), unrolled=unrolled), "unique")
    members = materialize(endpoint_members(unique, split_on_surface=split_on_surface), "members")
    return unique, members


def climbs_from_segments(segments: DataFrame, elevation: DataFrame, split_on_surface: bool = False, unrolled: bool = False) -> DataFrame:
    """Climbs (unfiltered) from segments: dedup, merge, elevations, metrics.

    Deduplication and merging touch only ends; the nodes are read once, looked up,
    and shuffled once more to their piece."""
    unique, members = merged_members(segments, split_on_surface, unrolled)
    nodes = attach_elevation(long_nodes(segments), elevation)
    return climb_metrics(road_nodes(members, nodes), merged_roads(members, unique))


def locate_and_report(
    climbs: DataFrame,
    places: DataFrame,
    center: tuple[float, float] | DataFrame | None,
    unit_system: str = "imperial",
    min_score: float = DEFAULT_MIN_SCORE,
) -> DataFrame:
    """Report of the climbs that score enough. Locating them and sorting them by range
    each read the climbs again, so they are written once."""
    kept = materialize(climbs.filter(F.col("climb_score") >= min_score).drop("way_ids", "osm_links"), "climbs")
    return report(attach_location(kept, places, center), unit_system)


def select_segments(
    ways: DataFrame,
    center: tuple[float, float] | None = None,
    radius_km: float = DEFAULT_RADIUS_KM,
    surface: str = "all",
    seq: Column | None = None,
) -> DataFrame:
    """Segments of the ways of a kind within the radius; everywhere without a centre.
    A way listed more than once (as in overlapping documents) counts once."""
    chosen = surface_filter(ways, surface)
    if center is not None:
        chosen = ways_within_radius(chosen, *center, radius_km)
    return segments_from_ways(first_of_ways(chosen, seq), seq)


def analyze_area(
    ways: DataFrame,
    elevation: DataFrame,
    places: DataFrame,
    center: tuple[float, float],
    radius_km: float = DEFAULT_RADIUS_KM,
    surface_filter: str = "all",
    unit_system: str = "imperial",
    min_score: float = DEFAULT_MIN_SCORE,
    split_on_surface: bool = False,
    seq: Column | None = None,
) -> DataFrame:
    """Ranked report of the climbs within ``radius_km`` of ``center``."""
    segments = select_segments(ways, center, radius_km, surface_filter, seq)
    climbs = climbs_from_segments(segments, elevation, split_on_surface)
    return locate_and_report(climbs, places, center, unit_system, min_score)


#: Orders of segments are told apart by area in one number: this many bits of it are the order inside the area.
_SEQ_BITS = 44


def analyze_areas(
    ways: DataFrame,
    elevation: DataFrame,
    places: DataFrame,
    areas: DataFrame,
    surface: str = "all",
    unit_system: str = "imperial",
    min_score: float = DEFAULT_MIN_SCORE,
    split_on_surface: bool = False,
    seq: Column | None = None,
) -> DataFrame:
    """Ranked reports of many areas ``(area_id, center_lat, center_lon, radius_km)`` in one run: towns, states or
    countries (``address_areas``, ``region_areas``), overlapping or not. Every area gets the report that
    ``analyze_area`` gives for it, with its ``area_id`` before the columns.

    Ways are listed for the areas they are in and carry ``area_id`` from there on; duplicates
    and joints are looked for inside an area. The list of areas is numbered in one task, its rows
    alone; ``seq`` must lie under 2 ** 44."""
    order = F.col("way_id") if seq is None else seq
    chosen = materialize(first_of_ways(surface_filter(ways, surface), seq).withColumn("own_seq", order.cast("long")), "ways")
    numbers = areas.select("area_id", (F.row_number().over(Window.orderBy("area_id")) - 1).cast("long").alias("area_no"))
    listed = ways_of_areas(chosen.select("way_id", F.inline("nodes")), areas)
    inside = chosen.join(listed.join(numbers, "area_id"), "way_id")
    too_large = (F.col("own_seq") < 0) | (F.col("own_seq") >= 1 << _SEQ_BITS)
    packed = F.when(too_large, F.raise_error(F.lit("the order of a way is out of range")).cast("long")).otherwise(
        F.shiftleft("area_no", _SEQ_BITS) + F.col("own_seq")
    )
    segments = materialize(segments_from_ways(inside, packed, "area_id"), "segments")
    climbs = climbs_from_segments(segments, elevation, split_on_surface)
    return locate_and_report(climbs, places, areas, unit_system, min_score)

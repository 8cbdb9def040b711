"""Climb metrics of roads.

Metrics are computed in two steps. Every *piece* of a road is summarised where its
nodes are; then the short piece summaries are combined along the road, adding the
steps across the joints. A long road thus never brings its nodes into one task,
and only one row per piece is shuffled for the second step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spark_climbs.functions.geo import haversine_km
from spark_climbs.functions.scoring import average_grade, climb_category, climb_score, osm_links

_POINT = ("lat", "lon", "elevation")


def _step_grade(rise: Column, km: Column) -> Column:
    """Grade of one step in percent; NULL where nothing was travelled."""
    return F.when(km > 0, F.abs(F.try_divide(rise, km * F.lit(1000.0))) * F.lit(100.0))


def _summaries(nodes: DataFrame, *more: str) -> DataFrame:
    """One row per ``seq`` of what its nodes come to, along their ``pos``; ``more`` columns depend on ``seq``."""
    along = Window.partitionBy("seq").orderBy("pos")
    valid = nodes.filter(F.col("elevation").isNotNull())
    steps = valid.withColumns({f"p_{c}": F.lag(c).over(along) for c in _POINT})
    km = haversine_km(F.col("p_lat"), F.col("p_lon"), F.col("lat"), F.col("lon"))
    rise = F.col("elevation") - F.col("p_elevation")
    steps = steps.withColumns({"km": km, "rise": rise})
    point = F.struct(*_POINT)
    return steps.groupBy("seq").agg(
        *[F.first(c).alias(c) for c in more],
        F.count("*").alias("n_valid"),
        F.min("elevation").alias("low"),
        F.max("elevation").alias("high"),
        F.coalesce(F.sum("km"), F.lit(0.0)).alias("km"),
        F.coalesce(F.sum(F.greatest("rise", F.lit(0.0))), F.lit(0.0)).alias("up"),
        F.coalesce(F.sum(F.greatest(-F.col("rise"), F.lit(0.0))), F.lit(0.0)).alias("down"),
        F.max(_step_grade(F.col("rise"), F.col("km"))).alias("grade"),
        F.min_by(point, "pos").alias("head"),
        F.max_by(point, "pos").alias("tail"),
    )


def piece_profiles(nodes: DataFrame) -> DataFrame:
    """Summaries of pieces from long nodes ``(road_id, road_pos, seq, reversed, pos,
    lat, lon, elevation)``. Nodes without elevation do not count: a step leads from
    one elevation-bearing node to the next. Window and aggregation share one
    exchange and one sort: both are keyed by ``seq`` alone, on which ``road_id``,
    ``road_pos`` and ``reversed`` depend."""
    return _summaries(nodes, "road_id", "road_pos", "reversed").select(
        "road_id",
        "road_pos",
        "n_valid",
        "low",
        "high",
        "km",
        "grade",
        F.when(F.col("reversed"), F.col("down")).otherwise(F.col("up")).alias("gain"),
        F.when(F.col("reversed"), F.col("tail")).otherwise(F.col("head")).alias("first"),
        F.when(F.col("reversed"), F.col("head")).otherwise(F.col("tail")).alias("last"),
    )


def single_profiles(nodes: DataFrame) -> DataFrame:
    """Profiles of unmerged segments from long nodes ``(seq, pos, lat, lon, elevation)``: roads of one
    piece, so that its summary is the road's and nothing is shuffled to combine it."""
    return _summaries(nodes).select(
        F.col("seq").alias("road_id"),
        "n_valid",
        F.col("low").alias("min_elevation"),
        F.col("high").alias("max_elevation"),
        F.col("km").alias("length_km"),
        F.col("up").alias("elevation_gain"),
        F.coalesce("grade", F.lit(0.0)).alias("max_grade"),
        F.col("head").alias("first"),
        F.col("tail").alias("last"),
    )


def road_profiles(pieces: DataFrame) -> DataFrame:
    """Combine piece summaries along each road."""
    along = Window.partitionBy("road_id").orderBy("road_pos")
    joined = pieces.withColumn("prev", F.lag("last").over(along))
    km = F.when(
        F.col("prev").isNotNull(),
        haversine_km(F.col("prev.lat"), F.col("prev.lon"), F.col("first.lat"), F.col("first.lon")),
    )
    rise = F.col("first.elevation") - F.col("prev.elevation")
    joined = joined.withColumns({"joint_km": km, "joint_rise": rise})
    joint_grade = _step_grade(F.col("joint_rise"), F.col("joint_km"))
    return joined.groupBy("road_id").agg(
        F.sum("n_valid").alias("n_valid"),
        F.min("low").alias("min_elevation"),
        F.max("high").alias("max_elevation"),
        F.sum(F.coalesce("joint_km", F.lit(0.0)) + F.col("km")).alias("length_km"),
        F.sum(F.greatest(F.coalesce("joint_rise", F.lit(0.0)), F.lit(0.0)) + F.col("gain")).alias("elevation_gain"),
        F.coalesce(F.max(F.greatest("grade", joint_grade)), F.lit(0.0)).alias("max_grade"),
        F.min_by("first", "road_pos").alias("first"),
        F.max_by("last", "road_pos").alias("last"),
    )


def climb_profiles(pieces: DataFrame) -> DataFrame:
    """Metrics of every road that is a climb, from the summaries of its pieces."""
    return climbing(road_profiles(pieces))


def climbing(profiles: DataFrame) -> DataFrame:
    """Metrics of every road that is a climb: two elevations and some length."""
    height = F.col("max_elevation") - F.col("min_elevation")
    score = F.col("climb_score")
    return (
        profiles.filter((F.col("n_valid") >= 2) & (F.col("length_km") != 0))
        .withColumn("height", height)
        .withColumn("avg_grade", average_grade(F.col("height"), F.col("length_km")))
        .withColumn("climb_score", climb_score(F.col("length_km"), F.col("avg_grade")))
        .select(
            "road_id",
            climb_category(score).alias("climb_category"),
            "climb_score",
            "elevation_gain",
            "height",
            F.col("height").alias("prominence"),
            "length_km",
            haversine_km(F.col("first.lat"), F.col("first.lon"), F.col("last.lat"), F.col("last.lon")).alias("distance_km"),
            "avg_grade",
            "max_grade",
            "min_elevation",
            "max_elevation",
        )
    )


def climb_metrics(nodes: DataFrame, roads: DataFrame) -> DataFrame:
    """Climbs with the attributes of their roads (``merged_roads`` columns)."""
    return _with_attributes(climb_profiles(piece_profiles(nodes)), roads)


def single_climb_metrics(nodes: DataFrame, roads: DataFrame) -> DataFrame:
    """``climb_metrics`` of unmerged segments: ``road_id`` of their attributes is the ``seq`` of their nodes."""
    return _with_attributes(climbing(single_profiles(nodes)), roads)


def _with_attributes(climbs: DataFrame, roads: DataFrame) -> DataFrame:
    attributes = roads.select(
        "road_id",
        *[c for c in ("area_id",) if c in roads.columns],
        "street_name",
        "surface",
        "tracktype",
        "tracktype_definition",
        "way_ids",
        osm_links(F.col("way_ids")).alias("osm_links"),
        "first_way_id",
        "n_nodes",
        "start_lat",
        "start_lon",
    )
    return climbs.join(attributes.filter(F.col("n_nodes") >= 2), "road_id")


def single_piece_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes ``(seq, pos, ...)`` of unmerged segments, as roads of one piece."""
    return nodes.withColumns(
        {"road_id": F.col("seq"), "road_pos": F.lit(0), "reversed": F.lit(False)}
    )


def rank_climbs(climbs: DataFrame, min_score: float = 6000.0, k: int | None = None) -> DataFrame:
    """Climbs of at least ``min_score`` by score, best first; ties in road order."""
    ranked = climbs.filter(F.col("climb_score") >= min_score).orderBy(F.desc("climb_score"), "road_id")
    return ranked if k is None else ranked.limit(k)

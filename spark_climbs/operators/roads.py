"""Road selection and the segments made from ways.

A *segment* is one way (or an in-chunk merge of ways) before cross-chunk merging:
``seq`` (total order), ``way_ids``, ``street_name``, ``surface``, ``tracktype``,
``tracktype_definition``, ``nodes``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spark_climbs.functions import tags as T

# Unanchored patterns of the road selections.
_PAVED_HIGHWAYS = "trunk|primary|secondary|tertiary|unclassified|residential|service"
_UNPAVED_SURFACES = "unpaved|gravel|dirt|sand|grass|ground|earth|mud|clay"
_GRAVEL_HIGHWAYS = "track|unclassified|tertiary|residential|service"
_GRAVEL_SURFACES = "gravel|compacted|fine_gravel"
_DIRT_HIGHWAYS = "track|path"

SEGMENT_ATTRIBUTES = ("street_name", "surface", "tracktype", "tracktype_definition")


def surface_predicate(highway: Column, surface: Column, kind: str = "all") -> Column:
    """A negative surface test keeps untagged roads; any unknown kind means all."""
    if kind == "paved":
        return highway.rlike(_PAVED_HIGHWAYS) & ~F.coalesce(surface, F.lit("")).rlike(_UNPAVED_SURFACES)
    if kind == "gravel":
        return highway.rlike(_GRAVEL_HIGHWAYS) & surface.rlike(_GRAVEL_SURFACES)
    if kind == "dirt":
        return highway.rlike(_DIRT_HIGHWAYS)
    return highway.rlike(f"{_PAVED_HIGHWAYS}|{_DIRT_HIGHWAYS}")


def surface_filter(ways: DataFrame, kind: str = "all") -> DataFrame:
    """Keep ways of a kind. Real ``highway`` / ``surface`` columns are used when the
    table has them, so that only those columns are read; else the tag map."""

    def tag(name: str) -> Column:
        return F.col(name) if name in ways.columns else F.col("tags")[name]

    return ways.filter(surface_predicate(tag("highway"), tag("surface"), kind))


def derive_road_attributes(ways: DataFrame) -> DataFrame:
    """Add street name, surface and track type; nameless ways are dropped.

    The name comes from a generator, as no filter is pushed through one: pushed down to where a
    query makes its tags, the filter would make them once for every tag that it looks at."""
    tags = F.col("tags")
    name = F.inline(F.array(F.struct(T.street_name(tags).alias("street_name"))))
    return (
        ways.drop("street_name")
        .select("*", name)
        .filter(F.col("street_name") != "")
        .withColumns(
            {
                "surface": T.surface(tags),
                "tracktype": T.tracktype(tags),
                "tracktype_definition": T.tracktype_definition(tags),
            }
        )
        .drop("tags")
    )


def dedup_ways(ways: DataFrame, *scope: str, order: str | Column = "pos") -> DataFrame:
    """First of every way id within a scope (a chunk): an aggregate with map-side
    combine, so many copies of one way never meet in one task."""
    keys = [*scope, "way_id"]
    rest = [c for c in ways.columns if c not in keys]
    first = F.min_by(F.struct(*rest), order).alias("first")
    return ways.groupBy(*keys).agg(first).select(*keys, "first.*").select(*ways.columns)


def first_of_ways(ways: DataFrame, order: Column | None = None) -> DataFrame:
    """``dedup_ways`` in a given order, else in that of the input's ``pos``, else by a hash
    of the content: the same one of every set of copies each time."""
    if order is None:
        order = F.col("pos") if "pos" in ways.columns else F.xxhash64("nodes", F.to_json("tags"))
    return dedup_ways(ways, order=order)


def segments_from_ways(ways: DataFrame, seq: Column | None = None, *more: str) -> DataFrame:
    """One segment per named way with more than one node. Without an explicit
    total order the way id is the order. ``more`` columns are carried along."""
    named = derive_road_attributes(ways.filter(F.size("nodes") > 1))
    return named.select(
        (F.col("way_id") if seq is None else seq).alias("seq"),
        F.array("way_id").alias("way_ids"),
        *SEGMENT_ATTRIBUTES,
        "nodes",
        *more,
    )


def segment_ends(segments: DataFrame) -> DataFrame:
    """Narrow form of segments: everything but the geometry between the ends. All
    matching works on this, so shuffles carry ~100 bytes per segment."""
    head, tail = F.get("nodes", F.lit(0)), F.get("nodes", F.size("nodes") - 1)
    return segments.select(
        *[c for c in segments.columns if c != "nodes"],
        F.size("nodes").alias("n_nodes"),
        head["lat"].alias("start_lat"),
        head["lon"].alias("start_lon"),
        tail["lat"].alias("end_lat"),
        tail["lon"].alias("end_lon"),
    )

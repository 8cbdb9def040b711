"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spark_climbs.materialize import discard, materialize


def components(edges: DataFrame) -> DataFrame:
    """``(vertex, component)`` for every vertex of ``edges(u, v)``; the component is
    its smallest vertex. Vertices without an edge are their own component and are
    not listed.

    Alternates the large-star and small-star steps: each is one aggregation (with
    map-side combine) and one join against a single row per vertex, so a hub
    vertex is pre-aggregated and its join rows can be split. The number of rounds
    grows with the logarithm of the graph, not with its diameter.
    """
    loops = edges.filter(F.col("u") == F.col("v")).select("u")
    start = (
        edges.filter(F.col("u") != F.col("v"))
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    stars = materialize(start, "edges")
    while True:
        before, stars = stars, materialize(_small_star(_large_star(stars)), "stars")
        settled = _same(before, stars)
        discard(before)
        if settled:
            break
    leaves = stars.select(F.col("u").alias("vertex"), F.col("v").alias("component"))
    roots = stars.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct()
    lone = loops.select(F.col("u").alias("vertex"), F.col("u").alias("component")).distinct()
    listed = leaves.unionByName(roots)
    return listed.unionByName(lone.join(listed, "vertex", "left_anti"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang the larger neighbours of every vertex on its smallest neighbour."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
    return both.join(low, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("low").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang every vertex and its smaller neighbours on the smallest of them."""
    low = edges.groupBy("u").agg(F.min("v").alias("low"))
    moved = edges.join(low, "u").filter(F.col("v") != F.col("low")).select(F.col("v").alias("u"), F.col("low").alias("v"))
    return moved.unionByName(low.select("u", F.col("low").alias("v"))).distinct()


def _same(before: DataFrame, after: DataFrame) -> bool:
    """Whether two edge sets are equal: as many rows, and none of one missing in the
    other. The rows are compared only when the counts agree."""
    return before.count() == after.count() and after.join(before, ["u", "v"], "left_anti").isEmpty()

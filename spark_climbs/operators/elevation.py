"""Elevations of coordinates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spark_climbs.functions.geo import coord_key

KEY = ["lat_e6", "lon_e6"]


def with_coord_key(nodes: DataFrame) -> DataFrame:
    return nodes.withColumns({"lat_e6": coord_key(F.col("lat")), "lon_e6": coord_key(F.col("lon"))})


def distinct_coords(nodes: DataFrame) -> DataFrame:
    return with_coord_key(nodes).select(*KEY).distinct()


def attach_elevation(nodes: DataFrame, elevation: DataFrame) -> DataFrame:
    """Elevation of every node by its coordinate, NULL where there is none.

    ``elevation`` has one row per coordinate. Catalyst broadcasts it when it is
    small; else both sides shuffle on the coordinate once, and a coordinate shared
    by very many nodes is split by adaptive execution."""
    return with_coord_key(nodes).join(elevation.select(*KEY, "elevation"), KEY, "left")


def missing_elevations(coords: DataFrame, cache: DataFrame) -> DataFrame:
    """Coordinates not yet in the cache."""
    return coords.select(*KEY).distinct().join(cache.select(*KEY), KEY, "left_anti")


def sample_elevation_grid(points: DataFrame, grid: DataFrame, step_e6: int, method: str = "bilinear") -> DataFrame:
    """Sample a regular grid ``(lat_i, lon_i, elevation)`` at ``(lat_e6, lon_e6)`` points.

    Grid node ``i`` lies at ``i * step_e6`` micro-degrees. A point needs at most four
    grid nodes, found by one equi-join; a missing one that carries weight makes the
    result NULL."""
    step = F.lit(step_e6)
    points = points.select(*KEY).distinct()
    if method == "nearest":
        corners = [(F.floor(F.col("lat_e6") / step + 0.5), F.floor(F.col("lon_e6") / step + 0.5), F.lit(1.0))]
    elif method == "bilinear":
        i, j = F.floor(F.col("lat_e6") / step), F.floor(F.col("lon_e6") / step)
        u = (F.col("lat_e6") - i * step) / step
        v = (F.col("lon_e6") - j * step) / step
        corners = [
            (i, j, (1 - u) * (1 - v)),
            (i, j + 1, (1 - u) * v),
            (i + 1, j, u * (1 - v)),
            (i + 1, j + 1, u * v),
        ]
    else:
        raise ValueError(f"unknown method: {method}")
    needed = points.select(
        *KEY,
        F.inline(
            F.array(*[F.struct(a.cast("long").alias("lat_i"), b.cast("long").alias("lon_i"), w.alias("w")) for a, b, w in corners])
        ),
    ).filter(F.col("w") > 0)
    found = needed.join(grid.select("lat_i", "lon_i", "elevation"), ["lat_i", "lon_i"], "left")
    return found.groupBy(*KEY).agg(
        F.when(F.count("*") == F.count("elevation"), F.sum(F.col("w") * F.col("elevation"))).alias("elevation")
    )

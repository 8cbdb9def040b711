"""Areas: radius predicate, chunk grid, assignment of ways to chunks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from spark_climbs.functions.geo import KM_PER_DEGREE, arc_bulge_degrees, arc_distance_km, haversine_km, lon_difference
from spark_climbs.materialize import materialize

DEFAULT_CHUNK_KM = 8.0

# Fixed value: km per degree used to lay out the chunk grid.
GRID_KM_PER_DEGREE = 111.0


def _margins(center_lat: float, center_lon: float, radius_km: float) -> tuple[float, float | None]:
    """Degrees of latitude and longitude that a circle reaches; None for all longitudes, where it
    holds a pole or the box would wrap."""
    margin = radius_km / KM_PER_DEGREE * 1.000001 + 1e-9
    if abs(center_lat) + margin >= 89.0:
        return margin, None
    sine = math.sin(math.radians(min(margin, 90.0))) / math.cos(math.radians(center_lat))
    return margin, math.degrees(math.asin(min(1.0, sine))) * 1.000001


def _near(lat: Column, lon: Column, center_lat: float, center_lon: float, radius_km: float) -> Column:
    """Distance test behind a bounding box of plain comparisons, which Parquet can
    use to skip row groups. The box is left out on the axis where it would wrap."""
    margin, lon_margin = _margins(center_lat, center_lon, radius_km)
    test = lat.between(center_lat - margin, center_lat + margin)
    if lon_margin is not None and abs(center_lon) + lon_margin < 180.0:
        test &= lon.between(center_lon - lon_margin, center_lon + lon_margin)
    return test & (haversine_km(lat, lon, center_lat, center_lon) <= radius_km)


def _edge_near(a: dict, b: dict, center_lat: float, center_lon: float, radius_km: float) -> Column:
    """Whether an edge between two nodes comes within the radius, behind the same box: it is
    passed by edges that lie on one side of it, an arc's bulge to the pole allowed for."""
    margin, lon_margin = _margins(center_lat, center_lon, radius_km)
    dlon = lon_difference(b["lon"], a["lon"])
    slack = F.lit(margin) + arc_bulge_degrees(dlon)
    test = (F.greatest(a["lat"], b["lat"]) >= F.lit(center_lat) - slack) & (F.least(a["lat"], b["lat"]) <= F.lit(center_lat) + slack)
    if lon_margin is not None:
        # from the centre's meridian, the other end so many degrees on
        first = lon_difference(a["lon"], center_lon)
        east, west = F.greatest(first, first + dlon), F.least(first, first + dlon)
        beside = lambda turn: (east >= turn - lon_margin) & (west <= turn + lon_margin)
        test &= beside(0.0) | beside(360.0) | beside(-360.0)
    distance = arc_distance_km(center_lat, center_lon, a["lat"], a["lon"], b["lat"], b["lon"])
    return test & (distance <= radius_km)


def with_edges(way_nodes: DataFrame) -> DataFrame:
    """Long nodes ``(way_id, idx, lat, lon)`` with the next node of the way as ``to_lat, to_lon``;
    the last one of several is left out. Without ``idx`` every node stands alone."""
    if "idx" not in way_nodes.columns:
        return way_nodes.withColumns({"to_lat": F.col("lat"), "to_lon": F.col("lon")})
    own = [c for c in ("area_id", "way_id") if c in way_nodes.columns]
    along = Window.partitionBy(*own).orderBy("idx")
    rows = way_nodes.withColumns({"to_lat": F.lead("lat").over(along), "to_lon": F.lead("lon").over(along), "alone": F.lag("idx").over(along).isNull()})
    rows = rows.filter(F.col("to_lat").isNotNull() | F.col("alone"))
    return rows.withColumns({"to_lat": F.coalesce("to_lat", "lat"), "to_lon": F.coalesce("to_lon", "lon")}).drop("alone")


def within_radius(way_nodes: DataFrame, lat: float, lon: float, radius_km: float, longest_edge_km: float | None = None) -> DataFrame:
    """Ids of ways with a node or an edge within the radius, from the long node table. Keep
    whole ways with a left-semi join on the result.

    Edges need the nodes of a way together, in order of ``idx`` (a table without it is judged by its
    nodes). Where it is known that no edge is longer than ``longest_edge_km``, only nodes that near to the
    circle are read and shuffled."""
    if "idx" not in way_nodes.columns:
        return way_nodes.filter(_near(F.col("lat"), F.col("lon"), lat, lon, radius_km)).select("way_id").distinct()
    if longest_edge_km is not None:
        # both ends of an edge that comes within the radius are this near
        way_nodes = way_nodes.filter(_near(F.col("lat"), F.col("lon"), lat, lon, radius_km + longest_edge_km))
    edges = with_edges(way_nodes.select("way_id", "idx", "lat", "lon"))
    of = {c: F.col(c) for c in ("lat", "lon")}, {"lat": F.col("to_lat"), "lon": F.col("to_lon")}
    return edges.filter(_edge_near(*of, lat, lon, radius_km)).select("way_id").distinct()


def ways_within_radius(ways: DataFrame, lat: float, lon: float, radius_km: float) -> DataFrame:
    """Whole ways with a node or an edge within the radius. The nodes are nested in the way,
    so this is a filter: no explode, no join, no shuffle."""
    node = F.exists("nodes", lambda n: _near(n["lat"], n["lon"], lat, lon, radius_km))
    n = F.size("nodes")
    places = F.when(n > 1, F.sequence(F.lit(1), n - 1))
    edge = F.exists(places, lambda k: _edge_near(F.get("nodes", k - 1), F.get("nodes", k), lat, lon, radius_km))
    return ways.filter(node | F.coalesce(edge, F.lit(False)))


#: Columns of the coarsest and the finest grid around the globe, as powers of two, and how much finer
#: each grid is than the one before.
_COARSEST, _FINEST, _FINER = 3, 15, 2


def _cover_level(radius_km: Column) -> Column:
    """The finest grid with cells of a radius or more."""
    degrees = F.greatest(radius_km / F.lit(KM_PER_DEGREE), F.lit(1e-6))
    level = F.floor(F.log2(F.lit(360.0) / degrees)).cast("int")
    level = F.greatest(F.least(level, F.lit(_FINEST)), F.lit(_COARSEST))
    return level - (level - F.lit(_COARSEST)) % _FINER


def _area_cells(areas: DataFrame) -> DataFrame:
    """``level, i, j`` of the cells that the box of every area touches: nine or fewer for most,
    more columns where degrees of longitude are short."""
    size = F.lit(360.0) / F.pow(F.lit(2.0), F.col("level"))
    margin = F.col("radius_km") / F.lit(KM_PER_DEGREE) * 1.000001 + 1e-9
    sine = F.sin(F.radians(F.least(margin, F.lit(90.0)))) / F.cos(F.radians("center_lat"))
    lon_margin = F.when(F.abs("center_lat") + margin >= 89.0, F.lit(180.0)).otherwise(F.degrees(F.asin(F.least(sine, F.lit(1.0)))) * 1.000001)

    def cells(low: Column, high: Column) -> Column:
        return F.explode(F.sequence(F.floor(low / size).cast("int"), F.floor(high / size).cast("int")))

    of = areas.withColumn("level", _cover_level(F.col("radius_km"))).withColumns({"margin": margin, "lon_margin": lon_margin})
    lat, lon = F.col("center_lat") + 90.0, F.col("center_lon") + 180.0
    of = of.withColumn("i", cells(lat - F.col("margin"), lat + F.col("margin")))
    of = of.withColumn("j", cells(lon - F.col("lon_margin"), lon + F.col("lon_margin")))
    columns = F.pow(F.lit(2), F.col("level")).cast("int")
    return of.withColumn("j", F.pmod(F.col("j"), columns)).drop("margin", "lon_margin").distinct()


def ways_of_areas(way_nodes: DataFrame, areas: DataFrame) -> DataFrame:
    """``(area_id, way_id)`` of the ways with a node or an edge in each area ``(area_id, center_lat,
    center_lon, radius_km)``, however many and however they overlap.

    Areas are covered by cells of a grid that goes with their radius, and only pairs of one cell are tested.
    Edges are looked up in the cells that they cross from the coarsest grid to finer ones, in each inside the
    cells that hold a part of some area: an edge of any length costs a few rows, but for those where areas
    are. No edge is compared with every area."""
    cells = materialize(_area_cells(areas.select("area_id", "center_lat", "center_lon", "radius_km")), "cells")
    levels = sorted(r[0] for r in cells.select("level").distinct().collect())
    if not levels:
        return way_nodes.sparkSession.createDataFrame([], StructType([areas.schema["area_id"], way_nodes.schema["way_id"]]))
    edges = with_edges(way_nodes.select(*[c for c in ("way_id", "idx", "lat", "lon") if c in way_nodes.columns]))
    edges = edges.filter("lat is not null and lon is not null")
    near = arc_distance_km(F.col("center_lat"), F.col("center_lon"), F.col("lat"), F.col("lon"), F.col("to_lat"), F.col("to_lon"))
    inside, found = edges, None
    for level in range(_COARSEST, levels[-1] + 1, _FINER):
        up = F.col("level") - F.lit(level)
        coarser = [F.expr(f"shiftright({c}, level - {level})").alias(c) for c in ("i", "j")]
        wanted = cells.filter(up >= 0).select(*coarser).distinct()
        inside = _cells_inside(inside, level).withColumn("column", F.pmod("j", F.lit(1 << level)))
        here = (F.col("c.i") == F.col("w.i")) & (F.col("c.column") == F.col("w.j"))
        inside = inside.alias("c").join(wanted.alias("w"), here, "left_semi")
        if level in levels:
            inside = materialize(inside, "inside")
            own = cells.filter(up == 0).drop("level").withColumnRenamed("j", "column")
            pairs = inside.join(own, ["i", "column"]).filter(near <= F.col("radius_km")).select("area_id", "way_id")
            found = pairs if found is None else found.unionByName(pairs)
    return found.distinct()


def _cells_inside(edges: DataFrame, level: int) -> DataFrame:
    """The cells of a grid that edges cross, inside the cells ``i, j`` of the grid before if they have some.
    Columns count on across the antimeridian."""
    size = 360.0 / (1 << level)
    dlon = lon_difference(F.col("to_lon"), F.col("lon"))
    x = (F.col("lon") + 180.0) / size - 0.5
    placed = edges.withColumns(
        {"y0": (F.col("lat") + 90.0) / size - 0.5, "y1": (F.col("to_lat") + 90.0) / size - 0.5, "x0": x, "x1": x + dlon / size}
    )
    if "i" in edges.columns:
        placed = placed.withColumnsRenamed({"i": "above_i", "j": "above_j"})
        rows, columns = ((F.col(c) * (1 << _FINER), (F.col(c) + 1) * (1 << _FINER) - 1) for c in ("above_i", "above_j"))
    else:
        rows = columns = F.lit(-(1 << 20)), F.lit(1 << 20)
    # a little over half a cell: what rounds to one side in a grid may round to the other in the next
    half = F.lit(0.5 + 1e-9)
    touched = _crossed_cells(placed, rows, columns, half + arc_bulge_degrees(dlon) / size, half)
    return touched.select("way_id", "lat", "lon", "to_lat", "to_lon", "i", "j")


def _cell_center(i: Column, j: Column, size_km: float) -> tuple[Column, Column]:
    size = F.lit(float(size_km))
    return (
        F.col("center_lat") + i * size / F.lit(GRID_KM_PER_DEGREE),
        F.col("center_lon") + j * size / (F.lit(GRID_KM_PER_DEGREE) * F.cos(F.radians("center_lat"))),
    )


def chunk_grid(areas: DataFrame, size_km: float = DEFAULT_CHUNK_KM) -> DataFrame:
    """Chunks of areas ``(area_id, center_lat, center_lon, radius_km)``.

    A radius up to the chunk size is one chunk; else a square grid around the
    centre, keeping cells whose centre lies within the radius."""
    single = F.col("radius_km") <= size_km
    n = F.when(single, F.lit(0)).otherwise(F.ceil(F.col("radius_km") / size_km)).cast("int")
    steps = F.sequence(-F.col("n"), F.col("n"))
    lat, lon = _cell_center(F.col("i"), F.col("j"), size_km)
    in_order = Window.partitionBy("area_id").orderBy("i", "j")
    return (
        areas.withColumn("n", n)
        .withColumn("i", F.explode(steps))
        .withColumn("j", F.explode(steps))
        .withColumn("lat", lat)
        .withColumn("lon", lon)
        .filter(haversine_km(F.col("center_lat"), F.col("center_lon"), F.col("lat"), F.col("lon")) <= F.col("radius_km"))
        .select(
            "area_id",
            (F.row_number().over(in_order) - 1).alias("chunk_index"),
            "i",
            "j",
            "lat",
            "lon",
            F.when(single, F.col("radius_km")).otherwise(F.lit(size_km / 2.0)).alias("chunk_radius_km"),
            "center_lat",
            "center_lon",
            "radius_km",
        )
    )


def assign_chunks(
    way_nodes: DataFrame, chunks: DataFrame, size_km: float = DEFAULT_CHUNK_KM, cover: str = "square", unrolled: bool = False
) -> DataFrame:
    """Distinct ``(area_id, chunk_index, way_id)`` of ways with a node or an edge in a chunk.

    The grid is regular, so the cells that an edge can touch follow from arithmetic: the rows
    it passes, and in each row the columns between the places where it enters and leaves it.
    Edges are never compared with every chunk. They shrink to distinct way-cell
    rows (combined map-side) before the equi-join that looks up the chunk number.
    ``way_nodes`` carries ``area_id`` when there are several areas, and ``idx`` for edges.
    ``square`` tiles the area without gaps (edges are straight in degrees there), ``circle`` is the disc
    of the chunk radius (edges are arcs). ``unrolled``: longitudes run on past 180, and square chunks take
    them as they are, no edge the other way round.
    """
    if cover not in ("square", "circle"):
        raise ValueError(f"unknown cover: {cover}")
    centers = chunks.select("area_id", "center_lat", "center_lon", "radius_km").distinct()
    edges = with_edges(way_nodes.select(*[c for c in ("area_id", "way_id", "idx", "lat", "lon") if c in way_nodes.columns]))
    if "area_id" in way_nodes.columns:
        located = edges.join(centers, "area_id")
    else:
        found = centers.limit(2).collect()
        if len(found) != 1:
            raise ValueError("nodes without area_id need chunks of exactly one area")
        located = edges.select("*", *[F.lit(v).alias(c) for c, v in found[0].asDict().items()])

    single = F.col("radius_km") <= size_km
    n = F.when(single, F.lit(0)).otherwise(F.ceil(F.col("radius_km") / size_km)).cast("int")
    lat_step = F.lit(size_km / GRID_KM_PER_DEGREE)
    lon_step = F.lit(float(size_km)) / (F.lit(GRID_KM_PER_DEGREE) * F.cos(F.radians("center_lat")))
    chunk_radius = F.when(single, F.col("radius_km")).otherwise(F.lit(size_km / 2.0))
    apart = (lambda lon, origin: lon - origin) if unrolled and cover == "square" else lon_difference
    first = apart(F.col("lon"), F.col("center_lon"))
    far = first + apart(F.col("to_lon"), F.col("lon"))
    placed = located.withColumns(
        {
            "y0": (F.col("lat") - F.col("center_lat")) / lat_step,
            "y1": (F.col("to_lat") - F.col("center_lat")) / lat_step,
            "x0": first / lon_step,
            "x1": far / lon_step,
        }
    )
    center = _cell_center(F.col("i"), F.col("j"), size_km)
    in_disc = arc_distance_km(*center, F.col("lat"), F.col("lon"), F.col("to_lat"), F.col("to_lon")) <= chunk_radius
    if cover == "square":
        # A single chunk is the whole area: its disc, as in the radius predicate.
        cells = _crossed_cells(placed, (-n, n), (-n, n), F.lit(0.5), F.lit(0.5))
        one = placed.filter(single).withColumns({"i": F.lit(0), "j": F.lit(0)}).filter(in_disc)
        touched = cells.filter(~single).unionByName(one.select(cells.columns))
    else:
        reach = chunk_radius / F.lit(KM_PER_DEGREE) * 1.001
        bulge = arc_bulge_degrees(lon_difference(F.col("to_lon"), F.col("lon")))
        far_lat = F.least(F.greatest(F.abs("lat"), F.abs("to_lat")) + reach + bulge, F.lit(89.9))
        lon_reach = F.least(reach / F.cos(F.radians(far_lat)) * 1.01, F.lit(360.0))
        # at any longitude, an arc strays from the straight line by less than the bulge
        touched = _crossed_cells(placed, (-n, n), (-n, n), (reach + bulge) / lat_step, lon_reach / lon_step).filter(in_disc)
    per_cell = touched.select("area_id", "i", "j", "way_id").distinct()
    numbers = chunks.select("area_id", "i", "j", "chunk_index")
    return per_cell.join(numbers, ["area_id", "i", "j"]).select("area_id", "chunk_index", "way_id")


def _crossed_cells(edges: DataFrame, i: tuple[Column, Column], j: tuple[Column, Column], y_reach: Column, x_reach: Column) -> DataFrame:
    """A row for each cell ``i, j`` (in units of cells, whose centres are whole numbers; first and last of
    both are given) whose centre an edge from ``x0, y0`` to ``x1, y1`` may come within the reach of on both axes."""

    def cells(low: Column, high: Column, given: tuple[Column, Column]) -> Column:
        low, high = F.greatest(low.cast("int"), given[0]), F.least(high.cast("int"), given[1])
        return F.explode(F.when(low <= high, F.sequence(low, high)))

    reached = edges.withColumns({"y_reach": y_reach, "x_reach": x_reach})
    # a place half way between two cells belongs to the one that follows
    low = F.least("y0", "y1") - F.col("y_reach")
    high = F.greatest("y0", "y1") + F.col("y_reach")
    rows = reached.withColumn("i", cells(F.floor(low) + 1, F.floor(high), i))
    rise = F.col("y1") - F.col("y0")
    at = lambda side: F.greatest(F.least((F.col("i") + side * F.col("y_reach") - F.col("y0")) / rise, F.lit(1.0)), F.lit(0.0))
    whole = F.abs(rise) < 1e-12
    enter, leave = F.when(whole, F.lit(0.0)).otherwise(at(-1)), F.when(whole, F.lit(1.0)).otherwise(at(1))
    x = lambda t: F.col("x0") + t * (F.col("x1") - F.col("x0"))
    rows = rows.withColumns({"xa": x(enter), "xb": x(leave)})
    low = F.least("xa", "xb") - F.col("x_reach")
    high = F.greatest("xa", "xb") + F.col("x_reach")
    return rows.withColumn("j", cells(F.floor(low) + 1, F.floor(high), j)).drop("y_reach", "x_reach", "xa", "xb")

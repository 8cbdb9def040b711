"""Removal of duplicate segments, first one wins.

Both steps work on the narrow form of segments (``segment_ends``). Segments with an ``area_id`` are
compared inside their area only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spark_climbs.functions.geo import cartesian_m, haversine_km, is_valid_coord
from spark_climbs.materialize import discard, materialize

DEFAULT_TOLERANCE_M = 10.0

_ENDS = ("start_lat", "start_lon", "end_lat", "end_lon")
_PLACED = ("scope", *_ENDS)


def _scope(segments: DataFrame) -> Column:
    return (F.col("area_id") if "area_id" in segments.columns else F.lit(0)).alias("scope")


def dedup_exact(segments: DataFrame) -> DataFrame:
    """First segment of every set of way ids; segments without way ids all stay.
    ``min_by`` combines copies before the shuffle."""
    keyed = segments.filter(F.size("way_ids") > 0)
    rest = [c for c in segments.columns if c != "seq"]
    first = (
        keyed.groupBy(_scope(segments), F.array_sort("way_ids").alias("id_set"))
        .agg(F.min_by(F.struct("seq", *rest), "seq").alias("first"))
        .select("first.*")
        .select(*segments.columns)
    )
    return first.unionByName(segments.filter(F.coalesce(F.size("way_ids") <= 0, F.lit(True))))


def dedup_near(segments: DataFrame, tol_m: float = DEFAULT_TOLERANCE_M, unrolled: bool = False) -> DataFrame:
    """Drop a segment when an earlier *kept* one starts and ends within ``tol_m`` of
    it (same direction). Segments without valid ends are kept. ``unrolled``: longitudes past 180 are
    valid, and mean the place they come round to."""
    kept = _first_kept(_valid_ends(segments, unrolled), tol_m).select("seq")
    return segments.join(kept, "seq", "left_semi").unionByName(segments.filter(~_has_valid_ends(unrolled)))


def near_duplicates(segments: DataFrame, tol_m: float = DEFAULT_TOLERANCE_M, unrolled: bool = False) -> DataFrame:
    """``(dropped_seq, kept_seq)``: every segment ``dedup_near`` drops with the first
    kept one that rules it out. One row per dropped segment, never all pairs."""
    ends = _valid_ends(segments, unrolled)
    kept = _first_kept(ends, tol_m)
    lost = _with_cells(ends.join(kept.select("seq"), "seq", "left_anti"), tol_m)
    here, there = _in_block(lost).alias("m"), _in_reached_blocks(kept).alias("r")
    return (
        here.join(there, (F.col("m.block") == F.col("r.block")) & _alike("m", "r", tol_m))
        .groupBy(F.col("m.seq").alias("dropped_seq"))
        .agg(F.min("r.seq").alias("kept_seq"))
    )


def _has_valid_ends(unrolled: bool) -> Column:
    start, end = (is_valid_coord(F.col(f"{e}_lat"), F.col(f"{e}_lon"), unrolled) for e in ("start", "end"))
    return start & end


def _valid_ends(segments: DataFrame, unrolled: bool) -> DataFrame:
    return segments.filter(_has_valid_ends(unrolled)).select("seq", _scope(segments), *_ENDS)


def _first_kept(ends: DataFrame, tol_m: float) -> DataFrame:
    """The segments a greedy scan in ``seq`` order keeps, found in parallel rounds:

    * segments with identical ends collapse to the first of them, map-side;
    * ends fall into small cells whose members are all alike, so each start-end
      cell pair can keep at most one segment and offers only its first undecided;
    * an offer is kept when no undecided segment of a reachable cell precedes it;
    * everything alike to a kept segment is dropped.

    Offers are at most one per cell pair, so a crowded place costs rows, not
    pairs of rows. Undecided rows are the only input of the next round, whatever
    their number; the first of them is decided in each, so the rounds end.
    """
    first = ends.groupBy(*_PLACED).agg(F.min("seq").alias("seq"))
    undecided = materialize(_with_cells(first, tol_m), "undecided")
    kept = None
    while kept is None or not undecided.isEmpty():
        winners = materialize(_unopposed(_offers(undecided), tol_m), "kept")
        kept = winners if kept is None else kept.unionByName(winners)
        before, undecided = undecided, materialize(_without_alike(undecided, winners, tol_m), "undecided")
        discard(before)
    discard(undecided)
    return kept


_CELLS = tuple(f"c{axis}" for axis in range(6))
_REACH_CELLS = 2  # cells further apart than this hold nothing alike
_BLOCK_CELLS = 20  # cells per edge of the blocks that candidates are joined on


def _with_cells(ends: DataFrame, tol_m: float) -> DataFrame:
    """Add the cells of both ends. The diagonal of a cell is below the tolerance."""
    side = tol_m * 0.57
    xyz = (*cartesian_m(F.col("start_lat"), F.col("start_lon")), *cartesian_m(F.col("end_lat"), F.col("end_lon")))
    return ends.select("seq", *_PLACED, *[F.floor(x / side).cast("int").alias(c) for x, c in zip(xyz, _CELLS)])


def _offers(undecided: DataFrame) -> DataFrame:
    """First undecided segment of every cell pair, and whether it is the only one."""
    return undecided.groupBy("scope", *_CELLS).agg(
        F.min("seq").alias("seq"), *[F.min_by(c, "seq").alias(c) for c in _ENDS], (F.count("*") == 1).alias("alone")
    )


def _block_of(cell: Column) -> Column:
    return F.floor(cell / _BLOCK_CELLS).cast("int")


def _in_block(rows: DataFrame) -> DataFrame:
    """Add the join key of the block. A hash collision only adds a tested pair."""
    return rows.withColumn("block", F.xxhash64("scope", *[_block_of(F.col(c)) for c in _CELLS]))


def _in_reached_blocks(rows: DataFrame) -> DataFrame:
    """One row per block within reach: mostly one per axis, two near an edge."""
    for c in _CELLS:
        low, high = _block_of(F.col(c) - _REACH_CELLS), _block_of(F.col(c) + _REACH_CELLS)
        rows = rows.withColumn(f"b_{c}", F.explode(F.sequence(low, high)))
    blocks = [f"b_{c}" for c in _CELLS]
    return rows.withColumn("block", F.xxhash64("scope", *blocks)).drop(*blocks)


def _alike(a: str, b: str, tol_m: float) -> Column:
    def apart(end: str) -> Column:
        return haversine_km(
            F.col(f"{a}.{end}_lat"), F.col(f"{a}.{end}_lon"), F.col(f"{b}.{end}_lat"), F.col(f"{b}.{end}_lon")
        ) * F.lit(1000.0)

    return _same_scope(a, b) & (apart("start") < tol_m) & (apart("end") < tol_m)


def _same_scope(a: str, b: str) -> Column:
    return F.col(f"{a}.scope").eqNullSafe(F.col(f"{b}.scope"))


def _within_reach(a: str, b: str) -> Column:
    near = _same_scope(a, b)
    for c in _CELLS:
        near &= F.abs(F.col(f"{a}.{c}") - F.col(f"{b}.{c}")) <= _REACH_CELLS
    return near


def _unopposed(offers: DataFrame, tol_m: float) -> DataFrame:
    """Offers that no earlier undecided segment can rule out. A cell pair with one
    undecided segment is tested exactly; a fuller one blocks whatever it reaches."""
    mine, rivals = _in_block(offers).alias("m"), _in_reached_blocks(offers).alias("r")
    blocked = (
        (F.col("r.seq") < F.col("m.seq")) & _within_reach("m", "r") & (~F.col("r.alone") | _alike("m", "r", tol_m))
    )
    return mine.join(rivals, (F.col("m.block") == F.col("r.block")) & blocked, "left_anti").select("seq", *_PLACED, *_CELLS)


def _without_alike(undecided: DataFrame, winners: DataFrame, tol_m: float) -> DataFrame:
    here, there = _in_block(undecided).alias("m"), _in_reached_blocks(winners).alias("r")
    return here.join(there, (F.col("m.block") == F.col("r.block")) & _alike("m", "r", tol_m), "left_anti").drop("block")

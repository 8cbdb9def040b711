"""Joining road pieces into continuous roads.

Both merges are greedy scans whose outcome depends on order. Only ids, counts and
end points take part in them, never geometry; they say where each piece goes, and
Spark rebuilds the roads from that.

``members`` (one row per piece): ``road_id`` (``seq`` of the first piece), ``seq``,
``attach_no`` (order of joining), ``road_pos`` (order along the road),
``reversed``, ``drop_head`` / ``drop_tail`` (the joint node left out, in the
piece's own direction).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import count

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spark_climbs.materialize import discard, materialize
from spark_climbs.operators.chains import (
    CLAIM_COLUMNS,
    END_ARM,
    HEAD,
    PIECE_COLUMNS,
    START_ARM,
    TAIL,
    play_tiles,
    whole_groups,
)
from spark_climbs.operators.roads import segment_ends

DEFAULT_TOLERANCE_DEG = 0.002

# A tile is this many tolerances wide.
TILE_TOLERANCES = 80

ROWS_PER_TASK = 20_000

#: Rows of a group of tiles at most (some 20 seconds of one task), and the coarsest grid.
GROUP_ROWS, MAX_LEVEL = 200_000, 40

_CLAIM = ", ".join(f"{c} long" for c in CLAIM_COLUMNS)


def endpoint_members(
    ends: DataFrame,
    tol_deg: float = DEFAULT_TOLERANCE_DEG,
    split_on_surface: bool = False,
    tile_deg: float | None = None,
) -> DataFrame:
    """Cross-chunk merge of ``segment_ends`` rows (with two or more nodes) to ``members``.

    Per street, longest piece (most nodes) first: attach the first unused piece
    with an end inside the tolerance box of either end of the road, until none is
    left, then start the next road.

    The map is cut into tiles, and every tile scans its own pieces. A tile claims
    pieces for roads; claims on pieces that another tile also knows are handed to
    that tile, and tiles with news scan again, until no claim changes. Claims
    carry their place in the order of the scan and each depends only on earlier
    ones, so what remains is exactly the result of one scan over everything.

    Tiles with news are contracted: in each round those that lie in one cell of a grid four times as
    wide as in the round before become one group, which scans as one. A road over
    n tiles thus takes about log4(n) rounds, while a street of any size is never brought into one
    task: a group has at most ``GROUP_ROWS`` rows, and where that is reached, groups go on handing
    claims to each other. Only what changed is compared. Pieces without valid ends are roads of their own;
    those with an ``area_id`` join pieces of their area only.
    """
    if tile_deg is not None and tile_deg < tol_deg * 2.5:
        raise ValueError("a tile must be wider than two tolerances")
    parts = ["street_name", "surface"] if split_on_surface else ["street_name"]
    if "area_id" in ends.columns:
        parts.append("area_id")
    pieces = ends.select("seq", F.concat_ws("\0", *parts).alias("street"), "n_nodes", "start_lat", "start_lon", "end_lat", "end_lon")
    located = pieces
    for c in ("start_lat", "start_lon", "end_lat", "end_lon"):
        located = located.filter(F.col(c).isNotNull() & ~F.isnan(c))
    known = materialize(_known_pieces(located, tol_deg, tile_deg or tol_deg * TILE_TOLERANCES), "tiles")
    return _members_of_claims(pieces, _settled_claims(known, tol_deg))


def _settled_claims(known: DataFrame, tol: float) -> DataFrame:
    """Claims of all tiles after as many rounds as bring news."""
    shared = known.filter("shared").select("tile", "seq")
    own = F.min(F.struct("street_key", "row", "col"))
    sizes = known.groupBy("tile").agg(own.alias("at"), F.count("*").alias("n_rows"))
    sizes = materialize(sizes.select("tile", "at.*", "n_rows"), "tile_sizes")
    first = _play(known.withColumn("grp", F.col("tile")), None, tol, _scan_tasks(known))
    border = materialize(first.filter("on_border").drop("on_border"), "border")
    changed, groups = border.select("seq", "tile"), None
    later, runs = None, None
    for round_no in count(1):
        fresh = materialize(_regrouped(sizes, groups, _with_news(changed, shared, groups), round_no), "fresh")
        n_rows = fresh.agg(F.sum("n_rows")).first()[0]
        if n_rows is None:
            break
        moved = fresh.select("tile", "grp")
        groups = materialize(moved if groups is None else _replaced(groups, moved, moved), "groups")
        again = _play(known.join(moved, "tile"), _visible(shared, moved, groups, border), tol, max(1, n_rows // ROWS_PER_TASK))
        border, changed = _exchanged(border, moved, again.filter("on_border").drop("on_border"))
        again, run = again.withColumn("round", F.lit(round_no)), moved.select("tile", F.lit(round_no).alias("round"))
        later = again if later is None else later.unionByName(again)
        runs = run if runs is None else runs.unionByName(run)
    if runs is None:
        return first.drop("on_border", "support")
    last = runs.groupBy("tile").agg(F.max("round").alias("round"))
    final = first.join(last, "tile", "left_anti").unionByName(later.join(last, ["tile", "round"], "left_semi").drop("round"))
    return final.drop("on_border", "support")


def _tile_key(street: Column, lat: Column, lon: Column, size: float) -> Column:
    return F.xxhash64(street, F.lit(size), F.floor(lat / size), F.floor(lon / size))


def _known_pieces(pieces: DataFrame, tol: float, size: float) -> DataFrame:
    """``(tile, piece)`` rows: a piece is known to the tiles of its ends and to those
    whose core lies within the tolerance of an end. ``start_in`` / ``end_in`` tell
    which ends lie in the core; ``shared`` pieces are known to other tiles too. ``street_key, row,
    col`` say where the tile is."""
    reach = tol * 1.001

    def place(lat: Column, lon: Column) -> Column:
        key = _tile_key(F.col("street"), lat, lon, size)
        return F.struct(key.alias("tile"), F.floor(lat / size).alias("row"), F.floor(lon / size).alias("col"))

    corners = [
        place(F.col(f"{end}_lat") + F.lit(i * reach), F.col(f"{end}_lon") + F.lit(j * reach))
        for end in ("start", "end")
        for i in (-1, 1)
        for j in (-1, 1)
    ]
    tiles = F.array_distinct(F.array(*corners))
    known = pieces.withColumn("shared", F.size(tiles) > 1).withColumn("of", F.explode(tiles)).select("*", "of.*").drop("of")
    homes = {end: _tile_key(F.col("street"), F.col(f"{end}_lat"), F.col(f"{end}_lon"), size) for end in ("start", "end")}
    known = known.withColumn("street_key", F.xxhash64("street"))
    return known.withColumns({f"{end}_in": home == F.col("tile") for end, home in homes.items()})


def _scan_tasks(rows: DataFrame) -> int:
    """Tasks for a scan of a written table, in proportion to its rows: its work is in
    its steps and not in its bytes, which is what adaptive coalescing goes by."""
    return max(1, rows.count() // ROWS_PER_TASK)


def _play(known: DataFrame, visible: DataFrame | None, tol: float, n_tasks: int) -> DataFrame:
    """One round of scanning, given what other groups claim. Rows arrive sorted by group,
    so a task walks through many small groups in one Arrow stream instead of paying
    per group."""
    rows = known.select("grp", "tile", "shared", "start_in", "end_in", *PIECE_COLUMNS).withColumns(
        {"is_claim": F.lit(False), "has_h": F.lit(False), "support": F.lit(""), **{c: F.lit(0).cast("long") for c in CLAIM_COLUMNS[1:]}}
    )
    if visible is not None:
        theirs = visible.withColumns({"is_claim": F.lit(True), "has_h": F.col("h_seq").isNotNull()})
        rows = rows.unionByName(theirs, allowMissingColumns=True)
        # Whole numbers stay whole in pandas only without NULLs.
        rows = rows.fillna(0, ["tile", "n_nodes", "h_n", "h_seq"]).fillna(False, ["shared", "start_in", "end_in"])

    def walk(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_groups(batches, "grp"):
            yield play_tiles(frame, tol)

    in_order = rows.repartition(n_tasks, "grp").sortWithinPartitions("grp", "is_claim", F.desc("n_nodes"), "seq")
    return materialize(in_order.mapInPandas(walk, f"tile long, on_border boolean, {_CLAIM}, support string"), "claims")


def _in_group(rows: DataFrame, groups: DataFrame | None, tile: str, grp: str) -> DataFrame:
    """The rows with the group of a tile; one that never had news is a group by itself."""
    if groups is None:
        return rows.withColumn(grp, F.col(tile))
    of = groups.select(F.col("tile").alias(f"{grp}_tile"), F.col("grp").alias(f"{grp}_own"))
    rows = rows.join(of, F.col(tile) == F.col(f"{grp}_tile"), "left")
    return rows.withColumn(grp, F.coalesce(f"{grp}_own", tile)).drop(f"{grp}_tile", f"{grp}_own")


def _with_news(changed: DataFrame, shared: DataFrame, groups: DataFrame | None) -> DataFrame:
    """Groups with a tile that knows a piece on which another group has changed a claim."""
    news = changed.select("seq", F.col("tile").alias("from")).distinct()
    told = _in_group(_in_group(shared.join(news, "seq"), groups, "tile", "grp"), groups, "from", "from_grp")
    return told.filter(F.col("grp") != F.col("from_grp")).select("grp").distinct()


def _regrouped(sizes: DataFrame, groups: DataFrame | None, news: DataFrame, round_no: int) -> DataFrame:
    """``tile, n_rows, grp`` of the tiles of groups with news: by the cell of this round's grid, or the group
    they had where that would have too many rows. Every second grid is shifted by half a cell, as
    some roads follow the edge of the last."""
    level = min(2 * round_no, MAX_LEVEL)
    shift = (1 << level - 1) * (round_no % 2)
    cell = [F.shiftright(F.col(c) + F.lit(shift), level) for c in ("row", "col")]
    of = _in_group(sizes, groups, "tile", "grp").join(news, "grp", "left_semi")
    of = of.withColumn("cell", F.xxhash64("street_key", F.lit(round_no), *cell))
    total = F.sum("n_rows").over(Window.partitionBy("cell"))
    return of.select("tile", "n_rows", F.when(total <= GROUP_ROWS, F.col("cell")).otherwise(F.col("grp")).alias("grp"))


def _replaced(rows: DataFrame, tiles: DataFrame, new: DataFrame) -> DataFrame:
    return rows.join(tiles.select("tile"), "tile", "left_anti").unionByName(new)


def _visible(shared: DataFrame, moved: DataFrame, groups: DataFrame, border: DataFrame) -> DataFrame:
    """Claims of other groups on the pieces of the groups that scan again, by name."""
    pieces = shared.join(moved, "tile").select("grp", "seq").distinct()
    theirs = _in_group(pieces.join(border.drop("support"), "seq"), groups, "tile", "from_grp")
    theirs = theirs.filter(F.col("grp") != F.col("from_grp")).drop("tile", "from_grp")
    return theirs.withColumn("support", _name())


def _name() -> Column:
    """A claim's name, which tells it from any other one."""
    return F.md5(F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in CLAIM_COLUMNS]))


def _exchanged(border: DataFrame, moved: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The claims on the border after the groups of the ``moved`` tiles scanned again, and the
    pieces and tiles of the claims that came or went.

    A claim built on one that has been withdrawn goes as well, link by link, or groups could
    go on handing each other an arm without a beginning."""
    keys = ["tile", *CLAIM_COLUMNS]
    old = border.join(moved, "tile", "left_semi")
    both = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in keys]
    without = lambda a, b: a.alias("l").join(b.alias("r"), both, "left_anti")
    gone = without(old, new).select("seq", "tile", _name().alias("name"))
    changed = materialize(gone.unionByName(without(new, old).select("seq", "tile", F.lit(None).cast("string").alias("name"))), "changed")
    border = materialize(_replaced(border, moved, new), "border")
    lost = changed.filter("name is not null").select("name").distinct()
    while True:
        # one of the same name that is still there, by another tile, supports as well
        named = border.withColumn("name", _name())
        lost = lost.join(named.select("name"), "name", "left_anti").select(F.col("name").alias("lost"))
        orphans = materialize(named.join(lost, F.col("support") == F.col("lost"), "left_semi"), "orphans")
        if orphans.isEmpty():
            return border, changed.select("seq", "tile")
        changed = changed.unionByName(orphans.select("seq", "tile", "name"))
        border = materialize(without(border, orphans), "border")
        lost = orphans.select("name").distinct()


def _members_of_claims(pieces: DataFrame, claims: DataFrame) -> DataFrame:
    """Lay out roads from claims.

    Along the seed's direction, the end arm counts up from the seed and the start arm
    down. The road ends at the arm that last joined a piece by its head. Joining
    leaves out the joined piece's own joint node; only a piece put before the start
    by its tail makes the road lose its first node instead."""
    own = F.col("s_seq").isNull()
    joined = pieces.select("seq", "n_nodes").join(claims.drop("tile"), "seq", "left").select(
        "seq",
        F.coalesce("s_seq", "seq").alias("road_id"),
        F.when(own, -F.col("n_nodes")).otherwise(F.col("cm_n")).alias("cm_n"),
        F.when(own, F.col("seq")).otherwise(F.col("cm_seq")).alias("cm_seq"),
        F.coalesce("k", F.lit(0)).alias("k"),
        F.coalesce("arm", F.lit(END_ARM)).alias("arm"),
        F.coalesce("via", F.lit(HEAD)).alias("via"),
        own.alias("is_seed"),
    )
    in_time = Window.partitionBy("road_id").orderBy("cm_n", "cm_seq", "k")
    by_head = F.when(F.col("via") == HEAD, F.col("arm"))
    timed = joined.withColumns(
        {
            "attach_no": (F.row_number().over(in_time) - 1).cast("int"),
            "end_before": F.last(by_head, ignorenulls=True).over(in_time.rowsBetween(Window.unboundedPreceding, -1)),
            "end_last": F.last(by_head, ignorenulls=True).over(
                in_time.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
            ),
        }
    )
    at_start = F.col("arm") != F.col("end_before")
    before_start = ~F.col("is_seed") & at_start & (F.col("via") == TAIL)
    placed = timed.withColumns(
        {
            "along": F.when(F.col("arm") == END_ARM, F.col("k")).otherwise(-F.col("k")),
            "backward": F.when(F.col("arm") == END_ARM, F.col("via") == TAIL).otherwise(F.col("via") == HEAD),
            "spares_own": before_start,
        }
    )
    along = Window.partitionBy("road_id").orderBy("along")
    after, before = F.lead("spares_own").over(along), F.lag("spares_own").over(along)
    after_arm, before_arm = F.lead("arm").over(along), F.lag("arm").over(along)
    lost = placed.withColumns(
        {
            "lost_after": F.coalesce(after & (after_arm == END_ARM), F.lit(False)),
            "lost_before": F.coalesce(before & (before_arm == START_ARM), F.lit(False)),
        }
    )
    own_joint = ~F.col("is_seed") & ~F.col("spares_own")
    turned = F.col("end_last") == START_ARM
    order = F.when(turned, -F.col("along")).otherwise(F.col("along"))
    first = F.min(order).over(Window.partitionBy("road_id"))
    return lost.select(
        "road_id",
        "seq",
        "attach_no",
        (order - first).cast("int").alias("road_pos"),
        (F.col("backward") != turned).alias("reversed"),
        (
            (own_joint & (F.col("via") == HEAD)) | F.when(F.col("backward"), F.col("lost_after")).otherwise(F.col("lost_before"))
        ).alias("drop_head"),
        (
            (own_joint & (F.col("via") == TAIL)) | F.when(F.col("backward"), F.col("lost_before")).otherwise(F.col("lost_after"))
        ).alias("drop_tail"),
    )


def node_members(ways: DataFrame) -> DataFrame:
    """In-chunk merge of ways ``(seq, scope, street_name, head_id, tail_id)`` that
    share a node: from each unused way in order, append the first unused way that
    begins at the node the road ends at. Ways meet only inside a scope (a chunk) and
    street; a way without the id of an end does not meet others there.

    Arrivals at a node in the order of their time (seed of the road, then place in it) each take
    the first way left that begins there and comes after the seed, as all before the seed are in use. That
    follows from the times, node by node; the times follow from the links by ranking the chains, pointers
    doubling their reach. The two steps alternate until no link changes, which is the scan's result:
    links depend on earlier times only, so each round settles the earliest ones left. No task holds more than
    the ways at one node.
    """
    ways = materialize(ways.select("seq", "scope", "street_name", "head_id", "tail_id"), "ways")
    node = ["scope", "street_name", "node"]
    heads = ways.select("seq", "scope", "street_name", F.col("head_id").alias("node")).filter("node is not null")
    tails = ways.select("seq", "scope", "street_name", F.col("tail_id").alias("node")).filter("node is not null")
    same = [heads[c].eqNullSafe(tails[c]) for c in node]
    # nodes where none begins or none ends have nothing to link
    starts = materialize(heads.join(tails, same, "left_semi"), "starts")
    same = [tails[c].eqNullSafe(starts[c]) for c in node]
    stops = materialize(tails.join(starts, same, "left_semi"), "stops")
    seqs = ways.select("seq")
    times = ways.select("seq", F.col("seq").alias("seed"), F.lit(0).alias("step"))
    links = None
    while True:
        before, links = links, materialize(_node_links(starts, stops, times), "links")
        if before is not None and _same_links(before, links):
            break
        discard(before)
        times = _ranked(seqs, links)
    return times.select(
        F.col("seed").alias("road_id"),
        "seq",
        F.col("step").alias("attach_no"),
        F.col("step").alias("road_pos"),
        F.lit(False).alias("reversed"),
        (F.col("step") > 0).alias("drop_head"),
        F.lit(False).alias("drop_tail"),
    )


def _node_links(starts: DataFrame, stops: DataFrame, times: DataFrame) -> DataFrame:
    """``seq, next``: which way every arrival takes. The j-th arrival at a node takes the way
    at place max(place of the one before + 1, number of ways up to its seed), a running maximum."""
    none = F.lit(None).cast("long")
    begin = starts.select("scope", "street_name", "node", F.col("seq").alias("time"), F.lit(0).alias("step"), none.alias("seq"), F.col("seq").alias("next"))
    arrive = stops.join(times, "seq").select("scope", "street_name", "node", F.col("seed").alias("time"), "step", "seq", none.alias("next"))
    here = Window.partitionBy("scope", "street_name", "node")
    # a way comes before an arrival of its own time
    in_time = here.orderBy("time", F.col("next").isNull(), "step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_way, is_arrival = F.col("next").isNotNull().cast("long"), F.col("seq").isNotNull().cast("long")
    rows = begin.unionByName(arrive).withColumns({"ways": F.sum(is_way).over(in_time), "arrivals": F.sum(is_arrival).over(in_time)})
    lead = F.max(F.when(F.col("seq").isNotNull(), F.col("ways") - F.col("arrivals"))).over(in_time)
    placed = rows.withColumn("place", F.when(F.col("seq").isNotNull(), F.col("arrivals") + lead).otherwise(F.col("ways") - 1))
    met = placed.groupBy("scope", "street_name", "node", "place").agg(F.max("seq").alias("seq"), F.max("next").alias("next"))
    return met.filter("seq is not null and next is not null").select("seq", "next")


def _same_links(before: DataFrame, after: DataFrame) -> bool:
    return before.count() == after.count() and after.join(before, ["seq", "next"], "left_anti").isEmpty()


def _ranked(seqs: DataFrame, links: DataFrame) -> DataFrame:
    """``seq, seed, step``: first way of every chain of links and the place in it. Every row points at one
    before it in its chain, and takes over where that one points, so reach doubles each round. A chain that
    is closed (before all links are settled) is opened at its first way."""
    from_ = links.select(F.col("next").alias("of"), F.col("seq").alias("before"))
    rows = seqs.join(from_, F.col("seq") == F.col("of"), "left").select(
        "seq",
        F.coalesce("before", "seq").alias("seed"),
        F.col("before").isNotNull().cast("int").alias("step"),
        F.least("seq", F.coalesce("before", "seq")).alias("low"),
        F.col("before").isNull().alias("done"),
    )
    rows = materialize(rows, "times")
    open_, done, rounds = rows.filter(~F.col("done")), [rows.filter("done")], 0
    n_open = open_.count()
    all_rounds, made = n_open.bit_length(), [rows]
    while n_open and rounds <= all_rounds:
        ahead = rows.select(*[F.col(c).alias(f"a_{c}") for c in rows.columns])
        on = open_.join(ahead, F.col("seed") == F.col("a_seq"))
        on = on.select("seq", F.col("a_seed").alias("seed"), (F.col("step") + F.col("a_step")).alias("step"), F.least("low", "a_low").alias("low"), F.col("a_done").alias("done"))
        on = materialize(on, "times")
        made.append(on)
        done.append(on.filter("done"))
        open_ = on.filter(~F.col("done"))
        rows = _union(*done, open_)
        n_open, rounds = open_.count(), rounds + 1
    if n_open:
        closed = open_.filter("seq = low").select(F.col("seq").alias("first"))
        return _ranked(seqs, materialize(links.join(closed, F.col("next") == F.col("first"), "left_anti"), "links"))
    return materialize(_union(*done).select("seq", "seed", "step"), "ranked")


def _union(first: DataFrame, *others: DataFrame) -> DataFrame:
    for other in others:
        first = first.unionByName(other)
    return first


def merged_roads(members: DataFrame, ends: DataFrame) -> DataFrame:
    """Attributes of merged roads: way ids in order of joining, the start and end of
    the road, and surface / track type of the first joined piece that knows one."""
    m = members.join(ends, "seq")
    no = F.col("attach_no")
    known_track = ~F.col("tracktype").isin("unknown", "not_applicable")
    track = F.struct("tracktype", "tracktype_definition")

    def first_where(value: Column, test: Column) -> Column:
        return F.min_by(F.when(test, value), F.when(test, no))

    def oriented(a: str, b: str, axis: str) -> Column:
        return F.when(F.col("reversed"), F.col(f"{a}_{axis}")).otherwise(F.col(f"{b}_{axis}"))

    start = F.struct(oriented("end", "start", "lat").alias("lat"), oriented("end", "start", "lon").alias("lon"))
    end = F.struct(oriented("start", "end", "lat").alias("lat"), oriented("start", "end", "lon").alias("lon"))
    by_joining = F.array_sort(F.collect_list(F.struct(no, F.col("way_ids"))))
    area = [c for c in ("area_id",) if c in ends.columns]
    roads = m.groupBy("road_id").agg(
        F.flatten(F.transform(by_joining, lambda x: x["way_ids"])).alias("way_ids"),
        F.min_by(F.get("way_ids", F.lit(0)), no).alias("first_way_id"),
        *[F.min_by(c, no).alias(c) for c in ("street_name", *area)],
        F.coalesce(first_where(F.col("surface"), F.col("surface") != "unknown"), F.lit("unknown")).alias("surface"),
        F.coalesce(first_where(track, known_track), F.min_by(track, no)).alias("track"),
        F.count("*").alias("n_pieces"),
        F.sum(F.col("n_nodes") - F.col("drop_head").cast("int") - F.col("drop_tail").cast("int")).alias("n_nodes"),
        F.min_by(start, "road_pos").alias("start"),
        F.max_by(end, "road_pos").alias("end"),
    )
    return roads.select(
        "road_id",
        *area,
        "way_ids",
        "first_way_id",
        "street_name",
        "surface",
        "track.*",
        "n_pieces",
        "n_nodes",
        F.col("start.lat").alias("start_lat"),
        F.col("start.lon").alias("start_lon"),
        F.col("end.lat").alias("end_lat"),
        F.col("end.lon").alias("end_lon"),
    )


def road_nodes(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes of merged roads in long form, joint nodes left out.

    ``nodes`` is ``(seq, pos, n_nodes, ...)`` with ``pos`` from 0. ``piece_pos`` counts
    along the road inside a piece, so ``(road_id, road_pos, piece_pos)`` orders it."""
    last = F.col("n_nodes") - 1
    return (
        nodes.join(members, "seq")
        .filter(~(F.col("drop_head") & (F.col("pos") == 0)) & ~(F.col("drop_tail") & (F.col("pos") == last)))
        .withColumn("piece_pos", F.when(F.col("reversed"), last - F.col("pos")).otherwise(F.col("pos")))
    )


def merge_by_endpoint(
    segments: DataFrame, tol_deg: float = DEFAULT_TOLERANCE_DEG, split_on_surface: bool = False
) -> DataFrame:
    """Cross-chunk merge of segments, with the merged geometry as node arrays. The
    pipeline uses ``endpoint_members`` and keeps nodes in long form instead."""
    ends = materialize(segment_ends(segments), "ends")
    members = materialize(endpoint_members(ends, tol_deg, split_on_surface), "members")
    return _with_geometry(merged_roads(members, ends), members, segments)


#: Ends that meet, in the order in which they are tried.
KINDS = ("end1_to_start2", "end1_to_end2", "start1_to_start2", "start1_to_end2")


def connection_kind(a: Column, b: Column, tol_deg: float = DEFAULT_TOLERANCE_DEG) -> Column:
    """Which ends of two segments (structs) meet in the tolerance box, the first of ``KINDS``; NULL for
    segments of different streets, without two nodes, or apart."""

    def end(segment: Column, which: str) -> Column:
        return F.element_at(segment["nodes"], 1 if which.startswith("start") else -1)

    kind = F.lit(None).cast("string")
    for name in reversed(KINDS):
        p, q = (end(s, which) for s, which in zip((a, b), name.split("_to_")))
        meets = (F.abs(p["lat"] - q["lat"]) < tol_deg) & (F.abs(p["lon"] - q["lon"]) < tol_deg)
        kind = F.when(meets, name).otherwise(kind)
    whole = (F.size(a["nodes"]) > 1) & (F.size(b["nodes"]) > 1)
    return F.when((a["street_name"] == b["street_name"]) & whole, kind)


def connect(a: Column, b: Column, kind: Column) -> Column:
    """Two segments (structs) joined by the ends that ``kind`` names, one of the joint nodes left out:
    way ids in order of joining, what the first one knows, and the second one's surface and track type
    where the first does not know them. Without a kind, the nodes follow each other."""
    first, second = a["nodes"], b["nodes"]
    rest = lambda nodes: F.slice(nodes, 2, F.greatest(F.size(nodes) - 1, F.lit(0)))
    nodes = (
        F.when(kind == "end1_to_start2", F.concat(first, rest(second)))
        .when(kind == "end1_to_end2", F.concat(first, rest(F.reverse(second))))
        .when(kind == "start1_to_start2", F.concat(F.reverse(first), rest(second)))
        .when(kind == "start1_to_end2", F.concat(second, rest(first)))
        .otherwise(F.concat(first, second))
    )
    unknown = lambda t: t.isin("unknown", "not_applicable")
    learns = unknown(a["tracktype"]) & ~unknown(b["tracktype"])
    return F.struct(
        F.concat(a["way_ids"], b["way_ids"]).alias("way_ids"),
        nodes.alias("nodes"),
        a["street_name"].alias("street_name"),
        F.when((a["surface"] == "unknown") & (b["surface"] != "unknown"), b["surface"]).otherwise(a["surface"]).alias("surface"),
        *[F.when(learns, b[c]).otherwise(a[c]).alias(c) for c in ("tracktype", "tracktype_definition")],
    )


def merge_by_node_id(segments: DataFrame, scope: Column | None = None) -> DataFrame:
    """In-chunk merge of segments that share a node id, with merged node arrays. Ends, attributes and
    geometry each read the segments, so they are written once."""
    segments = materialize(segments, "segments")
    head, tail = F.get("nodes", F.lit(0)), F.get("nodes", F.size("nodes") - 1)
    ways = segments.select(
        "seq",
        (F.lit(0) if scope is None else scope).alias("scope"),
        "street_name",
        head["node_id"].alias("head_id"),
        tail["node_id"].alias("tail_id"),
    )
    members = materialize(node_members(ways), "members")
    roads = merged_roads(members, segment_ends(segments))
    own = segments.select(F.col("seq").alias("road_id"), "surface", "tracktype", "tracktype_definition")
    roads = roads.drop("surface", "tracktype", "tracktype_definition").join(own, "road_id")
    return _with_geometry(roads, members, segments)


def _with_geometry(roads: DataFrame, members: DataFrame, segments: DataFrame) -> DataFrame:
    """Concatenate the node arrays of the pieces of every road."""
    head, tail = F.col("drop_head").cast("int"), F.col("drop_tail").cast("int")
    kept = F.slice("nodes", head + 1, F.greatest(F.size("nodes") - head - tail, F.lit(0)))
    turned = F.when(F.col("reversed"), F.reverse(kept)).otherwise(kept)
    geometry = (
        segments.select("seq", "nodes")
        .join(members, "seq")
        .groupBy("road_id")
        .agg(F.array_sort(F.collect_list(F.struct("road_pos", turned.alias("nodes")))).alias("parts"))
        .select("road_id", F.flatten(F.transform("parts", lambda p: p["nodes"])).alias("nodes"))
    )
    return roads.join(geometry, "road_id")

"""Merkle manifest of a dataset: a root over all rows and a proof for each, by pointer jumping.

Every row is a leaf, the SHA-256 of its columns. In each group leaves stand in order, and runs
of two become their hash until one node, the subroot, is left; the subroots, ordered by
group, become the root in the same way.

1. Leaves are numbered in their groups: sorted in ranges, counted per range, and the
   counts summed over the ranges before. A large group is many ranges.
2. Nodes are hashed in blocks of ``2 ** BLOCK_BITS`` neighbours, that many levels in one pass;
   the tops of the blocks are the leaves of the next pass (three passes reach 2 ** 36 rows).
   Every node gets its first segment, the sibling on the step to its parent.
3. Pointer jumping: a node's segment leads to an ancestor, and a self-join appends the segment that
   the ancestor holds, which doubles the distance. Only ancestors whose level a later round
   still asks for are kept, so what is joined to the leaves shrinks with the square root
   of the tree each round. A subroot's own segment is its way to the root, found by the same means
   over the subroots. Where a jump spans more than ``BLOCK_BITS`` levels, an ancestor is
   laid out once for each block of leaves under it, so no key has more than a block of rows.

A path is binary, ``STEP`` = 33 bytes for each level: ``L`` or ``R`` (the sibling stands left or
right) and its digest, or ``N`` and zeros where the run holds one node alone.

What meets on the driver: the size of the largest group and the root.

Defined results: null values are leaves as ``-``; a null group is a group and comes first; null ids come
first, equal ids are ordered by their leaf, and rows equal in all columns follow
their place in a written table (their digests are the same in any order); texts are hashed
whole; other columns are not read; an empty table has no rows and no root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField

from spark_climbs.materialize import discard, materialize

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels that one pass hashes: a block is 4096 nodes.
BLOCK_BITS = 12
STEP = 33
_ALONE = b"N" + bytes(32)


def digest(*columns: Column) -> Column:
    """SHA-256 of a row, in hex: ``-`` for each null, else the UTF-8 size, ``:`` and the value."""
    told = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in told]), 256)


def _run_numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows with their number among those of their group in this task."""
    last, count = None, 0
    for batch in batches:
        groups = batch.column("grp").to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]]) if len(groups) else np.zeros(0, int)
        sizes = np.diff(np.r_[starts, len(groups)])
        at = np.arange(len(groups)) - np.repeat(starts, sizes)
        if len(groups):
            if groups[0] == last:
                at[: sizes[0]] += count
            last, count = groups[-1], int(at[-1]) + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int64())], [*batch.schema.names, "at"])


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Written rows with ``pos``, their number in the order inside their ``grp``, and ``size``,
    the number of rows of the group."""
    columns = rows.columns
    tie = F.xxhash64("_metadata.file_path", "_metadata.row_index")
    keys = ["grp", *order, "tie"]
    dealt = rows.select(*columns, tie.alias("tie")).repartitionByRange(*[F.col(k).asc_nulls_first() for k in keys])
    dealt = dealt.sortWithinPartitions(*[F.col(k).asc_nulls_first() for k in keys]).withColumn("part", F.spark_partition_id())
    schema = ", ".join(f"`{c}` {t}" for c, t in dealt.dtypes) + ", at long"
    done = materialize(dealt.mapInArrow(_run_numbers, schema).drop("tie"), "numbered")
    counts = done.groupBy("grp", "part").agg(F.count("*").alias("n"))
    every = Window.partitionBy("grp")
    before = every.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("grp", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.sum("n").over(every).alias("size"))
    return done.join(counts, ["grp", "part"]).select(*columns, (F.col("at") + F.col("before")).alias("pos"), "size")


def _levels(start: int):
    """For one block of a pass that begins at level ``start``: a row for every node with its step
    to its parent, and one for the block's top with its digest."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        size = table.column("size")[0].as_py()
        depth = (size - 1).bit_length()
        first = table.column("pos")[0].as_py()
        nodes = [d.hex() for d in table.column("digest").to_pylist()]
        levels, places, steps, digests = [], [], [], []
        level = start
        while level < min(depth, start + BLOCK_BITS):
            count = len(nodes)
            levels += [level] * count
            places += range(first, first + count)
            for k in range(0, count - 1, 2):
                steps.append(b"R" + bytes.fromhex(nodes[k + 1]))
                steps.append(b"L" + bytes.fromhex(nodes[k]))
            if count % 2:
                steps.append(_ALONE)
            nodes = [hashlib.sha256("".join(nodes[k : k + 2]).encode()).hexdigest() for k in range(0, count, 2)]
            level, first = level + 1, first >> 1
        levels.append(level)
        places.append(first)
        digests = [None] * len(steps) + [bytes.fromhex(nodes[0])]
        n = len(levels)
        made = {
            "level": pa.array(levels, pa.int32()),
            "pos": pa.array(places, pa.int64()),
            "path": pa.array([*steps, None], pa.binary()),
            "digest": pa.array(digests, pa.binary()),
            "grp": pa.repeat(table.column("grp")[0], n),
            "size": pa.repeat(pa.scalar(size, pa.int64()), n),
        }
        # what leaves carry stays with their rows, which come first; a block's top is also a
        # row of the next pass, or the only leaf of its group
        alone = start == 0 and depth == 0
        rest = n if alone else n - table.num_rows
        for name in table.schema.names:
            if name not in made:
                column = table.column(name)
                if start or alone:
                    made[name] = pa.nulls(n, column.type) if start else column
                else:
                    made[name] = pa.chunked_array([*column.chunks, pa.nulls(rest, column.type)])
        return pa.table(made)

    return run


def _tree(leaves: DataFrame, deepest: int, made: list[DataFrame]) -> DataFrame:
    """Nodes of the trees of ``grp, pos, size, digest`` and what else leaves carry: the same
    columns with ``level`` and ``path`` (the first segment). The top of a group has no path
    but its digest."""
    columns = ["level", "pos", "path", "digest", "grp", "size", *[c for c in leaves.columns if c not in ("pos", "digest", "grp", "size", "block")]]
    fields = {f.name: f for f in leaves.schema.fields}
    types = {c: fields[c].dataType.simpleString() if c in fields else {"level": "int", "path": "binary"}[c] for c in columns}
    depth = F.ceil(F.log2(F.col("size"))).cast("int")
    start, rows, out = 0, leaves, None
    while True:
        blocks = rows.withColumn("block", F.shiftright("pos", BLOCK_BITS))
        order = ["grp", "pos", "size", "digest", *columns[6:]]
        schema = ", ".join(f"`{c}` {types[c]}" for c in columns)
        nodes = blocks.select("block", *order).groupBy("grp", "block").applyInArrow(_without_block(_levels(start), columns), schema)
        nodes = materialize(nodes, "nodes")
        made.append(nodes)
        ended = F.col("digest").isNotNull() & (F.col("level") == depth)
        kept = nodes.filter(F.col("path").isNotNull() | ended)
        out = kept if out is None else out.unionByName(kept)
        start += BLOCK_BITS
        if start >= deepest:
            return out
        rows = nodes.filter(F.col("digest").isNotNull() & (F.col("level") < depth)).drop("level", "path")


def _without_block(run, columns: list[str]):
    def on(table: pa.Table) -> pa.Table:
        return run(table.drop_columns(["block"])).select(columns)

    return on


def _jumped(nodes: DataFrame, deepest: int) -> DataFrame:
    """Leaves with whole paths, from ``grp, level, pos, size, path, subroot``: every round joins the
    nodes of every second kept level with the ancestors that their paths lead to."""
    distance = 1
    while distance <= deepest:
        # the ancestor of ``distance`` levels on, keyed by it or by a block of what is under it
        shift = min(distance, BLOCK_BITS)
        near = nodes.filter(F.col("level") % (2 * distance) == 0).withColumn("key", F.shiftright("pos", shift))
        far = nodes.filter(F.col("level") % (2 * distance) == distance)
        if distance > shift:
            low = F.col("level") - distance
            last = F.shiftright(F.call_function("shiftright", F.col("size") - 1, low), shift)
            under = distance - shift
            first = F.shiftleft("pos", under)
            far = far.withColumn("key", F.explode(F.sequence(first, F.least(F.shiftleft(F.col("pos") + 1, under) - 1, last))))
        else:
            far = far.withColumn("key", F.col("pos"))
        far = far.select(F.col("grp").alias("f_grp"), (F.col("level") - distance).alias("f_level"), F.col("key").alias("f_key"), F.col("path").alias("f_path"), F.col("subroot").alias("f_subroot"))
        on = (F.col("grp") == F.col("f_grp")) & (F.col("level") == F.col("f_level")) & (F.col("key") == F.col("f_key"))
        joined = near.join(far, on, "left").drop("key", "f_grp", "f_level", "f_key")
        further = materialize(
            joined.withColumns(
                {"path": F.concat("path", F.coalesce("f_path", F.lit(b""))), "subroot": F.coalesce("subroot", "f_subroot")}
            ).drop("f_path", "f_subroot"),
            "segments",
        )
        discard(nodes)
        nodes, distance = further, distance * 2
    return nodes.filter("level = 0")


def _depth(leaves: DataFrame) -> int:
    return max((leaves.agg(F.max("size")).first()[0] or 1) - 1, 0).bit_length()


def prove(documents: DataFrame, columns: tuple[str, ...] = COLUMNS, group: str = "lang", order: str = "doc_id", **more: Column) -> DataFrame:
    """For every row: the ``order`` column, ``grp``, ``pos`` (its place in its group), ``leaf``,
    ``path``, ``subroot`` and ``root`` (digests as binary), and ``more``: columns of the given
    names computed from its row."""
    named = F.col(f"`{group}`").cast("string")
    rows = documents.select(
        F.col(f"`{order}`").alias("id"),
        # a null group sorts before all others
        F.coalesce(F.concat(F.lit("="), named), F.lit("")).alias("grp"),
        F.unhex(digest(*[F.col(f"`{c}`") for c in columns])).alias("digest"),
        *[c.alias(f"more_{name}") for name, c in more.items()],
    )
    written = materialize(rows, "leaves")
    leaves = materialize(numbered(written, ["id", "digest"]).withColumn("leaf", F.col("digest")), "placed")
    deepest, made = _depth(leaves), []
    nodes = _tree(leaves, deepest, made)
    # the subroots are the leaves of one more tree
    tops = nodes.filter(F.col("digest").isNotNull()).select(F.lit("").alias("grp"), F.col("grp").alias("name"), "digest")
    tops = numbered(materialize(tops, "subroots"), ["name"]).withColumn("subroot", F.col("digest"))
    tops = materialize(tops, "tops")
    upper, upper_made = _depth(tops), []
    crown = _tree(tops, upper, upper_made)
    root = crown.filter(F.col("digest").isNotNull()).select("digest").first()
    # a path over no level is empty; the last record of a chain has nothing to append
    ways = _jumped(crown.withColumn("path", F.coalesce("path", F.lit(b""))).drop("digest"), upper)
    ways = ways.select(F.col("name").alias("w_grp"), F.col("path").alias("w_path"), F.col("subroot").alias("w_subroot"))
    steps = nodes.filter(F.col("path").isNotNull()).drop("digest").withColumn("subroot", F.lit(None).cast("binary"))
    ends = nodes.filter(F.col("digest").isNotNull()).drop("path", "digest").join(ways, F.col("grp") == F.col("w_grp"))
    ends = ends.withColumnRenamed("w_path", "path").withColumnRenamed("w_subroot", "subroot").drop("w_grp")
    chains = materialize(steps.unionByName(ends), "segments")
    discard(written, leaves, *made, *upper_made)
    out = _jumped(chains, deepest)
    return out.select(
        F.col("id").alias(order), "grp", "pos", "leaf", "path", "subroot", F.lit(None if root is None else bytes(root[0])).alias("root"), *[F.col(f"more_{n}").alias(n) for n in more]
    )


def fold(leaf: bytes, path: bytes) -> bytes:
    """The root that a leaf and a path give."""
    at = leaf.hex()
    for k in range(0, len(path), STEP):
        side, other = path[k : k + 1], path[k + 1 : k + STEP].hex()
        at = hashlib.sha256((at + other if side == b"R" else other + at if side == b"L" else at).encode()).hexdigest()
    return bytes.fromhex(at)


def siblings(path: bytes) -> bytes:
    """SHA-256 of the siblings of a path, in hex, one after the other."""
    return hashlib.sha256("".join(path[k + 1 : k + STEP].hex() for k in range(0, len(path), STEP) if path[k : k + 1] != b"N").encode()).digest()


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        paths = batch.column("path").to_pylist()
        folded = [fold(leaf, path) for leaf, path in zip(batch.column("shown").to_pylist(), paths)]
        kept = [batch.column(c) for c in batch.schema.names if c not in ("path", "shown")]
        names = [c for c in batch.schema.names if c not in ("path", "shown")]
        yield pa.RecordBatch.from_arrays([*kept, pa.array([siblings(p) for p in paths], pa.binary()), pa.array(folded, pa.binary())], [*names, "proof", "folded"])


def verify(proofs: DataFrame, shown: str = "leaf") -> DataFrame:
    """Proofs whose column ``shown`` is checked against them: hex digests ``leaf, subroot, root,
    proof_sha256, folded_root`` and whether the last is the root."""
    rows = proofs.withColumn("shown", F.col(shown)).select(proofs.columns[0], "leaf", "subroot", "root", "path", "shown")
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes if c not in ("path", "shown")) + ", proof binary, folded binary"
    hexed = lambda c: F.lower(F.hex(c))
    done = rows.mapInArrow(_verified, schema)
    return done.select(
        proofs.columns[0],
        *[hexed(c).alias(c) for c in ("leaf", "subroot", "root")],
        hexed("proof").alias("proof_sha256"),
        hexed("folded").alias("folded_root"),
        (F.col("folded") == F.col("root")).alias("verified"),
    )


def tampering(documents: DataFrame) -> DataFrame:
    """The proofs of all documents, verified after one was added to ``n_chars`` of those whose
    id's crc32 is divisible by seven."""
    wrong = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False))
    n_chars = F.when(wrong, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    shown = F.unhex(digest(*[n_chars if c == "n_chars" else F.col(c) for c in COLUMNS]))
    return verify(prove(documents, shown=shown), "shown")

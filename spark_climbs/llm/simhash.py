"""SimHash near duplicates through a byte-position inverted index with count filtering.

Fingerprints within ``MAX_BITS`` = 4 differing bits differ in at most four of their
eight bytes, so at least four bytes agree in place. The index lists every distinct
fingerprint under sets of three (position, byte) entries; the twenty sets are chosen so
that any four agreeing positions hold one of them whole. Of the fingerprints that meet
in a list, those with fewer than four agreeing bytes are dropped by that count, and
the rest verified by their differing bits.

Lists are read in order, in streams; a list gives links of a spanning forest, not its
pairs: a search from one fingerprint takes what it reaches out of the list, so a crowd
of near copies costs about its own length. Links of all lists make the components.

Defined results: null, empty and blank texts have fingerprint zero and link like any
other; a null doc_id can be a member but never names a component (null if no member
has an id); equal rows share fingerprint and component; an empty table gives an empty
result; other columns are not touched. Texts are processed whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spark_climbs.llm import words
from spark_climbs.llm.kept import release
from spark_climbs.materialize import materialize
from spark_climbs.operators.graph import components

SHINGLE, SEED, MAX_BITS, BYTES = 4, 42, 4, 8
#: Bytes that must agree, as a bit difference spoils one byte at most.
AGREE = BYTES - MAX_BITS


def position_sets() -> list[tuple[int, int, int]]:
    """Twenty sets of three byte positions; every four positions hold one. With the
    positions in three groups, these are the sets inside a group and those with two
    from a group and one from the next (Turan's design)."""
    groups = ((0, 1, 2), (3, 4, 5), (6, 7))
    of = {p: g for g, group in enumerate(groups) for p in group}
    out = []
    for a in range(BYTES):
        for b in range(a + 1, BYTES):
            for c in range(b + 1, BYTES):
                kinds = sorted(of[p] for p in (a, b, c))
                if len(set(kinds)) == 1 or (len(set(kinds)) == 2 and (min(kinds, key=kinds.count) - max(kinds, key=kinds.count)) % 3 == 1):
                    out.append((a, b, c))
    return out


def fingerprint(text: str | None) -> int:
    """64-bit SimHash of the word shingles, repeats included."""
    import xxhash

    of = text.encode().lower().split() if text else []
    if not of:
        return 0
    shingles = zip(*(of[k:] for k in range(SHINGLE))) if len(of) >= SHINGLE else [of]
    one = xxhash.xxh64_intdigest
    hashes = np.array([one(b" ".join(s), SEED) for s in shingles], dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for start in range(0, len(hashes), 8192):
        part = hashes[start : start + 8192].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprint_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    for batch in batches:
        values = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], dtype=np.uint64)
        columns = [batch.column("doc_id"), batch.column("text_key"), pa.array(values.view(np.int64))]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "fp"])


def fingerprints(documents: DataFrame) -> DataFrame:
    """``doc_id, text_key`` (hash of the text)``, fp`` (the bits as a long), written once."""
    rows = documents.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), "text")
    return materialize(rows.mapInArrow(_fingerprint_rows, "doc_id long, text_key long, fp long"), "fingerprints")


def forest(values: np.ndarray) -> list[tuple[int, int]]:
    """Links of a spanning forest of the fingerprints within ``MAX_BITS`` bits."""
    rest, links = values, []
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            one = queue.pop()
            differ = rest ^ one
            agree = np.count_nonzero(differ.view(np.uint8).reshape(-1, BYTES) == 0, axis=1) >= AGREE
            near = agree & (np.bitwise_count(differ) <= MAX_BITS)
            if near.any():
                found = rest[near]
                links += [(one, x) for x in found]
                queue.extend(found)
                rest = rest[~near]
    return links


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Forest links of each run of equal ``key`` in sorted rows."""

    def batch_of(links):
        u, v = (np.array([x[k] for x in links], dtype=np.uint64).view(np.int64) for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    release()
    held_key, held = None, []
    for batch in batches:
        key = batch.column("key").to_numpy()
        fp = batch.column("fp").to_numpy().view(np.uint64)
        links: list[tuple[int, int]] = []
        cuts = np.flatnonzero(np.diff(key)) + 1
        starts, ends = np.r_[0, cuts], np.r_[cuts, len(key)]
        if len(key) and key[0] == held_key:
            held.append(fp[: ends[0]])
            starts, ends = starts[1:], ends[1:]
        if len(starts):
            if held:
                links += forest(np.concatenate(held))
            long = np.flatnonzero(ends - starts > 1)
            for k in long[long < len(starts) - 1]:
                links += forest(fp[starts[k] : ends[k]])
            held_key, held = key[starts[-1]], [fp[starts[-1] :]]
        if links:
            yield batch_of(links)
    if held and (links := forest(np.concatenate(held))):
        yield batch_of(links)


def links(prints: DataFrame) -> DataFrame:
    """Links ``(u, v)`` between distinct fingerprints that connect all that are within
    ``MAX_BITS`` of each other."""
    byte_sets = position_sets()
    distinct = prints.select("fp").distinct()
    entry = lambda k, s: F.struct(
        F.xxhash64(F.lit(k), *[F.shiftrightunsigned("fp", 8 * p).bitwiseAND(255) for p in s]).alias("key")
    )
    listed = distinct.select(F.explode(F.array(*[entry(k, s) for k, s in enumerate(byte_sets)])).alias("e"), "fp")
    lists = listed.select("e.key", "fp").repartition("key").sortWithinPartitions("key")
    return lists.mapInArrow(_linked, "u long, v long").distinct()


def groups(documents: DataFrame) -> DataFrame:
    """``doc_id, text_key, fp, component_id`` of every document."""
    prints = fingerprints(documents)
    found = components(links(prints))
    low = prints.groupBy("fp").agg(F.min("doc_id").alias("low"))
    classed = low.join(found, F.col("fp") == F.col("vertex"), "left").select(
        "fp", "low", F.coalesce("component", "fp").alias("component")
    )
    least = classed.groupBy("component").agg(F.min("low").alias("component_id"))
    named = classed.join(least, "component").select(F.col("fp").alias("own_fp"), "component_id")
    return prints.join(named, F.col("fp") == F.col("own_fp")).select("doc_id", "text_key", "fp", "component_id")


def near_duplicates(documents: DataFrame) -> DataFrame:
    """``doc_id, fingerprint`` (16 hexadecimal digits) and ``component_id``."""
    return groups(documents).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def first_of_each(documents: DataFrame) -> DataFrame:
    """One document of each group: the one with the smallest id, and of equal ids the one
    with the smallest text hash. Documents keep their own columns."""
    inner, outer = words.carried(documents, "doc_id", "text")
    smallest = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("k")
    # a component without ids goes by its fingerprint
    of = [F.coalesce("component_id", "fp").alias("g"), F.col("component_id").isNull().alias("unnamed")]
    kept = groups(inner).groupBy(*of).agg(smallest).select(F.col("k.doc_id").alias("__doc"), F.col("k.text_key").alias("__key"))
    rows = inner.withColumn("__text_key", F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("__text_key") == F.col("__key"))
    once = Window.partitionBy("__doc", "__key").orderBy(F.lit(0))
    found = rows.join(kept.distinct(), same).withColumn("__copy", F.row_number().over(once)).filter("__copy = 1")
    return outer(found)

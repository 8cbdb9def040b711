"""Removal of repeated passages by column-wise construction over many documents.

A byte goes when a string of ``length`` bytes (400, or what a ``Shape`` says) that covers it also starts anywhere
else. Equal strings hold equal anchors: grams (of 256 bytes) whose hash is the least in
some stretch of a string's grams. So only places around anchors that occur twice or
more can be repeated, and two equal strings lie alike around theirs.

1. Equal texts become one row with a count, in a table bucketed by the text's hash, so
   that later joins with the texts do not shuffle them.
2. Each text lists its anchors, with a hash of the bytes around each. Anchors that occur once
   are dropped; around those that always have the same surroundings all is repeated.
3. For the rest, the strings around an anchor are cut into ranges of starts.
   The strings of a range share a core; only the bytes left and right of it differ. Cores are
   grouped, and the columns of all fragments of a group inserted from the right to the
   left: each round inserts one symbol per fragment (the core is one symbol), updates the order of
   the suffixes, which is a stable sort by the new symbol, and the common prefixes of
   neighbours, which grow by one or are cut to the least between. After a round
   on the left, a fragment whose common prefix with a neighbour is 400 or more starts a
   repeated string there. This is multi-document BWT construction with its LCP array, a
   column at a time, over files sorted by core (the shuffle's); as only equal columns can
   match, the columns of a round need not be merged with those before, so the work is
   linear in fragments instead of the square of the longest text.
4. Spans are merged in each text and cut out.

   A core with more than ``BATCH`` differing fragments is not one task's: its strings are
   counted by place and added bytes instead, with the same result.

Tasks hold one text, or twice ``BATCH`` fragments (some 650 bytes each at work) and a batch
of rows. Grams, cores, fragments and texts are told apart by 64-bit hashes.

Defined results: null and empty texts have no bytes and lose none; matches never cross
documents; equal texts of that length or more are removed whole, in all rows, whatever
their ids; a null doc_id is kept; an empty table gives an empty result; texts are
processed whole; other columns are not read by ``spans`` and are carried by ``cut``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spark_climbs.llm import words
from spark_climbs.llm.kept import release
from spark_climbs.materialize import discard, materialize, save_bucketed



class Shape(NamedTuple):
    """Sizes of what is compared: strings of ``length`` bytes around grams of ``gram`` (a power of
    two), whose starts are cut into ``ranges`` of equal width."""

    length: int
    gram: int
    ranges: int

    @property
    def starts(self) -> int:
        return self.length - self.gram + 1

    @property
    def width(self) -> int:
        return self.starts // self.ranges

    @property
    def side(self) -> int:
        return self.width - 1

    @property
    def core(self) -> int:
        return self.length - self.width + 1


#: Strings of 400 bytes, and of some 40 words for passages of over 50.
LONG, PASSAGE = Shape(400, 256, 5), Shape(199, 128, 4)
#: Fragments whose columns are inserted together.
BATCH = 60_000
_PAD = 256
_ONE, _SPREAD = np.uint64(1), np.uint64(0xBF58476D1CE4E5B9)


def gram_hashes(data: np.ndarray, shape: Shape = LONG) -> np.ndarray:
    """Hash of the ``gram`` bytes from every place, by doubling."""
    h, factor, size = data.astype(np.uint64) + _ONE, 0x9E3779B97F4A7C15, 1
    while size < shape.gram:
        h = h[:-size] * np.uint64(factor) + h[size:]
        factor = factor * factor % (1 << 64)
        size *= 2
    h = (h ^ (h >> np.uint64(29))) * _SPREAD
    return h ^ (h >> np.uint64(32))


def _slide(values: np.ndarray, width: int, take) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        values = take(values[:-size], values[size:])
        size *= 2
    return take(values[: len(values) - (width - size)], values[width - size :]) if size < width else values


def anchors(data: np.ndarray, shape: Shape = LONG) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the grams that are the least of some string's grams."""
    if len(data) < shape.length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = gram_hashes(data, shape)
    edge = np.zeros(shape.starts - 1, np.uint64)
    least = _slide(h, shape.starts, np.minimum)
    at = np.flatnonzero(_slide(np.concatenate([edge, least, edge]), shape.starts, np.maximum) == h)
    return at, h[at]


def _anchor_rows(batches: Iterator[pa.RecordBatch], shape: Shape) -> Iterator[pa.RecordBatch]:
    import xxhash

    release()
    for batch in batches:
        for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
            raw = text.encode() if text else b""
            at, grams = anchors(np.frombuffer(raw, dtype=np.uint8), shape)
            if not len(at):
                continue
            around = [xxhash.xxh64_intdigest(raw[max(0, a - shape.starts + 1) : a + shape.length], max(0, shape.starts - 1 - a)) for a in at.tolist()]
            columns = [
                pa.array(np.full(len(at), key, dtype=np.int64)),
                pa.array(at.astype(np.int32)),
                pa.array(grams.view(np.int64)),
                pa.array(np.array(around, dtype=np.uint64).view(np.int64)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["key", "at", "gram", "around"])


def _fragment_rows(batches: Iterator[pa.RecordBatch], shape: Shape) -> Iterator[pa.RecordBatch]:
    """Core, both sides (with their lengths, shorter at a text's ends), a hash of both and the
    first start of every range."""
    import xxhash

    for batch in batches:
        for key, text, places in zip(*(batch.column(c).to_pylist() for c in ("key", "text", "places"))):
            raw = text.encode()
            cores, sides, kinds, starts, last = [], [], [], [], len(raw) - shape.length
            for base in sorted({a - shape.starts + 1 + r * shape.width for a in places for r in range(shape.ranges)}):
                low, high = max(base, 0), min(base + shape.side, last)
                if low > high:
                    continue
                core = xxhash.xxh64_intdigest(raw[base + shape.side : base + shape.length])
                left, right = raw[low : base + shape.side], raw[base + shape.length : high + shape.length]
                # the sides with their lengths, so that padding is told from bytes
                sides.append(bytes([len(left), len(right)]) + left + right)
                cores.append(core)
                kinds.append(xxhash.xxh64_intdigest(sides[-1], core))
                starts.append(base)
            if cores:
                columns = [
                    pa.array(np.array(cores, dtype=np.uint64).view(np.int64)),
                    pa.array(sides, pa.binary()),
                    pa.array(np.array(kinds, dtype=np.uint64).view(np.int64)),
                    pa.array(np.full(len(cores), key, dtype=np.int64)),
                    pa.array(starts, pa.int32()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["core", "sides", "kind", "key", "base"])


def _insert(order: np.ndarray, common: np.ndarray, group: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One round: the order of the suffixes with one more symbol in front, and the common
    prefixes of neighbours (0 before a group's first)."""
    key = group[order] * 512 + symbol[order]
    by = np.argsort(key, kind="stable")
    same = np.zeros(len(by), dtype=bool)
    same[1:] = key[by[1:]] == key[by[:-1]]
    out = np.zeros(len(by), dtype=np.int64)
    follow = np.flatnonzero(same)
    if len(follow):
        # the least common prefix between the places that the two had before
        pairs = np.stack([by[follow - 1] + 1, by[follow] + 1], axis=1).ravel()
        out[follow] = 1 + np.minimum.reduceat(np.append(common, 0), pairs)[::2]
    return order[by], out


def repeated_starts(group: np.ndarray, sides: list[bytes], shape: Shape = LONG) -> np.ndarray:
    """For fragments in order of their group, which of the ``width`` strings of each also
    occur in another fragment of the group at the same column."""
    m = len(sides)
    columns = np.full((m, 2 * shape.side), _PAD, dtype=np.int64)
    for k, s in enumerate(sides):
        n_left, n_right = s[0], s[1]
        columns[k, shape.side - n_left : shape.side] = np.frombuffer(s, np.uint8, n_left, 2)
        columns[k, shape.side : shape.side + n_right] = np.frombuffer(s, np.uint8, n_right, 2 + n_left)
    order, common = np.arange(m), np.zeros(m, dtype=np.int64)
    for c in range(2 * shape.side - 1, shape.side - 1, -1):
        order, common = _insert(order, common, group, columns[:, c])
    first = np.r_[True, group[order[1:]] != group[order[:-1]]]
    common = np.where(first, 0, common + shape.core)
    out = np.zeros((m, shape.width), dtype=bool)
    for c in range(shape.side, -1, -1):
        if c < shape.side:
            order, common = _insert(order, common, group, columns[:, c])
        long = common >= shape.length
        out[order, c] = long | np.r_[long[1:], False]
    n_left = np.array([s[0] for s in sides])
    n_right = np.array([s[1] for s in sides])
    at = np.arange(shape.width)
    return out & (at >= shape.side - n_left[:, None]) & (at <= n_right[:, None])


def _spans_of(flags: np.ndarray) -> list[tuple[int, int, int]]:
    """Row, first and last place of each run of set flags."""
    padded = np.zeros((len(flags), flags.shape[1] + 2), dtype=np.int8)
    padded[:, 1:-1] = flags
    step = np.diff(padded, axis=1)
    row, first = np.nonzero(step == 1)
    return list(zip(row.tolist(), first.tolist(), (np.nonzero(step == -1)[1] - 1).tolist()))


def _repeated_rows(batches: Iterator[pa.RecordBatch], shape: Shape = LONG) -> Iterator[pa.RecordBatch]:
    """Runs of repeated starts of every fragment of sorted ``core, sides, kind``."""

    def done(cores: np.ndarray, sides: list[bytes], kinds: np.ndarray) -> pa.RecordBatch:
        group = np.cumsum(np.r_[False, cores[1:] != cores[:-1]])
        found = _spans_of(repeated_starts(group, sides, shape))
        columns = [
            pa.array(kinds[np.array([r for r, _, _ in found], dtype=np.int64)]),
            pa.array([a for _, a, _ in found], pa.int32()),
            pa.array([b for _, _, b in found], pa.int32()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["kind", "first", "last"])

    cores, kinds, sides = np.zeros(0, np.int64), np.zeros(0, np.int64), []
    for batch in batches:
        cores = np.concatenate([cores, batch.column("core").to_numpy()])
        kinds = np.concatenate([kinds, batch.column("kind").to_numpy()])
        sides += batch.column("sides").to_pylist()
        if len(sides) >= BATCH:
            cut = int(np.searchsorted(cores, cores[-1]))
            if cut:
                yield done(cores[:cut], sides[:cut], kinds[:cut])
                cores, sides, kinds = cores[cut:], sides[cut:], kinds[cut:]
    if sides:
        yield done(cores, sides, kinds)


def _length(side: int) -> Column:
    """Bytes of the left (1) or the right (2) side of a fragment."""
    return F.conv(F.hex(F.substring("sides", side, 1)), 16, 10).cast("int")


def _crowded_runs(varied: DataFrame, shape: Shape) -> DataFrame:
    """Repeated starts of fragments whose core has too many for one task. Strings of one core
    that start at the same place are equal if the ``side`` bytes that they add to it are, so
    counts by place and bytes give what the columns would, for any number of fragments."""
    places = varied.select("core", "sides", "kind", _length(1).alias("left"), _length(2).alias("right"))
    places = places.withColumn("first", F.explode(F.sequence(F.lit(shape.side) - F.col("left"), F.col("right"))))
    added = F.col("sides").substr(F.lit(3 - shape.side) + F.col("first") + F.col("left"), F.lit(shape.side))
    strings = places.select("kind", "first", F.xxhash64("core", "first", added).alias("string"))
    twice = strings.groupBy("string").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("string").alias("twice"))
    found = strings.join(twice, F.col("string") == F.col("twice"))
    return found.select("kind", F.col("first").cast("int").alias("first"), F.col("first").cast("int").alias("last"))


def unique_texts(documents: DataFrame) -> DataFrame:
    """``key, n, text`` of every different text, in buckets of the key."""
    text = words.whole(F.col("text"))
    found = documents.select(F.xxhash64(text).alias("key"), text.alias("text")).groupBy("key").agg(
        F.count("*").alias("n"), F.first("text").alias("text")
    )
    return save_bucketed(found, "unique_texts", "key")


def repeated(texts: DataFrame, shape: Shape = LONG) -> DataFrame:
    """``key, spans`` (starts and ends of repeated strings) of texts with any."""
    listed = texts.select("key", "text").mapInArrow(partial(_anchor_rows, shape=shape), "key long, at int, gram long, around long")
    listed = materialize(listed, "anchors")
    grams = listed.groupBy("gram").agg(F.count("*").alias("n"), F.min("around").alias("low"), F.max("around").alias("high"))
    grams = grams.filter("n > 1").select(F.col("gram").alias("twice"), (F.col("low") != F.col("high")).alias("mixed"))
    # written first: a join of two shuffles is what Spark can split where one gram has many places
    grams = materialize(grams, "grams")
    hits = materialize(listed.join(grams, F.col("gram") == F.col("twice")).select("key", "at", "mixed"), "hits")
    discard(listed, grams)
    mixed = hits.filter("mixed").groupBy("key").agg(F.collect_list("at").alias("places")).withColumnRenamed("key", "own")
    fragments = texts.join(mixed, F.col("key") == F.col("own")).select("key", "text", "places")
    schema = "core long, sides binary, kind long, key long, base int"
    rows = materialize(fragments.mapInArrow(partial(_fragment_rows, shape=shape), schema), "fragments")
    kinds = materialize(rows.groupBy("core", "sides", "kind").agg(F.count("*").alias("members")), "kinds")
    cores = kinds.groupBy("core").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("core").alias("shared"), "n")
    cores = materialize(cores, "cores")
    of = lambda some: kinds.join(some, F.col("core") == F.col("shared")).select("core", "sides", "kind")
    varied, crowded = of(cores.filter(F.col("n") <= BATCH)), cores.filter(F.col("n") > BATCH)
    dealt = varied.repartition("core").sortWithinPartitions("core")
    runs = dealt.mapInArrow(_repeated_rows if shape == LONG else partial(_repeated_rows, shape=shape), "kind long, first int, last int")
    if not crowded.isEmpty():
        runs = runs.unionByName(_crowded_runs(of(crowded), shape))
    whole = kinds.filter("members > 1").select("kind", (F.lit(shape.side) - _length(1)).alias("first"), _length(2).alias("last"))
    runs = runs.unionByName(whole).select(F.col("kind").alias("found"), "first", "last")
    some = rows.select("kind", "key", "base").join(runs, F.col("kind") == F.col("found"))
    some = some.select("key", (F.col("base") + F.col("first")).alias("start"), (F.col("base") + F.col("last") + shape.length).alias("end"))
    alike = hits.filter(~F.col("mixed")).select("key", (F.col("at") - (shape.starts - 1)).alias("start"), (F.col("at") + shape.length).alias("end"))
    every = some.unionByName(alike).groupBy("key").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    spans = materialize(every, "spans")
    discard(hits, rows, kinds, cores)
    return spans


def merged(spans, n: int) -> list[tuple[int, int]]:
    """Maximal removed runs inside a text of ``n`` bytes."""
    out: list[tuple[int, int]] = []
    for start, end in sorted((max(0, a), min(n, b)) for a, b in spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _cut_rows(batches: Iterator[pa.RecordBatch], shape: Shape) -> Iterator[pa.RecordBatch]:
    release()
    for batch in batches:
        out = []
        for key, n, text, spans in zip(*(batch.column(c).to_pylist() for c in ("key", "n", "text", "spans"))):
            raw = text.encode() if text else b""
            size = len(raw)
            if n > 1 and size >= shape.length:
                runs = [(0, size)]
            else:
                runs = merged([(s["start"], s["end"]) for s in spans or ()], size)
            kept, at = [], 0
            for start, end in runs:
                kept.append(raw[at:start])
                at = end
            kept.append(raw[at:])
            rest = b"".join(kept)
            out.append((key, size, size - len(rest), len(runs), hashlib.sha256(rest).hexdigest(), rest.decode(errors="ignore")))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        names = ["key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names)


def _cut_texts(documents: DataFrame, shape: Shape) -> DataFrame:
    texts = unique_texts(documents)
    found = repeated(texts, shape).withColumnRenamed("key", "own")
    joined = texts.join(found, F.col("key") == F.col("own"), "left").select("key", "n", "text", "spans")
    schema = "key long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string"
    return joined.mapInArrow(partial(_cut_rows, shape=shape), schema)


def _key() -> Column:
    return F.xxhash64(words.whole(F.col("text")))


def spans(documents: DataFrame, shape: Shape = LONG) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every document."""
    cut = _cut_texts(documents, shape).drop("kept").withColumnRenamed("key", "own")
    rows = documents.select("doc_id", _key().alias("key")).join(cut, F.col("key") == F.col("own"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def cut(documents: DataFrame, shape: Shape = LONG) -> DataFrame:
    """The documents with what is left of their texts (characters cut in two go whole);
    those of which nothing is left are dropped. ``n_chars``, if there, is counted anew."""
    inner, outer = words.carried(documents, "text", "n_chars")
    kept = _cut_texts(inner, shape).filter("kept != ''").select(F.col("key").alias("own"), F.col("kept").alias("text"))
    rows = inner.withColumn("key", _key()).drop("text").join(kept, F.col("key") == F.col("own"))
    counted = {"n_chars": F.length("text").cast("long")} if "n_chars" in documents.columns else {}
    return outer(rows.withColumns(counted))

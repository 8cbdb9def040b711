"""Language-model scores by deleted interpolation of n-grams.

The probability of a token after another mixes three estimates: that of the pair, that of
the token, and a uniform one for all known tokens and one unknown. The mixture weights
depend on how often the context was seen (buckets of powers of two) and are learnt by
expectation-maximisation on held-out counts: each training token is predicted from the
counts without itself.

1. Documents are packed into blocks of tokens (numpy arrays in one row), written once.
2. Each block asks for the counts of its different tokens and pairs, in sorted lists cut
   by ranges of the hash. A range adds up what all blocks have and answers each with the
   totals; a frequent token is one number in a block's list, so no key is hot.
3. Answers meet their block again; every token gets its counts, written once.
4. A histogram of (bucket, ratios of the estimates in eighths of a power of two) gives
   the weights; it is all that goes to the driver and does not grow with the texts but
   with the logarithm of their counts.
5. Documents are scored from their blocks.

Blocks hold ``BLOCK`` tokens and one document more; ranges about ``RANGE`` different keys. Tokens and pairs
are told apart by 64-bit hashes.

Defined results: a null or empty text is its end token alone; a null doc_id is scored but
not learnt from, its held_out is false; equal rows count as often as they occur; without
training documents every score is 0; texts are whole; other columns are not read; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spark_climbs.materialize import materialize

BLOCK, RANGE, MIN_RANGES = 1_000_000, 1_000_000, 64
FOLDS, HELD_OUT = 10, 0
ADDED = 0.1
ROUNDS, BUCKETS, STEPS = 60, 40, 8
#: Ratio of an estimate that is zero.
NONE = -10_000
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)

BLOCK_SCHEMA = "block long, kind int, part int, n long, doc_ids array<long>, train array<boolean>, sizes array<long>, a binary, b binary"


def pack(values: np.ndarray) -> bytes:
    """Integers as compressed byte planes."""
    return pa.compress(np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T.tobytes(), codec="zstd", asbytes=True)


def unpack(data: bytes, n: int, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = pa.decompress(data, decompressed_size=n * size, codec="zstd", asbytes=True) if n else b""
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, n).T).view(kind).reshape(-1)


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(unpack(data, n, "<u8"), dtype=np.uint64)


def _token_keys(tokens: list[bytes]) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh64_intdigest(t) for t in tokens], dtype=np.uint64)


#: No token has a space, so this one is the end's.
END = b" end"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    first = TaskContext.get().partitionId() << 32
    made, docs, train, sizes, known, parts = 0, [], [], [], {END: 0}, []

    def block() -> pa.RecordBatch:
        keys = _token_keys(list(known))
        order = np.argsort(keys)
        place = np.empty(len(order), dtype=np.uint32)
        place[order] = np.arange(len(order), dtype=np.uint32)
        ids = place[np.concatenate(parts)]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([first + made], pa.int64()),
                pa.array([-1], pa.int32()),
                pa.array([0], pa.int32()),
                pa.array([len(keys)], pa.int64()),
                pa.array([docs], pa.list_(pa.int64())),
                pa.array([train], pa.list_(pa.bool_())),
                pa.array([sizes], pa.list_(pa.int64())),
                pa.array([pack_sorted(keys[order])], pa.binary()),
                pa.array([pack(ids)], pa.binary()),
            ],
            ["block", "kind", "part", "n", "doc_ids", "train", "sizes", "a", "b"],
        )

    total = 0
    for batch in batches:
        for doc, learn, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "train", "text"))):
            tokens = text.encode().lower().split() if text else []
            own = [known.setdefault(t, len(known)) for t in tokens]
            own.append(0)
            parts.append(np.array(own, dtype=np.int64))
            docs.append(doc)
            train.append(learn)
            sizes.append(len(own))
            total += len(own)
            if total >= BLOCK:
                yield block()
                made, docs, train, sizes, known, parts, total = made + 1, [], [], [], {END: 0}, [], 0
    if docs:
        yield block()


class Block:
    """Arrays of a block's row: the tokens' places in its sorted keys, the keys of pairs."""

    def __init__(self, row: dict):
        self.sizes = np.array(row["sizes"], dtype=np.int64)
        self.keys = unpack_sorted(row["a"], row["n"])
        self.ids = unpack(row["b"], int(self.sizes.sum()), "<u4").astype(np.int32)
        self.learn = np.repeat(np.array(row["train"], dtype=bool), self.sizes)
        # each document's first token follows the end of another
        ends = np.cumsum(self.sizes) - 1
        self.before = np.empty_like(self.ids)
        self.before[1:] = self.ids[:-1]
        self.before[ends - self.sizes + 1] = self.ids[ends]
        a, b = self.keys[self.before], self.keys[self.ids]
        mixed = (a * _A + (b << np.uint64(31) | b >> np.uint64(33))) * _B
        self.pair_keys, self.pairs = np.unique(mixed ^ (mixed >> np.uint64(32)), return_inverse=True)

    def lists(self):
        """Kind, sorted keys and training counts of tokens and of pairs."""
        yield 0, self.keys, np.bincount(self.ids[self.learn], minlength=len(self.keys))
        yield 1, self.pair_keys, np.bincount(self.pairs[self.learn], minlength=len(self.pair_keys))


def _cuts(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each of ``parts`` equal ranges of hashes begins in sorted keys."""
    bounds = [(p << 64) // parts for p in range(1, parts)]
    return np.r_[0, np.searchsorted(keys, np.array(bounds, dtype=np.uint64)), len(keys)]


def _asked(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                for kind, keys, counts in Block(row).lists():
                    at = _cuts(keys, parts)
                    out = [(p, a, b) for p, (a, b) in enumerate(zip(at, at[1:])) if b > a]
                    columns = [
                        pa.array([p for p, _, _ in out], pa.int32()),
                        pa.array([row["block"]] * len(out), pa.int64()),
                        pa.array([kind] * len(out), pa.int32()),
                        pa.array([b - a for _, a, b in out], pa.int64()),
                        pa.array([pack_sorted(keys[a:b]) for _, a, b in out], pa.binary()),
                        pa.array([pack(counts[a:b].astype("<u4")) for _, a, b in out], pa.binary()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, ["part", "block", "kind", "n", "keys", "counts"])

    return run


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Totals for each list of a range, in its order; and (block -1) how many tokens occur."""

    def answers(part: int, kind: int, rows: list) -> pa.RecordBatch:
        keys = np.concatenate([unpack_sorted(k, n) for _, n, k, _ in rows])
        counts = np.concatenate([unpack(c, n, "<u4") for _, n, _, c in rows]).astype(np.float64)
        different, place = np.unique(keys, return_inverse=True)
        # sums of counts stay exact below 2**53
        totals = np.bincount(place, weights=counts, minlength=len(different)).astype("<u8")
        mine = totals[place]
        at = np.cumsum([n for _, n, _, _ in rows])[:-1]
        lists = [pack(x) for x in np.split(mine, at)]
        blocks, sizes = [r[0] for r in rows], [r[1] for r in rows]
        if kind == 0:
            blocks, sizes, lists = [*blocks, -1], [*sizes, int((totals > 0).sum())], [*lists, b""]
        columns = [
            pa.array(blocks, pa.int64()),
            pa.array([kind] * len(blocks), pa.int32()),
            pa.array([part] * len(blocks), pa.int32()),
            pa.array(sizes, pa.int64()),
            pa.array(lists, pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["block", "kind", "part", "n", "a"])

    now, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            place = (row["part"], row["kind"])
            if place != now:
                if held:
                    yield answers(*now, held)
                now, held = place, []
            held.append((row["block"], row["n"], row["keys"], row["counts"]))
    if held:
        yield answers(*now, held)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with the counts of each token, its context and their pair."""

    def done(row: dict, answers: list) -> pa.RecordBatch:
        block = Block(row)
        of = [np.concatenate([unpack(a, n, "<u8") for k, n, a in answers if k == kind]) for kind in (0, 1)]
        token, context, pair = of[0][block.ids], of[0][block.before], of[1][block.pairs]
        packed = [pack(x.astype("<u8")) for x in (token, context, pair)]
        columns = [pa.array([row[c]], t) for c, t in (("doc_ids", pa.list_(pa.int64())), ("train", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int64())))]
        columns += [pa.array([p], pa.binary()) for p in packed]
        return pa.RecordBatch.from_arrays(columns, ["doc_ids", "train", "sizes", "token", "context", "pair"])

    row, answers = None, []
    for batch in batches:
        for one in batch.to_pylist():
            if one["kind"] < 0:
                if row is not None:
                    yield done(row, answers)
                row, answers = one, []
            else:
                answers.append((one["kind"], one["n"], one["a"]))
    if row is not None:
        yield done(row, answers)


class Counts:
    """Arrays of a counted block."""

    def __init__(self, row: dict):
        self.sizes = np.array(row["sizes"], dtype=np.int64)
        n = int(self.sizes.sum())
        self.token, self.context, self.pair = (unpack(row[c], n, "<u8").astype(np.float64) for c in ("token", "context", "pair"))
        self.learn = np.repeat(np.array(row["train"], dtype=bool), self.sizes)


def buckets(context: np.ndarray) -> np.ndarray:
    """0 for an unseen context, then one bucket for each power of two."""
    return np.minimum(np.frexp(context)[1], BUCKETS - 1)


def estimates(token, context, pair, n: float, v: float) -> tuple[np.ndarray, np.ndarray, float]:
    with np.errstate(divide="ignore", invalid="ignore"):
        of_pair = np.where(context > 0, pair / np.maximum(context, 1), 0.0)
    return of_pair, token / max(n, 1.0), 1.0 / (v + 1.0)


def _histogram(n: float, v: float):
    """Training tokens by bucket and ratios, each predicted without itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                c = Counts(row)
                token, context, pair = (x[c.learn] - 1 for x in (c.token, c.context, c.pair))
                of_pair, of_token, uniform = estimates(token, context, pair, n - 1, v)
                with np.errstate(divide="ignore"):
                    ratios = [np.where(x > 0, np.rint(STEPS * np.log2(np.maximum(x, 1e-300) / uniform)), NONE) for x in (of_pair, of_token)]
                key = (buckets(context).astype(np.int64) << 40) + ((ratios[0].astype(np.int64) + 20_000) << 20) + ratios[1].astype(np.int64) + 20_000
                kinds, counts = np.unique(key, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(counts.astype(np.int64))], ["kind", "n"])

    return run


def learn_weights(kinds: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Weights (pair, token, uniform) of every bucket by expectation-maximisation."""
    bucket = kinds >> 40
    ratio = lambda x: np.where(x == NONE, 0.0, np.exp2(np.where(x == NONE, 0, x) / STEPS))
    parts = np.stack([ratio((kinds >> 20 & 0xFFFFF) - 20_000), ratio((kinds & 0xFFFFF) - 20_000), np.ones(len(kinds))])
    weights = np.tile(np.array([0.3, 0.6, 0.1]), (BUCKETS, 1))
    weights[0] = (0.0, 0.9, 0.1)
    for _ in range(ROUNDS):
        share = parts * weights[bucket].T
        share *= counts / np.maximum(share.sum(axis=0), 1e-300)
        sums = np.stack([np.bincount(bucket, s, minlength=BUCKETS) for s in share], axis=1).astype(float)
        # a part of one token for the uniform estimate: nothing is impossible
        sums[:, 2] += 1e-3
        seen = np.bincount(bucket, counts, minlength=BUCKETS) > 0
        weights[seen] = sums[seen] / sums[seen].sum(axis=1, keepdims=True)
    for b in range(1, BUCKETS):
        if not (bucket == b).any():
            weights[b] = weights[b - 1] if b > 1 or (bucket == 0).any() else weights[b]
    return weights


def _scored(n: float, v: float, weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                c = Counts(row)
                at = np.cumsum(c.sizes) - c.sizes
                of_pair, of_token, uniform = estimates(c.token, c.context, c.pair, n, v)
                w = weights[buckets(c.context)]
                p = w[:, 0] * of_pair + w[:, 1] * of_token + w[:, 2] * uniform
                base = np.log10((c.token + ADDED) / (n + ADDED * (v + 1)))
                columns = [
                    pa.array(row["doc_ids"], pa.int64()),
                    pa.array(c.sizes),
                    pa.array(np.add.reduceat((c.token > 0).astype(np.int64), at)),
                    pa.array(np.full(len(at), int(n), dtype=np.int64)),
                    pa.array(np.add.reduceat(base, at)),
                    pa.array(np.add.reduceat(np.log10(p), at)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def score(documents: DataFrame) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every
    document."""
    rest = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS
    rows = documents.select(F.col("doc_id").cast("long"), F.coalesce(rest != HELD_OUT, F.lit(False)).alias("train"), "text")
    blocks = materialize(rows.mapInArrow(_blocks, BLOCK_SCHEMA), "lm_blocks")
    size = F.aggregate(F.zip_with("sizes", "train", lambda s, t: F.when(t, s).otherwise(0)), F.lit(0).cast("long"), lambda a, x: a + x)
    whole = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)
    totals = blocks.agg(F.sum(size).alias("n"), F.sum(whole).alias("all")).first()
    n, parts = float(totals["n"] or 0), max(MIN_RANGES, int(totals["all"] or 0) // RANGE)
    asked = blocks.mapInArrow(_asked(parts), "part int, block long, kind int, n long, keys binary, counts binary")
    dealt = asked.repartition("part").sortWithinPartitions("part", "kind")
    answers = materialize(dealt.mapInArrow(_answered, "block long, kind int, part int, n long, a binary"), "lm_answers")
    v = float(answers.filter("block = -1").agg(F.sum("n")).first()[0] or 0)
    both = blocks.unionByName(answers.filter("block >= 0"), allowMissingColumns=True)
    met = both.repartition("block").sortWithinPartitions("block", "kind", "part")
    schema = "doc_ids array<long>, train array<boolean>, sizes array<long>, token binary, context binary, pair binary"
    counts = materialize(met.mapInArrow(_counted, schema), "lm_counts")
    kinds = counts.mapInArrow(_histogram(n, v), "kind long, n long").groupBy("kind").agg(F.sum("n").alias("n")).toPandas()
    weights = learn_weights(kinds["kind"].to_numpy(dtype=np.int64), kinds["n"].to_numpy(dtype=np.float64))
    if not n:
        weights[:] = (0.0, 0.0, 1.0)
    schema = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    scored = counts.mapInArrow(_scored(n, v, weights), schema)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")

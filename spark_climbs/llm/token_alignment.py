"""Alignment of two tokenizers' tokens over the same bytes.

Texts are taken in chunks; a chunk's tokens are two tables of (document, first byte, place). An as-of
merge by document finds for every token's first byte the token of the other side that
covers it. Any two tokens that overlap meet so in one direction or both: the union of
both directions, those that start together once, is all overlaps. Bytes where both sides
end a token cut the tokens into groups.

Counts over the corpus: tasks put chunks together to blocks of ``BLOCK`` bytes of text. A block keeps each
link as a number among its different id pairs, written once, in a table bucketed by block. Blocks ask for the
corpus-wide counts of their pairs, a row for each different pair of a block: counts are summed by pair, joined to
the rows that ask, and return as one row to each block, so links never travel. A pair that is in every block is
as many rows as there are blocks.

Defined results: texts that are null or empty, or whose tokens of either side do not spell a space and the text,
have no tokens, groups and links; special tokens' strings are plain text; equal counts of pairs
are all highest; rows are independent, so repeated rows and null or equal ids need nothing; other
columns are not read; texts are whole, a chunk of
``bpe_lexicon.CHUNK`` bytes or one text at a time; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spark_climbs.llm.bpe_lexicon import chunks, ids_of, tokenizer
from spark_climbs.llm.byte_bpe import spread
from spark_climbs.llm.kept import kept
from spark_climbs.materialize import materialize, save_bucketed

#: Bytes of text that ask for counts together, at least (a chunk of ``bpe_lexicon`` more at most).
BLOCK = 8 << 20
SPACE = "▁"


class PieceSide:
    """A SentencePiece model and the bytes of its pieces."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.model.get_piece_size()
        own = [self._bytes(k) for k in range(self.size)]
        self.sizes = np.array([len(b) for b in own], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(own), dtype=np.uint8)

    def _bytes(self, k: int) -> bytes:
        piece = self.model.id_to_piece(k)
        return bytes([int(piece[3:-1], 16)]) if self.model.is_byte(k) else piece.replace(SPACE, " ").encode()

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts in turn, and how many each has."""
        found = self.model.encode(texts, num_threads=1)
        counts = np.array([len(f) for f in found], dtype=np.int64)
        return np.fromiter(chain.from_iterable(found), dtype=np.int64, count=int(counts.sum())), counts


def _piece_side(path: str) -> PieceSide:
    return kept(("piece_side", path), lambda: PieceSide(path))


class Aligned:
    """Tokens of both sides of some documents: ids, and their documents, first bytes and
    groups; the links as places of both sides' tokens."""

    def __init__(self, a_ids, a_counts, a_sizes, b_ids, b_counts, b_sizes):
        documents = np.arange(len(a_counts))
        self.a_ids, self.b_ids, self.n_a, self.n_b = a_ids, b_ids, a_counts, b_counts
        a_ends, b_ends = np.cumsum(a_sizes), np.cumsum(b_sizes)
        a_start, b_start = a_ends - a_sizes, b_ends - b_sizes
        self.a_doc, self.b_doc = np.repeat(documents, a_counts), np.repeat(documents, b_counts)
        a = pd.DataFrame({"doc": self.a_doc, "start": a_start, "a": np.arange(len(a_ids))})
        b = pd.DataFrame({"doc": self.b_doc, "start": b_start, "b": np.arange(len(b_ids))})
        over_a = pd.merge_asof(a, b, on="start", by="doc")["b"].to_numpy(dtype=np.int64)
        over_b = pd.merge_asof(b, a, on="start", by="doc")["a"].to_numpy(dtype=np.int64)
        later = a_start[over_b] != b_start
        self.links_a = np.concatenate([np.arange(len(a_ids)), over_b[later]])
        self.links_b = np.concatenate([over_a, np.flatnonzero(later)])
        #: links from the first tokens' side come first, in order; then those from the other's
        self.n_later = np.bincount(self.b_doc[later], minlength=len(documents))
        self.ends = a_ends[np.isin(a_ends, b_ends, assume_unique=True)]
        self.a_group, self.b_group = np.searchsorted(self.ends, a_ends), np.searchsorted(self.ends, b_ends)
        last = np.cumsum(a_counts)
        self.n_groups = np.diff(np.r_[0, np.where(last > 0, self.a_group[np.maximum(last - 1, 0)] + 1, 0)]) if len(a_ids) else np.zeros(len(documents), np.int64)

    def spelt(self) -> list[bytes]:
        """The groups of every document as ``a1,a2|b1;a3|b2,b3``."""
        n_a, n_b, groups = len(self.a_ids), len(self.b_ids), len(self.ends)
        in_a, in_b = np.bincount(self.a_group, minlength=groups), np.bincount(self.b_group, minlength=groups)
        upto_a, upto_b = np.cumsum(in_a), np.cumsum(in_b)
        ids = np.empty(n_a + n_b, dtype=np.int64)
        mark = np.full(n_a + n_b, ord(","), dtype=np.uint8)
        ids[np.arange(n_a) + (upto_b - in_b)[self.a_group]] = self.a_ids
        ids[np.arange(n_b) + upto_a[self.b_group]] = self.b_ids
        mark[upto_a + upto_b - in_b - 1] = ord("|")
        mark[upto_a + upto_b - 1] = ord(";")
        digits, starts, sizes = _decimals(int(ids.max(initial=0)) + 1)
        lengths = sizes[ids] + 1
        text = digits[spread(starts[ids], lengths)]
        ends = np.cumsum(lengths)
        text[ends - 1] = mark
        raw = text.tobytes()
        upto = np.r_[0, ends][np.r_[0, np.cumsum(self.n_a + self.n_b)]]
        return [raw[x : max(x, y - 1)] for x, y in zip(upto[:-1].tolist(), upto[1:].tolist())]


def _decimals(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers under ``n`` (at least 2 ** 16) as decimals, a place for a mark after each."""
    n = max(n, 1 << 16)

    def make():
        own = [f"{k},".encode() for k in range(n)]
        sizes = np.array([len(x) - 1 for x in own], dtype=np.int64)
        return np.frombuffer(b"".join(own), dtype=np.uint8), np.cumsum(sizes + 1) - sizes - 1, sizes

    return kept(("decimals", n), make)


def align(texts: list[str | None], bpe, pieces: PieceSide) -> tuple[np.ndarray, Aligned]:
    """Which texts have tokens, and the tokens of all (none for the others)."""
    raws = [b" " + t.encode() if t else b"" for t in texts]
    sizes = np.array([len(r) for r in raws], dtype=np.int64)
    data = np.frombuffer(b"".join(raws), dtype=np.uint8)
    a_ids, upto = ids_of(bpe, None, data, np.cumsum(sizes), special=False)
    a_counts = np.diff(np.r_[0, upto])
    b_ids, b_counts = pieces.ids([t or "" for t in texts])
    good = sizes > 0
    for ids, counts, lengths, starts, content in (
        (a_ids, a_counts, bpe.token_sizes, bpe.token_starts, bpe.token_data),
        (b_ids, b_counts, pieces.sizes, pieces.starts, pieces.data),
    ):
        spelt = content[spread(starts[ids], lengths[ids])].tobytes()
        ends = np.r_[0, np.cumsum(lengths[ids])][np.cumsum(counts)].tolist()
        good &= np.fromiter((spelt[x:y] == r for x, y, r in zip([0, *ends], ends, raws)), dtype=bool, count=len(raws))
    if not good.all():
        a_ids, b_ids = a_ids[np.repeat(good, a_counts)], b_ids[np.repeat(good, b_counts)]
        a_counts, b_counts = a_counts * good, b_counts * good
    return good, Aligned(a_ids, a_counts, bpe.token_sizes[a_ids], b_ids, b_counts, pieces.sizes[b_ids])


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers as 32 bits, in planes of bytes and compressed."""
    import zstandard

    planes = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpacked(raw: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), dtype=np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


_OF_DOCUMENTS = ("n_a", "n_b", "n_groups", "n_later")


def _blocks(a_path: str, b_path: str, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bpe, pieces = tokenizer(a_path), _piece_side(b_path)
        first, made = TaskContext.get().partitionId() << 32, 0
        told = {c: [] for c in ("doc_id", *_OF_DOCUMENTS, "groups_sha256")}
        codes, later, size = [], [], 0

        def block() -> pa.RecordBatch:
            pairs, number, counts = np.unique(np.concatenate([*codes, *later, np.zeros(0, np.int64)]), return_inverse=True, return_counts=True)
            # the frequent ones first: small numbers
            order = np.argsort(-counts, kind="stable")
            rank = np.empty(len(order), dtype=np.int64)
            rank[order] = np.arange(len(order))
            columns = {
                "block": pa.array([first + made], pa.int64()),
                "doc_id": pa.array([told["doc_id"]], pa.list_(id_type)),
                **{c: pa.array([np.concatenate(told[c])], pa.list_(pa.int64())) for c in _OF_DOCUMENTS},
                "groups_sha256": pa.array([told["groups_sha256"]], pa.list_(pa.string())),
                "links": pa.array([_packed(rank[number])], pa.binary()),
                "pairs": pa.array([pairs[order]], pa.list_(pa.int64())),
                "counts": pa.array([counts[order]], pa.list_(pa.int64())),
            }
            return pa.RecordBatch.from_pydict(columns)

        for batch in batches:
            for row, to, data, _ in chunks(batch.column("text")):
                part = batch.slice(row, to - row)
                good, of = align(part.column("text").to_pylist(), bpe, pieces)
                told["doc_id"] += part.column("doc_id").to_pylist()
                for c in _OF_DOCUMENTS:
                    told[c].append(getattr(of, c))
                told["groups_sha256"] += [hashlib.sha256(s).hexdigest() if g else "" for s, g in zip(of.spelt(), good.tolist())]
                code = of.a_ids[of.links_a] * pieces.size + of.b_ids[of.links_b]
                codes.append(code[: len(of.a_ids)])
                later.append(code[len(of.a_ids) :])
                size += len(data)
                if size >= BLOCK:
                    yield block()
                    made += 1
                    told, codes, later, size = {c: [] for c in told}, [], [], 0
        if told["doc_id"]:
            yield block()

    return run


def _answer(table: pa.Table) -> pa.Table:
    """The counts that a block asked for, in its own numbering."""
    at = table.column("number").to_numpy()
    n, best = np.empty(len(at), dtype="<i8"), np.empty(len(at), dtype=np.uint8)
    n[at], best[at] = table.column("n").to_numpy(), table.column("best").to_numpy()
    columns = {"asked": table.column("block")[:1], "n": pa.array([n.tobytes()], pa.binary()), "best": pa.array([best.tobytes()], pa.binary())}
    return pa.table(columns)


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return np.diff(np.r_[0, np.cumsum(values)][np.r_[0, np.cumsum(counts)]])


def _totals(id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                of = {c: batch.column(c)[k] for c in batch.schema.names}
                n_a, n_b, n_groups, n_later = (of[c].values.to_numpy() for c in _OF_DOCUMENTS)
                links = _unpacked(of["links"].as_py())
                n_best, count_sum = np.zeros(len(n_a), np.int64), np.zeros(len(n_a), np.int64)
                if len(links):
                    best, n = np.frombuffer(of["best"].as_py(), np.uint8), np.frombuffer(of["n"].as_py(), "<i8")
                    early, late = links[: n_a.sum()], links[n_a.sum() :]
                    for own, counts in ((early, n_a), (late, n_later)):
                        n_best += _sums(best[own].astype(np.int64), counts)
                        count_sum += _sums(n[own], counts)
                columns = {"doc_id": of["doc_id"].values.cast(id_type), "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_a + n_later, "n_best": n_best, "count_sum": count_sum}
                yield pa.RecordBatch.from_pydict({**columns, "groups_sha256": of["groups_sha256"].values})

    return run


def digests(documents: DataFrame, bpe: str, pieces: str) -> DataFrame:
    """Of every document: tokens of both sides, groups, links, links whose pair is the most frequent of its
    second id, the sum of the pairs' counts over the links, and the SHA-256 of the groups."""
    from pyspark.sql.pandas.types import to_arrow_type

    id_field = documents.schema["doc_id"].dataType
    id_type, id_name = to_arrow_type(id_field), id_field.simpleString()
    lists = ", ".join(f"{c} array<long>" for c in _OF_DOCUMENTS)
    schema = f"block long, doc_id array<{id_name}>, {lists}, groups_sha256 array<string>, links binary, pairs array<long>, counts array<long>"
    made = documents.select("doc_id", "text").mapInArrow(_blocks(bpe, pieces, id_type), schema)
    blocks = save_bucketed(made, "aligned_blocks", "block")
    parts = blocks.select(F.explode(F.arrays_zip("pairs", "counts")).alias("of")).select(F.col("of.pairs").alias("pair"), F.col("of.counts").alias("own"))
    counts = parts.groupBy("pair").agg(F.sum("own").alias("n"))
    # at most one row for each first id and second id
    second = Window.partitionBy(F.col("pair") % _piece_side(pieces).size)
    counts = materialize(counts.withColumn("best", (F.col("n") == F.max("n").over(second)).cast("byte")), "pair_counts")
    asks = blocks.select("block", F.posexplode("pairs").alias("number", "asked_pair"))
    answers = asks.join(counts, F.col("asked_pair") == F.col("pair")).select("block", "number", "n", "best")
    answers = answers.groupBy("block").applyInArrow(_answer, "asked long, n binary, best binary")
    joined = blocks.drop("pairs", "counts").join(answers, F.col("block") == F.col("asked"), "left").drop("asked")
    schema = f"doc_id {id_name}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return joined.mapInArrow(_totals(id_type), schema)


def _alignments(a_path: str, b_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, pieces = tokenizer(a_path), _piece_side(b_path)
        for batch in batches:
            for row, to, _, _ in chunks(batch.column("text")):
                part = batch.slice(row, to - row)
                of = align(part.column("text").to_pylist(), bpe, pieces)[1]
                doc = of.a_doc[of.links_a]
                order = np.lexsort([of.links_b, of.links_a])
                before_a, before_b, before = np.cumsum(of.n_a) - of.n_a, np.cumsum(of.n_b) - of.n_b, np.cumsum(of.n_groups) - of.n_groups
                lists = (
                    (of.a_ids, of.n_a),
                    (of.b_ids, of.n_b),
                    (of.a_group - before[of.a_doc], of.n_a),
                    (of.b_group - before[of.b_doc], of.n_b),
                    ((of.links_a - before_a[doc])[order], of.n_a + of.n_later),
                    ((of.links_b - before_b[doc])[order], of.n_a + of.n_later),
                )
                made = [pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)], pa.int32()), pa.array(v, pa.int32())) for v, n in lists]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], [*part.schema.names, *_LISTS])

    return run


_LISTS = ("a_ids", "b_ids", "a_groups", "b_groups", "a_links", "b_links")


def aligned(documents: DataFrame, bpe: str, pieces: str) -> DataFrame:
    """The documents with both sides' ids, the group of every token, and the links as places in
    ``a_ids`` and ``b_ids`` (columns of the documents with these names are replaced)."""
    of = documents.drop(*_LISTS)
    schema = ", ".join([f"`{c}` {t}" for c, t in of.dtypes] + [f"{c} array<int>" for c in _LISTS])
    return of.mapInArrow(_alignments(bpe, pieces), schema)

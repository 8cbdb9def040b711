"""SentencePiece encoding by n-best search over the piece lattice, and decoding.

The lattice of a text has an edge for every piece that matches at a place, and a byte edge
(the UTF-8 bytes of one character) where no single-character piece does. Forward Viterbi
gives the best score up to every place. Backward A-star search then takes
partial paths from the end in order of their score plus that value, which is exact, so
complete paths come out in order of their score, the best one first.

Texts are cut where no piece can cross (the cuts are checked against the vocabulary when
it is loaded), and the lattice of each stretch is searched by itself; stretches met before
are remembered. The best paths of a text combine those of its stretches: the
second best differs in the stretch with the smallest gap, and so on.

White space is kept as it is: a space is the character U+2581, a text begins with one more,
and that character itself is spelt in bytes, so decoding gives the text back exactly.

Defined results: a null text has null ids, an empty one none; equal scores come in
the order of the search, which is the same for equal texts; rows are independent, so
repeated rows, ties of ids and empty tables need nothing special; columns of the
documents are carried along, a column of theirs named like a result is replaced.
"""

from __future__ import annotations

import heapq
import re
import struct
import zlib
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from spark_climbs.llm.kept import kept

SPACE = "▁"
#: Stretches of each of two generations that a worker remembers.
REMEMBERED = 350_000
#: How much worse than every piece a byte edge is, as in the library.
BYTE_PENALTY = 10.0
#: More than sums of scores differ by rounding.
_ROUNDING = 1e-3
#: Stretches: letters, single digits, runs of other signs, each after its spaces. The
#: second one is for vocabularies with pieces that cross these.
FINE, COARSE = r" *[^\W\d_²³¹]+| *\d| *(?:[^\w \n]|[_²³¹])+| +|\n", r" *[^ ]+| +"


def _packed(ids: tuple[int, ...]) -> bytes:
    return struct.pack(f"<{len(ids)}i", *ids)


class Pieces:
    """Vocabulary and lattice search of a model file."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        plain = [k for k in ids if not (model.is_byte(k) or model.is_control(k) or model.is_unknown(k) or model.is_unused(k))]
        self.surface = {k: model.id_to_piece(k) for k in plain}
        self.shown = {k: p.replace(SPACE, " ") for k, p in self.surface.items()}
        self.byte_ids = {int(model.id_to_piece(k)[3:-1], 16): k for k in ids if model.is_byte(k)}
        self.bytes_of = {k: b for b, k in self.byte_ids.items()}
        self.lattice: dict[str, tuple[float, tuple[int, ...]]] = {}
        #: Pieces (spaces as spaces) by their characters: what ends here, and what goes on.
        self.trie: dict[str, list] = {}
        scores = [model.get_score(k) for k in plain]
        for k, score in zip(plain, scores):
            self.lattice[self.surface[k]] = (score, (k,))
            node = [None, self.trie]
            for c in self.shown[k]:
                if node[1] is None:
                    node[1] = {}
                node = node[1].setdefault(c, [None, None])
            node[0] = self.lattice[self.surface[k]]
        self.byte_score = min((s for s in scores if s > -1e8), default=0.0) - BYTE_PENALTY
        fine = re.compile(FINE, re.S)
        own = [p.replace(SPACE, " ") for p in self.surface.values()]
        whole = all(fine.fullmatch(p) for p in own)
        self.cut = fine if whole else re.compile(COARSE, re.S)
        if not all(self.cut.fullmatch(p) for p in own):
            raise ValueError("pieces with a space after other characters")
        self.young: dict[str, tuple[bytes, float, float]] = {}
        self.old: dict[str, tuple[bytes, float, float]] = {}
        # an ASCII byte is a character by itself; others wait for the rest of theirs
        self.shown |= {k: chr(b) for b, k in self.byte_ids.items() if b < 128}
        self.partial = frozenset(k for b, k in self.byte_ids.items() if b >= 128)
        # by id, nothing for the bytes that wait
        self.shown_at = [None if k in self.partial else self.shown.get(k, "") for k in ids]

    def paths(self, stretch: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The ``n`` best segmentations of a stretch (spaces as spaces)."""
        size = len(stretch)
        best = [float("-inf")] * (size + 1)
        best[0] = 0.0
        into: list[list] = [[] for _ in range(size + 1)]
        trie = self.trie
        for i in range(size):
            here = best[i]
            single = False
            # the character U+2581 itself is in no piece
            kids, j = trie, i
            while kids is not None and j < size:
                node = kids.get(stretch[j])
                if node is None:
                    break
                j += 1
                found, kids = node
                if found is not None:
                    single = single or j == i + 1
                    into[j].append((i, found))
                    if here + found[0] > best[j]:
                        best[j] = here + found[0]
            if not single:
                spelt = tuple([self.byte_ids[b] for b in stretch[i].encode()])
                into[i + 1].append((i, (self.byte_score, spelt)))
                if here + self.byte_score > best[i + 1]:
                    best[i + 1] = here + self.byte_score
        # Paths that part in a place are different ones, so for two paths all that is worse than the second
        # of a place (by more than sums round) can be left out.
        least, prune = float("-inf"), n <= 2
        heap, met, out = [(-best[size], 0, size, 0.0, None)], 0, []
        while heap and len(out) < n:
            top, _, at, rest, path = heappop(heap)
            if at == 0:
                ids: list[int] = []
                while path is not None:
                    ids.extend(path[0])
                    path = path[1]
                out.append((rest, tuple(ids)))
                continue
            top = -top - _ROUNDING
            for before, (score, own) in into[at]:
                whole = best[before] + score + rest
                if whole < least:
                    continue
                if prune and least + _ROUNDING < whole < top:
                    least = whole - _ROUNDING
                met += 1
                heappush(heap, (-whole, met, before, score + rest, (own, path)))
        return out

    def entry(self, stretch: str) -> tuple[bytes, float, float]:
        """Ids of the best path as bytes, its score and the gap to the second."""
        found = self.old.get(stretch)
        if found is None:
            paths = self.paths(stretch, 2)
            gap = paths[0][0] - paths[1][0] if len(paths) > 1 else float("inf")
            found = (_packed(paths[0][1]), paths[0][0], gap)
        if len(self.young) > REMEMBERED:
            self.young, self.old = {}, self.young
        self.young[stretch] = found
        return found

    def stretches(self, text: str) -> list[str]:
        return self.cut.findall(" " + text) if text else []

    def best(self, text: str) -> tuple[np.ndarray, float, float]:
        """Ids and score of the best path, and the gap to the second (infinite if there is
        only one)."""
        cut = self.stretches(text)
        if not cut:
            return np.zeros(0, dtype="<i4"), 0.0, float("inf")
        found = list(map(self.young.get, cut))
        if None in found:
            found = [f or self.young.get(s) or self.entry(s) for f, s in zip(found, cut)]
        ids, scores, gaps = zip(*found)
        return np.frombuffer(b"".join(ids), dtype="<i4"), sum(scores), min(gaps)

    def n_best(self, text: str, n: int) -> list[tuple[float, list[int]]]:
        """The ``n`` best segmentations of a text with their scores, best first."""
        return [(score, np.frombuffer(ids, dtype="<i4").tolist()) for score, ids in self.n_best_bytes(text, n)]

    def n_best_bytes(self, text: str, n: int) -> list[tuple[float, bytes]]:
        """``n_best`` with the ids as bytes (little-endian, 32 bits).

        Choices of a path in every stretch, by their total loss: a heap of choices, each
        followed by those with one more step in its last changed stretch or a later one.
        Only the stretches with the n - 1 smallest first losses can change."""
        cut = self.stretches(text)
        if not cut:
            return [(0.0, b"")]
        found = list(map(self.young.get, cut))
        if None in found:
            found = [f or self.young.get(s) or self.entry(s) for f, s in zip(found, cut)]
        own, scores, gaps = zip(*found)
        total = sum(scores)
        if n == 2:  # one stretch differs, the first of the smallest gap
            gap = min(gaps)
            if gap == float("inf"):
                return [(total, b"".join(own))]
            k, ids = gaps.index(gap), b"".join(own)
            at = sum(map(len, own[:k]))
            return [(total, ids), (total - gap, ids[:at] + _packed(self.paths(cut[k], 2)[1][1]) + ids[at + len(own[k]) :])]
        can = heapq.nsmallest(max(0, n - 1), ((g, k) for k, g in enumerate(gaps) if g != float("inf")))
        paths = [self.paths(cut[k], n) for _, k in can]
        losses = [[p[0][0] - x[0] for x in p] for p in paths]
        heap, out, seen = [(0.0, (0,) * len(can))], [], {(0,) * len(can)}
        while heap and len(out) < n:
            loss, choice = heapq.heappop(heap)
            ids = list(own)
            for (_, k), p, c in zip(can, paths, choice):
                ids[k] = np.array(p[c][1], dtype="<i4").tobytes()
            out.append((total - loss, b"".join(ids)))
            for k, c in enumerate(choice):
                more = choice[:k] + (c + 1,) + choice[k + 1 :]
                if c + 1 < len(losses[k]) and more not in seen:
                    seen.add(more)
                    heapq.heappush(heap, (loss - losses[k][c] + losses[k][c + 1], more))
        return out

    def decode(self, ids) -> str:
        """The text of the ids: pieces as they are, runs of byte ids as UTF-8."""
        shown = self.shown
        parts = list(map(self.shown_at.__getitem__, ids))
        if None not in parts:
            text = "".join(parts)
            return text[1:] if text.startswith(" ") else text
        out: list[str] = []
        spelt = bytearray()
        for k in ids:
            if k in self.partial:
                spelt.append(self.bytes_of[k])
                continue
            if spelt:
                out.append(spelt.decode(errors="replace"))
                spelt = bytearray()
            out.append(shown.get(k, ""))
        out.append(spelt.decode(errors="replace"))
        text = "".join(out)
        return text[1:] if text.startswith(" ") else text


def load(path: str) -> Pieces:
    return kept(("pieces", path), lambda: Pieces(path))


def _digests(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                if text is None:
                    rows.append((None,) * 6)
                    continue
                (score, ids), *others = model.n_best_bytes(text, 2)
                second, second_ids = others[0] if others else (None, None)
                second_crc = None if second_ids is None else zlib.crc32(second_ids)
                decodes = model.decode(np.frombuffer(ids, dtype="<i4").tolist()) == text
                rows.append((len(ids) // 4, zlib.crc32(ids), score, second, second_crc, decodes))
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.bool_())
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            names = ["n_pieces", "ids_crc32", "score", "second_score", "second_crc32", "decodes"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *names])

    return run


def digests(documents: DataFrame, model: str) -> DataFrame:
    """Of every document: number and crc32 (little-endian 32-bit) of the ids of its best
    segmentation, its score, score and crc32 of the second best one by the n-best search (null where there is
    only one), and whether the ids decode to the text."""
    schema = f"doc_id {dict(documents.dtypes)['doc_id']}, n_pieces long, ids_crc32 long, score double, second_score double, second_crc32 long, decodes boolean"
    return documents.select("doc_id", "text").mapInArrow(_digests(model), schema)


def _encoded(path: str, names: list[str], n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches:
            ids, decoded, others = [], [], []
            for text in batch.column("text").to_pylist():
                if text is None:
                    ids.append(None)
                    decoded.append(None)
                    others.append(None)
                    continue
                own = model.best(text)[0]
                ids.append(own)
                decoded.append(model.decode(own.tolist()))
                others.append([{"score": s, "ids": p} for s, p in model.n_best(text, n)] if n > 1 else None)
            kept = [pa.array(decoded, pa.string()) if c == "text" else batch.column(c) for c in names]
            out = [*kept, pa.array(ids, pa.list_(pa.int32()))]
            columns = [*names, "piece_ids"]
            if n > 1:
                out.append(pa.array(others, pa.list_(pa.struct([("score", pa.float64()), ("ids", pa.list_(pa.int32()))]))))
                columns.append("n_best")
            yield pa.RecordBatch.from_arrays(out, columns)

    return run


def encode(documents: DataFrame, model: str, n: int = 1) -> DataFrame:
    """The documents with ``piece_ids`` and their text decoded from these; with ``n`` over
    one also ``n_best``, the best segmentations with their scores."""
    of = documents.drop("piece_ids", "n_best")
    more = ", n_best array<struct<score: double, ids: array<int>>>" if n > 1 else ""
    schema = ", ".join(f"`{c}` {t}" for c, t in of.dtypes) + f", piece_ids array<int>{more}"
    return of.mapInArrow(_encoded(model, of.columns, n), schema)

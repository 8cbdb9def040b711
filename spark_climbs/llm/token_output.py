"""Token ids of documents as Huffman-coded files, in ascending order of the ids.

Three passes, each written before the next: the documents are tokenized and dealt to
ranges of doc_id, a task for each (sorted inside, with their offset in the range); the ids are coded with
canonical length-limited Huffman codes from the global counts, and the coded blocks go to files in
the order of the ranges; readers decode blocks independently from their checkpoints. Files in the order of
their names, and blocks inside a file, hold the documents in order, one following the other.

The file format is a folder: ``blocks`` has Parquet rows of (first document's place,
doc_ids, starts, sizes, bits, checkpoints), ``codes`` the code length of every id. Each
block is complete with ``codes``; a lost task rewrites its own blocks alone.

What meets on the driver: the range bounds (one for ``RANGE_ROWS`` documents, or for each shuffle partition), and
a count for each id of the vocabulary.

Where the tokenizer's file says that it lower-cases, drops white space and cuts as ``_CUT`` does, many texts are cut
into words together, and a word seen before is not merged again. Texts with a special token's opening
``<|``, and all texts for any other tokenizer, are encoded by the library as they are.

Defined results: a null or empty text has no ids but the end id; a null doc_id sorts
first; equal doc_ids follow the hash of their text; an empty table gives no rows; texts
are whole and a block holds any number of ids up to ``BLOCK`` plus one document.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spark_climbs.llm import byte_bpe, huffman
from spark_climbs.llm.kept import kept
from spark_climbs.materialize import checkpoint_dir, materialize

END = 1
#: Ids after which a block is closed.
BLOCK = 1 << 18
#: Documents in a range at most.
RANGE_ROWS = 50_000
#: Words of each of the two generations whose ids a worker remembers.
REMEMBERED = 300_000


#: The normalizer and the words of the tokenizer whose texts can be cut at white space.
_NORMALIZER = ["NFC", "Replace \\s+", "Lowercase"]
_CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _cuts_at_space(path: str) -> bool:
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    before = (told["pre_tokenizer"] or {}).get("pretokenizers", [{}])
    normal = [" ".join(filter(None, [n["type"], n.get("pattern", {}).get("Regex")])) for n in (told["normalizer"] or {}).get("normalizers", [])]
    words = before[0].get("type") == "Split" and before[0]["pattern"].get("Regex") == _CUT and before[0]["behavior"] == "Removed" and before[0]["invert"]
    rest = all(b["type"] == "ByteLevel" and not b["add_prefix_space"] and not b["use_regex"] for b in before[1:])
    added = all(t["content"].startswith("<|") for t in told["added_tokens"])
    return bool(words and rest and added and normal == _NORMALIZER)


class _Pieces:
    """Ids of whole texts. Chunks of texts are cut into words as arrays; a word that was met before is known by its
    bytes, the others are merged together. Words are remembered in two generations: when the young one is full it
    becomes the old one, and what is used again moves on."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.wide = self.size > 1 << 16
        self.kind = np.dtype("<u4" if self.wide else "<u2")
        self.cut = _cuts_at_space(path)
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        if self.cut:
            with open(path, encoding="utf-8") as f:
                model = json.load(f)["model"]
            vocabulary, letters = model["vocab"], byte_bpe.byte_letters()
            self.inner = np.array([vocabulary[c] for c in letters], dtype=np.int64)
            self.last = np.array([vocabulary[c + model["end_of_word_suffix"]] for c in letters], dtype=np.int64)
            self.pairs = byte_bpe.merges_of(model, self.size)
            self.characters = byte_bpe.Characters(self._classify)

    def _classify(self, c: str) -> int:
        cut = self.tokenizer.pre_tokenizer.pre_tokenize_str
        if not cut(c):
            return byte_bpe.BLANK
        return byte_bpe.LETTER if len(cut("a" + c)) == 1 else byte_bpe.OTHER if len(cut("!" + c)) == 1 else byte_bpe.NUMBER

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.kind)

    def _normal(self, text: str) -> bytes:
        """The text as the tokenizer normalizes it, but for the kind of white space. Latin characters compose no
        further, and each has its own lower case."""
        if text.isascii():
            return text.encode().lower()
        if not _BEYOND_LATIN.search(text):
            return text.lower().encode()
        return self.tokenizer.normalizer.normalize_str(text).encode()

    def _words(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First byte and size of every word: runs of letters or of other signs, single numbers, contractions."""
        points, classes, first = self.characters.of(data)
        n = len(points)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        begin = np.zeros(n + 1, dtype=bool)
        begin[np.searchsorted(first, np.r_[0, ends[ends < len(data)]])] = True
        begin[n] = True
        run = begin[:n] | (classes == byte_bpe.NUMBER)
        run[1:] |= classes[1:] != classes[:-1]
        at = np.flatnonzero(run)
        stop = np.r_[at[1:], n]
        token = np.zeros(n + 1, dtype=bool)
        token[at] = True
        byte_bpe.contractions(points, at, stop, classes[at], begin[stop], np.zeros(len(at), dtype=bool), token)
        heads = np.flatnonzero(token[:n])
        starts = first[heads]
        sizes = np.diff(np.r_[starts, len(data)])
        # a contraction's quote and letters are of different classes, its first is a quote
        some = classes[heads] != byte_bpe.BLANK
        return starts[some], sizes[some]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; texts with a special token's opening are encoded by themselves."""
        alone = {k: self.whole(t) for k, t in enumerate(texts) if t and ("<|" in t or not self.cut)}
        raws = [b"" if not t or k in alone else self._normal(t) for k, t in enumerate(texts)]
        ends = np.cumsum([len(r) for r in raws])
        data = np.frombuffer(b"".join(raws), dtype=np.uint8)
        if not len(data):
            return [alone.get(k, np.zeros(0, self.kind)) for k in range(len(texts))]
        starts, sizes = self._words(data, ends)
        one, own = byte_bpe.distinct(data, starts, sizes)
        known = self._known(data, starts[one], sizes[one])
        lengths = np.array([len(k) for k in known], dtype=np.int64) // self.kind.itemsize
        table = np.frombuffer(b"".join(known), dtype=self.kind)
        counts = lengths[own]
        ids = table[byte_bpe.spread((np.cumsum(lengths) - lengths)[own], counts)]
        upto = np.r_[0, np.cumsum(counts)][np.searchsorted(starts, ends)]
        return [alone.get(k, ids[a:b]) for k, (a, b) in enumerate(zip([0, *upto[:-1].tolist()], upto.tolist()))]

    def _known(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """Packed ids of different words."""
        raw, young, old = data.tobytes(), self.young, self.old
        words = [raw[s : s + n] for s, n in zip(starts.tolist(), sizes.tolist())]
        found = list(map(young.get, words))
        new = []
        for k, f in enumerate(found):
            if f is None:
                found[k] = old.get(words[k])
                if found[k] is None:
                    new.append(k)
                else:
                    young[words[k]] = found[k]
        if new:
            at = np.array(new)
            starts, sizes = starts[at], sizes[at]
            ids = self.inner[data[byte_bpe.spread(starts, sizes)]]
            ends = np.cumsum(sizes) - 1
            ids[ends] = self.last[data[starts + sizes - 1]]
            ids, counts = byte_bpe.merged(self.pairs, self.size, ids, sizes)
            packed, upto = ids.astype(self.kind).tobytes(), (np.cumsum(counts) * self.kind.itemsize).tolist()
            a = 0
            for k, b in zip(new, upto):
                found[k] = young[words[k]] = packed[a:b]
                a = b
        if len(young) > REMEMBERED:
            self.young, self.old = {}, young
        return found


#: Characters that may compose with others, or whose lower case depends on what is around.
_BEYOND_LATIN = re.compile("[^\x00-\u024f]")


def _pieces(path: str) -> _Pieces:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return kept(("tokenizer", path), lambda: _Pieces(path))


def encode(text: str | None, pieces: _Pieces) -> np.ndarray:
    """Ids of a whole text, without the end id."""
    return pieces.encode([text])[0].astype(np.uint32)


#: Texts that are encoded together.
_TOGETHER = 1000


def _tokenized(path: str, bounds: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(path)
        end, size = np.array([END], dtype=pieces.kind).tobytes(), pieces.kind.itemsize
        for whole in batches:
            for at in range(0, whole.num_rows, _TOGETHER):
                batch = whole.slice(at, _TOGETHER)
                rows = [r.tobytes() + end for r in pieces.encode(batch.column("text").to_pylist())]
                ids = batch.column("doc_id")
                place = np.searchsorted(bounds, ids.fill_null(0).to_numpy()).astype(np.int32) + 1
                place[ids.is_null().to_numpy(zero_copy_only=False)] = 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array(place), ids, batch.column("text_key"), pa.array([len(r) // size for r in rows], pa.int64()), pa.array(rows, pa.binary())],
                    ["range", "doc_id", "text_key", "n", "ids"],
                )

    return run


def _offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows with the ids before them in their range."""
    last, total = None, 0
    for batch in batches:
        n = batch.column("n").to_numpy()
        ranges = batch.column("range").to_numpy()
        before = np.empty(len(n), dtype=np.int64)
        for start, end in zip(*_runs(ranges)):
            if ranges[start] != last:
                last, total = ranges[start], 0
            sums = np.cumsum(n[start:end])
            before[start:end] = total + sums - n[start:end]
            total += int(sums[-1])
        yield pa.RecordBatch.from_arrays(
            [batch.column("range"), pa.array(before), batch.column("doc_id"), batch.column("n"), batch.column("ids")],
            ["range", "before", "doc_id", "n", "ids"],
        )


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(values):
        return np.zeros(0, int), np.zeros(0, int)
    cuts = np.flatnonzero(values[1:] != values[:-1]) + 1
    return np.r_[0, cuts], np.r_[cuts, len(values)]


def tokenize(documents: DataFrame, tokenizer: str) -> tuple[DataFrame, int]:
    """``range, before, doc_id, n, ids`` of every document, written in order, and how many ranges there
    are: the null ids, then those up to each bound."""
    rows = documents.select(F.col("doc_id").cast("long"), "text")
    n = rows.count()
    wanted = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // RANGE_ROWS))
    cuts = [k / wanted for k in range(1, wanted)]
    bounds = sorted(set(rows.approxQuantile("doc_id", cuts, 0.1 / wanted))) if cuts and n else []
    n_ranges = len(bounds) + 2
    dealt = rows.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    run = _tokenized(tokenizer, np.array(bounds, dtype=np.int64))
    coded = dealt.mapInArrow(run, "range int, doc_id long, text_key long, n long, ids binary")
    # a range is a task, and files are named in their order
    ordered = coded.repartitionById(n_ranges, F.col("range")).sortWithinPartitions("range", F.col("doc_id").asc_nulls_first(), "text_key")
    return materialize(ordered.mapInArrow(_offsets, "range int, before long, doc_id long, n long, ids binary"), "ids"), n_ranges


def _counted(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            own = np.bincount(np.frombuffer(b"".join(batch.column("ids").to_pylist()), dtype=kind))
            if len(own) > len(total):
                total, own = own, total
            total[: len(own)] += own
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(total[at])], ["id", "n"])

    return run


def _blocks(kind: str, code_lengths: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = huffman.canonical(code_lengths)
        held, size, starts, sizes, docs, place = [], 0, [], [], [], 0

        def block():
            ids = np.frombuffer(b"".join(held), dtype=kind)
            bits, checkpoints = huffman.encode(ids, code_lengths, codes)
            columns = {
                "range": pa.array([place], pa.int32()),
                "first": pa.array([starts[0]], pa.int64()),
                "doc_ids": pa.array([docs], pa.list_(pa.int64())),
                "starts": pa.array([starts], pa.list_(pa.int64())),
                "sizes": pa.array([sizes], pa.list_(pa.int64())),
                "bits": pa.array([bits], pa.binary()),
                "checkpoints": pa.array([checkpoints.astype("<i4").tobytes()], pa.binary()),
            }
            return pa.RecordBatch.from_pydict(columns)

        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("range", "doc_id", "start", "n", "ids")))
            for own, doc, start, n, ids in rows:
                # a block is full, or what is read next does not follow
                if held and (size >= BLOCK or own != place or start != starts[-1] + sizes[-1]):
                    yield block()
                    held, size, starts, sizes, docs = [], 0, [], [], []
                place = own
                held.append(ids)
                size += n
                starts.append(start)
                sizes.append(n)
                docs.append(doc)
        if held:
            yield block()

    return run


BLOCK_SCHEMA = "first long, doc_ids array<long>, starts array<long>, sizes array<long>, bits binary, checkpoints binary"


def write(documents: DataFrame, path: str, tokenizer: str) -> None:
    """Write the files of ``documents`` under ``path``."""
    from tokenizers import Tokenizer

    spark = documents.sparkSession
    size = Tokenizer.from_file(tokenizer).get_vocab_size(with_added_tokens=True)
    kind = "<u4" if size > 1 << 16 else "<u2"
    ids, n_ranges = tokenize(documents, tokenizer)
    totals = ids.groupBy("range").agg(F.sum("n").alias("total"))
    so_far = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("range", F.coalesce(F.sum("total").over(so_far), F.lit(0)).alias("base"))
    counts = np.zeros(size, dtype=np.int64)
    for row in ids.select("ids").mapInArrow(_counted(kind), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[row["id"]] = row["n"]
    code_lengths = huffman.lengths(counts)
    spark.createDataFrame([(bytearray(code_lengths.tobytes()),)], "lengths binary").coalesce(1).write.parquet(f"{path}/codes")
    # two numbers for each range
    placed = ids.join(F.broadcast(bases), "range").select("range", "doc_id", (F.col("base") + F.col("before")).alias("start"), "n", "ids")
    blocks = placed.mapInArrow(_blocks(kind, code_lengths), f"range int, {BLOCK_SCHEMA}")
    in_order = blocks.repartitionById(n_ranges, F.col("range")).sortWithinPartitions("first")
    in_order.drop("range").write.parquet(f"{path}/blocks")


def _decoded(code_lengths: bytes, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = huffman.decoding_table(np.frombuffer(code_lengths, dtype=np.uint8))
        for batch in batches:
            for row in batch.to_pylist():
                ids = huffman.decode(row["bits"], np.frombuffer(row["checkpoints"], dtype="<i4"), sum(row["sizes"]), table)
                ids = ids.astype("<u4")
                ends = np.cumsum(row["sizes"])
                parts = [ids[e - n : e] for e, n in zip(ends, row["sizes"])]
                last = pa.array([zlib.crc32(p) for p in parts], pa.int64()) if digest else pa.array(parts, pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(row["starts"], pa.int64()), pa.array(row["sizes"], pa.int64()), last],
                    ["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"],
                )

    return run


def read(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """Documents of the files: ``doc_id, start, n_tokens`` and their ``ids``, or the crc32
    of them (``digest``)."""
    lengths = bytes(spark.read.schema("lengths binary").parquet(f"{path}/codes").first()[0])
    last = "ids_crc32 long" if digest else "ids array<long>"
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks")
    return blocks.mapInArrow(_decoded(lengths, digest), f"doc_id long, start long, n_tokens long, {last}")


def round_trip(documents: DataFrame, tokenizer: str) -> DataFrame:
    """Write the files to the session's shared folder and read them back."""
    spark = documents.sparkSession
    path = f"{checkpoint_dir(spark)}/token_files/{uuid.uuid4().hex}"
    write(documents, path, tokenizer)
    return read(spark, path, digest=True)

"""Byte-level BPE encoding with a lexicon of frequent words as a minimal acyclic transducer.

1. The words of all texts are counted: in each task per chunk, then summed.
2. The most frequent ones (up to ``LEXICON``, all of a frequency or none) are merged once and compiled, with
   their ids, into a minimal acyclic transducer (``transducer``), one file in the session's
   shared folder. Executors fetch it once, and their workers map it into memory.
3. Each chunk of texts is cut into words; all words walk through the transducer together.
   Those that it does not have are merged exactly, each different one once a chunk (``byte_bpe``).
   The lexicon is thus only a shortcut: any lexicon gives the same ids.

What meets on the driver: the words of the lexicon (``LEXICON`` of ``LONGEST`` bytes at most) and
counts of frequencies, of which there are 8 for each doubling.

Defined results: null and empty texts have no tokens; an added token's string in a text is that token, as
in the library; texts are whole, and a chunk is ``CHUNK`` bytes or one text; rows are independent,
so repeated rows and ties need nothing; other columns are carried by ``encode`` (one named
``token_ids`` is replaced); an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spark_climbs.llm import byte_bpe, transducer
from spark_climbs.llm.kept import kept
from spark_climbs.materialize import checkpoint_dir, discard, materialize

#: Words of the lexicon at most, and bytes of one.
LEXICON, LONGEST = 1 << 17, 48
#: Bytes of text that are at work together.
CHUNK = 2 << 20


def tokenizer(path: str) -> byte_bpe.ByteBpe:
    return kept(("byte_bpe", path), lambda: byte_bpe.ByteBpe(path))


def chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows from, to, the bytes of their texts (none for null) and where each ends."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=len(column) + 1, offset=8 * column.offset)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK, "right")) - 1)
        yield row, to, data[offsets[row] : offsets[to]], offsets[row + 1 : to + 1] - offsets[row]
        row = to


def _counted(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            for _, _, data, ends in chunks(batch.column("text")):
                starts, fixed = bpe.words(data, ends)
                sizes = np.diff(np.r_[starts, len(data)])
                some = (fixed < 0) & (sizes <= LONGEST)
                starts, sizes = starts[some], sizes[some]
                first, own = byte_bpe.distinct(data, starts, sizes)
                begins, lengths = starts[first], sizes[first]
                flat = data[byte_bpe.spread(begins, lengths)]
                offsets = np.r_[0, np.cumsum(lengths)].astype(np.int32)
                words = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])
                yield pa.RecordBatch.from_arrays([words, pa.array(np.bincount(own, minlength=len(first)), pa.int64())], ["word", "n"])

    return run


def frequent_words(documents: DataFrame, path: str) -> list[bytes]:
    """The most frequent words of all documents, up to ``LEXICON``, in ascending order."""
    counts = documents.select("text").mapInArrow(_counted(path), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = materialize(counts, "word_counts")
    scale = F.floor(F.log2("n") * 8)
    levels = sorted((r[0], r[1]) for r in counts.groupBy(scale.alias("level")).count().collect())
    least, room = None, LEXICON
    while levels and levels[-1][1] <= room:
        least, n = levels.pop()
        room -= n
    words = [] if least is None else [bytes(r[0]) for r in counts.filter(scale >= least).select("word").collect()]
    discard(counts)
    return sorted(words)


def compiled(words: list[bytes], bpe: byte_bpe.ByteBpe) -> bytes:
    """The file of a lexicon."""
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    data = np.frombuffer(b"".join(words), dtype=np.uint8)
    ids, counts = bpe.merge(data, np.cumsum(sizes) - sizes, sizes)
    arrays = transducer.build(words)
    return transducer.to_bytes(arrays | {"ids": ids.astype(np.int32), "id_counts": counts.astype(np.int32)})


def publish(spark: SparkSession, content: bytes) -> str:
    """Write a lexicon to the shared folder, for every executor to fetch; gives its name there."""
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint_dir(spark)}/lexicons/{name}")
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path, True)
    for k in range(0, len(content), 1 << 20):
        out.write(bytearray(content[k : k + (1 << 20)]))
    out.close()
    spark.sparkContext.addFile(path.toString())
    return name


class Lexicon:
    def __init__(self, path: str):
        self.arrays = transducer.mapped(path)
        self.ids = np.asarray(self.arrays["ids"], dtype=np.int64)
        self.counts = np.asarray(self.arrays["id_counts"], dtype=np.int64)
        self.starts = np.cumsum(self.counts) - self.counts

    def known(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
        return transducer.find(self.arrays, data, starts, sizes), self.ids, self.starts, self.counts


def lexicon(name: str) -> Lexicon:
    from pyspark import SparkFiles

    return kept(("lexicon", name), lambda: Lexicon(SparkFiles.get(name)))


def ids_of(bpe: byte_bpe.ByteBpe, words: Lexicon | None, data: np.ndarray, ends: np.ndarray, special: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the texts of a chunk, one after the other, and where each text's end."""
    starts, fixed = bpe.words(data, ends, special)
    sizes = np.diff(np.r_[starts, len(data)])
    ids, counts = byte_bpe.encode(bpe, data, starts, sizes, fixed, words.known if words else None)
    return ids, np.r_[0, np.cumsum(counts)][np.searchsorted(starts, ends)]


def decode(bpe: byte_bpe.ByteBpe, ids: np.ndarray) -> str:
    """The text of ids; bytes that are no characters give the replacement character."""
    return bpe.shown(np.asarray(ids, dtype=np.int64)).tobytes().decode(errors="replace")


def _digests(path: str, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, words = tokenizer(path), lexicon(name)
        for batch in batches:
            counts, of_ids, of_text = [], [], []
            for _, _, data, ends in chunks(batch.column("text")):
                ids, upto = ids_of(bpe, words, data, ends)
                raw = ids.astype("<u4")
                shown = bpe.shown(ids)
                bytes_upto = np.r_[0, np.cumsum(bpe.token_sizes[ids])][upto]
                a = b = 0
                for x, y in zip(upto.tolist(), bytes_upto.tolist()):
                    counts.append(x - a)
                    of_ids.append(hashlib.sha256(raw[a:x]).hexdigest())
                    text = shown[b:y].tobytes()
                    of_text.append(hashlib.sha256(text.decode(errors="replace").encode()).hexdigest())
                    a, b = x, y
            columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _encoded(path: str, name: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, words = tokenizer(path), lexicon(name)
        for batch in batches:
            flat, upto = [np.zeros(0, np.int64)], [np.zeros(1, np.int64)]
            for _, _, data, ends in chunks(batch.column("text")):
                ids, own = ids_of(bpe, words, data, ends)
                upto.append(own + upto[-1][-1])
                flat.append(ids)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(upto), pa.int32()), pa.array(np.concatenate(flat).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], lists], [*names, "token_ids"])

    return run


def _decoded(path: str, names: list[str], ids: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            texts = [None if own is None else decode(bpe, own) for own in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(texts, pa.string())], [*names, "decoded"])

    return run


def learnt(documents: DataFrame, path: str) -> str:
    """Compile the lexicon of the documents; gives the name that workers find it by."""
    return publish(documents.sparkSession, compiled(frequent_words(documents, path), byte_bpe.ByteBpe(path)))


def encode(documents: DataFrame, path: str) -> DataFrame:
    """The documents with ``token_ids`` of their texts."""
    of = documents.drop("token_ids")
    schema = ", ".join(f"`{c}` {t}" for c, t in of.dtypes) + ", token_ids array<int>"
    return of.mapInArrow(_encoded(path, learnt(documents, path), of.columns), schema)


def decoded(rows: DataFrame, path: str, ids: str = "token_ids") -> DataFrame:
    """The rows with the text ``decoded`` from a column of ids."""
    of = rows.drop("decoded")
    schema = ", ".join(f"`{c}` {t}" for c, t in of.dtypes) + ", decoded string"
    return of.mapInArrow(_decoded(path, of.columns, ids), schema)


def digests(documents: DataFrame, path: str) -> DataFrame:
    """Of every document: number and SHA-256 (little-endian 32-bit) of its ids, and the SHA-256 of
    the text that they decode to."""
    schema = f"doc_id {dict(documents.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return documents.select("doc_id", "text").mapInArrow(_digests(path, learnt(documents, path)), schema)

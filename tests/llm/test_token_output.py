import glob
import heapq
import random
import zlib

import cases
import numpy as np
import pyarrow.parquet as pq
import pytest

from spark_climbs.llm import huffman, tokenizers_at
from spark_climbs.llm import token_output as O

PATH = tokenizers_at.path("word_bpe_49k.json")


@pytest.mark.parametrize("n", [0, 1, 2, 3, 255, 256, 257, 5000, 300_000])
@pytest.mark.parametrize("limit", [16, 20])
def test_codes_round_trip(n, limit):
    ids = np.minimum(np.random.default_rng(n).zipf(1.3, n), 49_000)
    counts = np.bincount(ids, minlength=49_408)
    lengths = huffman.lengths(counts, limit)
    assert lengths.max() <= limit and (0.5 ** lengths[lengths > 0].astype(float)).sum() <= 1
    assert ((lengths > 0) == (counts > 0)).all()
    bits, checkpoints = huffman.encode(ids, lengths, huffman.canonical(lengths))
    assert len(checkpoints) == -(-n // huffman.STRIDE)
    if n:
        assert (huffman.decode(bits, checkpoints, n, huffman.decoding_table(lengths)) == ids).all()


def test_lengths_are_the_best():
    weights = np.random.default_rng(1).integers(1, 1000, 200)
    heap = [(int(w), k, [k]) for k, w in enumerate(weights)]
    heapq.heapify(heap)
    depth, at = np.zeros(200, int), 200
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        depth[a[2] + b[2]] += 1
        at += 1
        heapq.heappush(heap, (a[0] + b[0], at, a[2] + b[2]))
    assert (huffman.lengths(weights).astype(int) * weights).sum() == (depth * weights).sum()


def test_pieces_are_encoded_as_the_text():
    from tokenizers import Tokenizer

    whole, pieces, rng = Tokenizer.from_file(PATH), O._Pieces(PATH), random.Random(3)
    parts = ["a", "E", "́", "É", "İ", "Σ", " ", "\n", "\t", " ", "\xa0", "'s", "'S", "12", "<|endoftext|>", "<|", "日本", "!", "\x1c", "\x85", "ﬁ", "‍", "👍🏽", "\0", "\x0b"]
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 9)))
        assert O.encode(text, pieces).tolist() == whole.encode(text, add_special_tokens=False).ids


def test_files_against_the_tokenizer(spark, monkeypatch, tmp_path):
    from tokenizers import Tokenizer

    monkeypatch.setattr(O, "RANGE_ROWS", 7)
    monkeypatch.setattr(O, "BLOCK", 300)
    whole = Tokenizer.from_file(PATH)
    path = str(tmp_path / "tokens")
    O.write(cases.awkward(spark), path, PATH)
    rows = sorted(O.read(spark, path).collect(), key=lambda r: r["start"])
    want = {}
    for r in cases.awkward_rows():
        want.setdefault(r[0], []).append([*whole.encode(r[1] or "", add_special_tokens=False).ids, 1])
    at, last = 0, None
    for r in rows:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"])
        assert last is None or r["doc_id"] is None or r["doc_id"] >= last
        want[r["doc_id"]].remove(r["ids"])
        at, last = at + r["n_tokens"], r["doc_id"]
    assert not any(want.values())
    assert rows[0]["doc_id"] is None
    # files in the order of their names, one document following the other
    tables = [pq.read_table(f) for f in sorted(glob.glob(f"{path}/blocks/*.parquet"))]
    starts, sizes = ([x for t in tables for block in t[c].to_pylist() for x in block] for c in ("starts", "sizes"))
    assert len(tables) > 2 and starts == [sum(sizes[:k]) for k in range(len(sizes))]
    digests = {(r["doc_id"], r["start"]): r["ids_crc32"] for r in O.read(spark, path, digest=True).collect()}
    assert all(digests[r["doc_id"], r["start"]] == zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes()) for r in rows)


def test_latin_letters_and_characters_of_every_plane():
    from tokenizers import Tokenizer

    whole, pieces, rng = Tokenizer.from_file(PATH), O._Pieces(PATH), random.Random(4)
    texts = [f"x{chr(c)}y {chr(c)} 1{chr(c)}" for c in range(0x250)]
    texts += ["".join(f"a{chr(c)} '{chr(c)}" for c in rng.sample([*range(0x250, 0xD800), *range(0xE000, 0x110000)], 20)) for _ in range(300)]
    texts += ["it's 'tis we're 'REally ''s don'ts x'll'd 'm", " 's", "12345", ""]
    assert [x.tolist() for x in pieces.encode(texts)] == [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]


def test_any_other_tokenizer_encodes_whole_texts(spark):
    from tokenizers import Tokenizer

    other = tokenizers_at.path("byte_bpe_50k.json")
    whole, pieces = Tokenizer.from_file(other), O._Pieces(other)
    assert O._Pieces(PATH).cut and not pieces.cut
    for text in ("Two  Words\n", "a.", " x", "<|endoftext|>", ""):
        assert O.encode(text, pieces).tolist() == whole.encode(text, add_special_tokens=False).ids


def test_nothing(spark):
    assert O.round_trip(cases.nothing(spark), PATH).count() == 0

import hashlib
import random

import cases
import numpy as np
import pytest

from spark_climbs.llm import bpe_lexicon as L
from spark_climbs.llm import byte_bpe, tokenizers_at, transducer

PATH = tokenizers_at.path("byte_bpe_50k.json")
PARTS = ["a", "E", "é", "'", "'s", "'re", "'LL", "'ll", "'d", " ", "  ", "\n", "\t", "\r\n", "12", "½", "Ⅷ", "!", "?!", "<|endoftext|>", "<|", "日本", "\x1c", "\x85", "\xa0", "　", "👍🏽", "\0", "\x0b", "aaaa", "the", " the", "ing", "՘", "\U000110a0", " don't", "ve", "re", "_", "-", "...", "z̄"]


@pytest.fixture(scope="module")
def bpe():
    return byte_bpe.ByteBpe(PATH)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return lambda plain=False: _set(Tokenizer.from_file(PATH), plain)


def _set(tokenizer, plain):
    tokenizer.encode_special_tokens = plain
    return tokenizer


def _ids(bpe, texts, words=None, special=True):
    raws = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raws), dtype=np.uint8)
    ids, upto = L.ids_of(bpe, words, data, np.cumsum([len(r) for r in raws]), special)
    return [x.tolist() for x in np.split(ids, upto[:-1])]


@pytest.mark.parametrize("plain", [False, True])
def test_chunks_of_odd_texts_as_the_library(bpe, library, plain):
    rng = random.Random(4)
    texts = ["".join(rng.choices(PARTS, k=rng.randint(0, 12))) for _ in range(5000)]
    want = [e.ids for e in library(plain).encode_batch(texts, add_special_tokens=False)]
    assert _ids(bpe, texts, special=not plain) == want


def test_characters_of_every_plane(bpe, library):
    rng = random.Random(5)
    texts = ["".join(f"{x}{chr(c)}{x}" for c in rng.sample([*range(0xD800), *range(0xE000, 0x110000)], 20) for x in "a1 ") for _ in range(200)]
    assert _ids(bpe, texts) == [e.ids for e in library().encode_batch(texts, add_special_tokens=False)]


def test_token_bytes(bpe, library):
    tokenizer = library()
    for k in range(0, bpe.size):
        assert L.decode(bpe, [k]) == tokenizer.decode([k], skip_special_tokens=False)


def test_transducer_is_minimal_and_numbers_words(tmp_path):
    rng = random.Random(6)
    words = sorted({bytes(rng.choices(b"abc\xff\0", k=rng.randint(0, 7))) for _ in range(3000)} | {b""})
    (tmp_path / "t").write_bytes(transducer.to_bytes(transducer.build(words)))
    arrays = transducer.mapped(str(tmp_path / "t"))
    others = [bytes(rng.choices(b"abcd\xff\0", k=rng.randint(0, 9))) for _ in range(3000)]
    asked = words + others
    sizes = np.array([len(w) for w in asked])
    data = np.frombuffer(b"".join(asked), dtype=np.uint8)
    number = {w: k for k, w in enumerate(words)}
    assert transducer.find(arrays, data, np.cumsum(sizes) - sizes, sizes).tolist() == [number.get(w, -1) for w in asked]
    # as many states as there are different sets of endings
    endings = {w[:k]: set() for w in words for k in range(len(w) + 1)}
    for w in words:
        for k in range(len(w) + 1):
            endings[w[:k]].add(w[k:])
    assert len(arrays["final"]) == len({frozenset(e) for e in endings.values()})


def test_no_words():
    arrays = transducer.build([])
    assert transducer.find(arrays, np.frombuffer(b"ab", np.uint8), np.array([0, 1]), np.array([1, 1])).tolist() == [-1, -1]


def test_equal_hashes_are_told_apart(monkeypatch, bpe, library):
    monkeypatch.setattr(byte_bpe, "hashes", lambda data, starts, sizes: np.zeros(len(starts), np.uint64))
    texts = ["the cat", "a the cat sat", "xyzzy"]
    assert _ids(bpe, texts) == [e.ids for e in library().encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("lexicon, chunk", [(1 << 17, 1 << 21), (40, 300), (0, 1)])
def test_documents_against_the_library(spark, library, monkeypatch, lexicon, chunk):
    monkeypatch.setattr(L, "LEXICON", lexicon)
    monkeypatch.setattr(L, "CHUNK", chunk)
    rows = [r[:2] for r in cases.awkward_rows()] + [(80, "it's <|endoftext|>  <|endoftext|>\n"), (81, "<|endoftext|>")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    tokenizer, want = library(), []
    for k, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        sha = hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        want.append((k, len(ids), sha, hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    found = [tuple(r) for r in L.digests(docs, PATH).collect()]
    assert sorted(found, key=str) == sorted(want, key=str)


def test_encode_and_decode_carry_columns(spark, library):
    docs = cases.awkward(spark)
    back = L.decoded(L.encode(docs, PATH), PATH)
    assert back.columns == [*docs.columns, "token_ids", "decoded"]
    assert all(r["decoded"] == (r["text"] or "") for r in back.collect())


def test_given_table(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    tokenizer = library()
    found = {r["doc_id"]: r["ids_sha256"] for r in L.digests(docs, PATH).collect()}
    for r in docs.collect():
        ids = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids
        assert found[r["doc_id"]] == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()


def test_nothing(spark):
    assert L.digests(cases.nothing(spark), PATH).count() == 0

import hashlib
import random
from collections import Counter

import cases
import numpy as np
import pytest

from spark_climbs.llm import bpe_lexicon, byte_bpe, tokenizers_at
from spark_climbs.llm import token_alignment as T

A, B = tokenizers_at.path("byte_bpe_50k.json"), tokenizers_at.path("piece_bpe_32k.model")


def sides():
    """The libraries' encodings with the bytes of every token."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    of_letter = {c: k for k, c in enumerate(byte_bpe.byte_letters())}

    def first(text):
        return [(k, bytes(of_letter[c] for c in a.id_to_token(k))) for k in a.encode(" " + text, add_special_tokens=False).ids]

    def second(text):
        shown = lambda p: bytes([int(p[3:-1], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()
        return [(k, shown(b.id_to_piece(k))) for k in b.encode(text)]

    return first, second


def expected(rows):
    """The whole table of digests from all pairs of tokens of each document."""
    first, second = sides()
    met, told = Counter(), []
    for doc_id, text in rows:
        a, b = (first(text), second(text)) if text else ([], [])
        raw = (" " + (text or "")).encode()
        if b"".join(t for _, t in a) != raw or b"".join(t for _, t in b) != raw:
            told.append((doc_id, [], [], [], ""))
            continue
        places = []
        for tokens in (a, b):
            at, own = 0, []
            for k, t in tokens:
                own.append((k, at, at + len(t)))
                at += len(t)
            places.append(own)
        links = [(x[0], y[0]) for x in places[0] for y in places[1] if x[1] < y[2] and y[1] < x[2]]
        met.update(links)
        both = sorted({x[2] for x in places[0]} & {y[2] for y in places[1]})
        groups, at = [], 0
        for end in both:
            groups.append("|".join(",".join(str(k) for k, s, e in own if at <= s and e <= end) for own in places))
            at = end
        told.append((doc_id, a, b, links, ";".join(groups)))
    best: dict = {}
    for (_, y), n in met.items():
        best[y] = max(best.get(y, 0), n)
    return [
        (d, len(a), len(b), groups.count("|"), len(links), sum(met[x] == best[x[1]] for x in links), sum(met[x] for x in links), hashlib.sha256(groups.encode()).hexdigest() if groups else "")
        for d, a, b, links, groups in told
    ]


def odd_rows():
    rng = random.Random(8)
    parts = ["a", " ", "  ", "\n", "é", "日本", "👍🏽", "▁", "<s>", "<unk>", "<0x41>", "<|endoftext|>", "ing", " the", "\0", "\x85", "12", "z̄", "don't"]
    return [(100 + k, "".join(rng.choices(parts, k=rng.randint(1, 9)))) for k in range(300)]


@pytest.mark.parametrize("chunk, block", [(2 << 20, 8 << 20), (50, 200), (1, 1)])
def test_against_all_pairs(spark, monkeypatch, chunk, block):
    monkeypatch.setattr(bpe_lexicon, "CHUNK", chunk)
    monkeypatch.setattr(T, "BLOCK", block)
    rows = [(k, text if text is None or len(text) < 5000 else text[:3000]) for k, text, *_ in cases.awkward_rows()] + odd_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = sorted(expected(rows), key=str)
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    found = sorted((tuple(r) for r in T.digests(docs, A, B).select(columns).collect()), key=str)
    assert found == want
    assert any(w[-1] == "" and w[0] is not None and w[0] > 99 for w in want) and any(w[4] > w[1] for w in want)


def test_alignments_carry_columns(spark):
    docs = cases.awkward(spark)
    first, second = sides()
    rows = T.aligned(docs, A, B)
    assert rows.columns == [*docs.columns, *T._LISTS]
    for r in rows.collect():
        if not r["text"]:
            assert r["a_ids"] == r["b_ids"] == r["a_links"] == []
            continue
        assert r["a_ids"] == [k for k, _ in first(r["text"])] or not r["a_ids"]
        # links as runs of bytes that overlap
        ends = [np.cumsum([len(t) for _, t in side(r["text"])]) for side in (first, second)] if r["a_ids"] else [[], []]
        links = list(zip(r["a_links"], r["b_links"]))
        assert links == sorted(set(links))
        for x, y in links[:200]:
            assert max(ends[0][x - 1] if x else 0, ends[1][y - 1] if y else 0) < min(ends[0][x], ends[1][y])
        assert len(set(r["a_groups"])) == len(set(r["b_groups"]))


def test_text_ids(spark):
    docs = spark.createDataFrame([("x", "one two"), (None, None)], "doc_id string, text string")
    assert {(r["doc_id"], r["n_a"]) for r in T.digests(docs, A, B).collect()} == {("x", 2), (None, 0)}


def test_nothing(spark):
    assert T.digests(cases.nothing(spark), A, B).count() == 0

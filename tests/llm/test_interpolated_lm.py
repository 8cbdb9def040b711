import math
import zlib

import cases
import numpy as np
import pytest

from spark_climbs.llm import interpolated_lm as L

END = " end"


def tokens(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    return [*cases.split(low), END]


def learnt(doc) -> bool:
    return doc is not None and zlib.crc32(str(doc).encode()) % 10 != 0


def plain(rows):
    count, pairs = {}, {}
    for doc, text in rows:
        if learnt(doc):
            of = tokens(text)
            for a, b in zip([END, *of], of):
                count[b] = count.get(b, 0) + 1
                pairs[a, b] = pairs.get((a, b), 0) + 1
    return count, pairs


def test_against_plain_counts(spark, monkeypatch):
    monkeypatch.setattr(L, "BLOCK", 500)
    rows = [(r[0], r[1]) for r in cases.awkward_rows()]
    count, pairs = plain(rows)
    n, v = sum(count.values()), len(count)
    kinds, weights = {}, None
    for doc, text in rows:
        if learnt(doc):
            of = tokens(text)
            for a, b in zip([END, *of], of):
                c, h, p = count[b] - 1, count[a] - 1, pairs[a, b] - 1
                ratio = lambda x: round(8 * math.log2(x * (v + 1))) if x > 0 else L.NONE
                key = (min(h.bit_length(), L.BUCKETS - 1) << 40) + (ratio(p / h if h else 0) + 20_000 << 20) + ratio(c / (n - 1)) + 20_000
                kinds[key] = kinds.get(key, 0) + 1
    keys = sorted(kinds)
    weights = L.learn_weights(np.array(keys), np.array([kinds[k] for k in keys], dtype=float))
    want = {}
    for doc, text in rows:
        of = tokens(text)
        base = sum(math.log10((count.get(t, 0) + 0.1) / (n + 0.1 * (v + 1))) for t in of)
        score = 0.0
        for a, b in zip([END, *of], of):
            h = count.get(a, 0)
            w = weights[min(h.bit_length(), L.BUCKETS - 1)]
            score += math.log10(w[0] * (pairs.get((a, b), 0) / h if h else 0) + w[1] * count.get(b, 0) / n + w[2] / (v + 1))
        want.setdefault((doc, len(of)), []).append((sum(t in count for t in of), base, score))
    got = L.score(cases.awkward(spark)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["train_tokens"] == n and r["held_out"] == (r["doc_id"] is not None and not learnt(r["doc_id"]))
        assert any(r["n_known"] == k and r["base_score"] == pytest.approx(b) and r["score"] == pytest.approx(s, rel=1e-6) for k, b, s in want[r["doc_id"], r["n_tokens"]])


def test_weights_are_shares_and_raise_the_likelihood():
    rng = np.random.default_rng(4)
    kinds = np.unique((rng.integers(1, 8, 300) << 40) + (rng.integers(19_950, 20_080, 300) << 20) + rng.integers(19_950, 20_080, 300))
    counts = rng.integers(1, 50, len(kinds)).astype(float)
    weights = L.learn_weights(kinds, counts)
    assert np.allclose(weights.sum(axis=1), 1) and (weights >= 0).all()
    parts = np.stack([np.exp2(((kinds >> 20 & 0xFFFFF) - 20_000) / 8.0), np.exp2(((kinds & 0xFFFFF) - 20_000) / 8.0), np.ones(len(kinds))])
    of = lambda w: (counts * np.log((parts * w[kinds >> 40].T).sum(axis=0))).sum()
    assert of(weights) >= of(np.tile([0.3, 0.6, 0.1], (L.BUCKETS, 1)))


def test_model_is_better_than_the_base_on_held_out(spark):
    rows = L.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).filter("held_out")
    r = rows.selectExpr("sum(score) s", "sum(base_score) b").first()
    assert r["s"] > r["b"]


def test_nothing_to_learn(spark):
    assert L.score(cases.nothing(spark)).count() == 0
    rows = spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string")
    assert {(r["n_tokens"], r["score"], r["base_score"]) for r in L.score(rows).collect()} == {(3, 0.0, 0.0), (1, 0.0, 0.0)}


def test_packing():
    rng = np.random.default_rng(1)
    keys = np.sort(rng.integers(0, 1 << 63, 1000, dtype=np.uint64) * np.uint64(2))
    assert (L.unpack_sorted(L.pack_sorted(keys), len(keys)) == keys).all()
    assert len(L.unpack(L.pack(np.zeros(0, "<u4")), 0, "<u4")) == 0

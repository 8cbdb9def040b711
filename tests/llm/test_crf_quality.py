import itertools
import zlib

import cases
import numpy as np

from spark_climbs.llm import crf_quality as C


def test_forward_backward_against_all_labelings():
    rng = np.random.default_rng(2)
    sizes = [4, 1, 6, 3]
    packed = C.Packed(np.array(sizes))
    odds, pair = rng.normal(size=sum(sizes)), rng.normal(size=(2, 2))
    good, pairs = C.forward_backward(odds, pair, packed)
    at, want_pairs = 0, np.zeros((2, 2))
    for n in sizes:
        total, good_of, pairs_of = 0.0, np.zeros(n), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=n):
            w = np.exp(sum(odds[at + k] for k in range(n) if y[k]) + sum(pair[a, b] for a, b in zip(y, y[1:])))
            total += w
            good_of += w * np.array(y)
            for a, b in zip(y, y[1:]):
                pairs_of[a, b] += w
        assert np.allclose(good[at : at + n], good_of / total)
        want_pairs += pairs_of / total
        at += n
    assert np.allclose(pairs, want_pairs)


def test_neighbours_are_features():
    x, packed = C.features([C.line_measures("a b\nC!! D!!\ne f")[0], C.line_measures("one line")[0]])
    own = x[:, : C.WIDTH]
    assert (x[1, C.WIDTH : 2 * C.WIDTH] == own[0]).all() and (x[1, 2 * C.WIDTH : 3 * C.WIDTH] == own[2]).all()
    assert not x[3, C.WIDTH : 3 * C.WIDTH].any()


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    documents, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    rows = C.score(documents, labels).collect()
    assert len(rows) == documents.count()
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)


def test_awkward_rows(spark):
    docs = cases.awkward(spark)
    labels = spark.createDataFrame([(k, k % 2, None) for k in range(40)] + [(None, 1, 0), (3, None, 1)], "doc_id long, quality int, toxic int")
    rows = C.score(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    blank = {r["score"] for r in rows if r["doc_id"] in (60, 61, 62, 63)}
    assert len(blank) == 1
    alone = C.score(docs, labels.filter("quality = 1")).collect()
    assert {r["score"] for r in alone} == {1.0}
    assert {r["score"] for r in C.score(docs, labels.limit(0)).collect()} == {0.5}
    assert C.score(cases.nothing(spark), labels).count() == 0

import random
import zlib

import cases
import numpy as np
import pytest

from spark_climbs.llm import pieces as M
from spark_climbs.llm import tokenizers_at

PATH = tokenizers_at.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return M.Pieces(PATH)


def every_path(model, text):
    """All segmentations with their scores, best first."""
    s, out = (" " + text if text else ""), []

    def go(i, score, ids):
        if i == len(s):
            out.append((score, ids))
            return
        single = False
        for j in range(i + 1, len(s) + 1):
            if M.SPACE in s[i:j]:
                break
            found = model.lattice.get(s[i:j].replace(" ", M.SPACE))
            if found:
                single = single or j == i + 1
                go(j, score + found[0], [*ids, *found[1]])
        if not single:
            go(i + 1, score + model.byte_score, ids + [model.byte_ids[b] for b in s[i].encode()])

    go(0, 0.0, [])
    return sorted(out, key=lambda x: -x[0])


def test_n_best_against_all_paths(model):
    rng = random.Random(1)
    texts = ["", "a", "Hello  world", "ab\nTh. of", "é☃ x▁y", "▁", "12 a3", "  x ", "a\t\n b", "日本 a²."]
    texts += ["".join(rng.choices("the ofan.é\n1▁", k=rng.randint(1, 11))) for _ in range(60)]
    for text in texts:
        want = every_path(model, text)
        for n in (1, 2, 5):
            got = model.n_best(text, n)
            assert [s for s, _ in got] == [s for s, _ in want[:n]]
            assert all((s, ids) in [(a, list(b)) for a, b in want] for s, ids in got)
            assert len({tuple(ids) for _, ids in got}) == len(got)
            assert all(model.decode(ids) == text for _, ids in got)
        ids, score, gap = model.best(text)
        assert score == want[0][0]
        assert score - gap == want[1][0] if len(want) > 1 else gap == float("inf")


def test_stretches_cross_no_piece(model):
    assert all(model.cut.fullmatch(p.replace(M.SPACE, " ")) for p in model.surface.values())
    for text in ("a b", "\r\n x", "², a", "  ", "x▁▁y"):
        assert "".join(model.stretches(text)) == " " + text


def test_documents(spark, model):
    docs = cases.awkward(spark)
    rows = M.digests(docs, PATH).collect()
    assert len(rows) == docs.count()
    assert all(r["decodes"] for r in rows if r["n_pieces"] is not None)
    assert sum(r["n_pieces"] is None for r in rows) == docs.filter("text is null").count()
    coded = M.encode(docs.withColumnRenamed("key", "piece_ids"), PATH, n=2).collect()
    texts = {r[1] for r in cases.awkward_rows()}
    for r in coded:
        assert r["text"] in texts
        if r["text"] is not None:
            assert r["piece_ids"] == r["n_best"][0]["ids"] == model.best(r["text"])[0].tolist()
    assert M.encode(cases.nothing(spark), PATH).count() == 0


def test_digests_of_the_second_best(spark, model):
    """The second best segmentation is one of the search, not a difference of scores."""
    texts = ["", "a", "Hello  world", "ab\nTh. of", "é☃ x▁y", "12 a3", "日本 a²."]
    rows = M.digests(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), PATH).collect()
    crc = lambda ids: zlib.crc32(np.array(ids, dtype="<i4").tobytes())
    for r in rows:
        want = every_path(model, texts[r["doc_id"]])
        assert r["ids_crc32"] in {crc(ids) for s, ids in want if s == r["score"]} and r["score"] == want[0][0]
        if len(want) == 1:
            assert r["second_score"] is None and r["second_crc32"] is None
        else:
            assert r["second_crc32"] in {crc(ids) for s, ids in want if s == r["second_score"]} and r["second_score"] == want[1][0]
            assert r["second_crc32"] != r["ids_crc32"]
    assert any(r["second_crc32"] for r in rows)


def test_left_out_paths_are_worse_than_the_second(model):
    """The search for two paths looks at fewer of them than the one for five, and finds the same ones."""
    rng = random.Random(2)
    words = ["".join(rng.choices("etaoinshr", k=rng.randint(1, 14))) for _ in range(300)]
    pushes = {}
    for n in (2, 5):
        done, push = [], M.heappush
        try:
            M.heappush = lambda heap, x: (done.append(1), push(heap, x))
            found = [model.paths(" " + w, n)[:2] for w in words]
        finally:
            M.heappush = push
        pushes[n] = len(done), found
    assert pushes[2][1] == pushes[5][1]
    assert pushes[2][0] < 0.7 * pushes[5][0]
    assert not any(isinstance(v, bytes) for w in words for v in model.entry(w)[1:])

import hashlib
import random

import cases

from spark_climbs.llm import suffix_dedup as S


def plain(rows, length=400) -> list[tuple]:
    raws = [(doc, (text or "").encode()) for doc, text in rows]
    count: dict = {}
    for _, raw in raws:
        for p in range(len(raw) - length + 1):
            count[raw[p : p + length]] = count.get(raw[p : p + length], 0) + 1
    out = []
    for doc, raw in raws:
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            if count[raw[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        runs = sum(gone[k] and not (k and gone[k - 1]) for k in range(len(raw)))
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((doc, len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def same(spark, rows, shape=S.LONG):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in S.spans(docs, shape).collect()]
    assert sorted(got, key=repr) == sorted(plain(rows, shape.length), key=repr)


def test_awkward_rows(spark):
    same(spark, [(r[0], r[1]) for r in cases.awkward_rows() if len(r[1] or "") < 20_000])


def test_passages_cut_short_shifted_and_overlapping(spark):
    rng = random.Random(11)
    noise = lambda n: "".join(rng.choices("abcdé\n ", k=n))
    base = noise(3000)
    rows = [(k, noise(rng.randint(0, 500)) + base[a : a + n] + noise(rng.randint(0, 300))) for k in range(40) for a, n in [(rng.randint(0, 2000), rng.choice([300, 395, 399, 400, 401, 430, 700]))]]
    rows += [(100, base[:380]), (101, base[:400]), (102, base[10:410]), (103, base[2600:])]
    same(spark, rows)


def test_shorter_passages(spark):
    rng = random.Random(12)
    noise = lambda n: "".join(rng.choices("abcdé\n ", k=n))
    base = noise(900)
    rows = [(k, noise(rng.randint(0, 200)) + base[a : a + rng.choice([150, 190, 198, 199, 200, 260])] + noise(rng.randint(0, 90))) for k in range(40) for a in [rng.randint(0, 600)]]
    same(spark, [*rows, (100, base[:195]), (101, base[:199]), (102, "x" * 260)], S.PASSAGE)
    assert S.PASSAGE.width * S.PASSAGE.ranges == S.PASSAGE.starts and S.LONG.width * S.LONG.ranges == S.LONG.starts


def test_periodic_texts(spark):
    same(spark, [(1, "abc " * 120), (2, "abc " * 99), (3, "x" * 401), (4, "x" * 400), (5, "y" * 400), (6, "z" * 399), (7, "bc abc " + "abc " * 300 + "end")])


def test_texts_that_end_inside_a_range(spark):
    rng = random.Random(5)
    body = "".join(rng.choices("abcdefgh \0", k=900))
    rows = [(k, body[k : k + 400 + k]) for k in range(0, 60, 7)] + [(200 + k, "\0" * k + body[100:510] + "\0" * (9 - k)) for k in range(9)]
    same(spark, rows)


def test_cut_keeps_columns_and_drops_what_is_empty(spark):
    docs = cases.awkward(spark)
    cut = S.cut(docs)
    assert cut.columns == docs.columns
    gone = {r["doc_id"] for r in S.spans(docs).collect() if r["n_bytes"] == r["n_removed"]}
    rows = cut.collect()
    assert all(r["text"] and r["n_chars"] == len(r["text"]) for r in rows)
    assert not {r["doc_id"] for r in rows} & (gone - {None, 70})


def test_empty(spark):
    assert S.spans(cases.nothing(spark)).count() == 0


def test_no_task_takes_a_crowded_core_whole(spark, monkeypatch):
    rng = random.Random(17)
    noise = lambda n: "".join(rng.choices("abcd", k=n))
    passage = noise(410)
    rows = [(k, noise(rng.randint(0, 40)) + passage[rng.randint(0, 9) :] + noise(rng.randint(0, 40))) for k in range(60)]
    one_task = S._repeated_rows

    def bounded(batches):
        def checked():
            seen = {}
            for batch in batches:
                for core in batch.column("core").to_pylist():
                    seen[core] = seen.get(core, 0) + 1
                    assert seen[core] <= 4
                yield batch

        yield from one_task(checked())

    monkeypatch.setattr(S, "BATCH", 4)
    monkeypatch.setattr(S, "_repeated_rows", bounded)
    same(spark, rows)

import hashlib

import cases
import pytest
from pyspark.sql import functions as F

from spark_climbs.llm import mixing


def goals(sizes: dict, cap: int) -> dict:
    """Targets by sharing the excess again until none is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(cap * sizes[s] for s in full)
        shared = sum(weight[s] for s in order if s not in full)
        got = {s: cap * sizes[s] if s in full else rest * weight[s] / shared for s in order}
        over = {s for s in order if s not in full and got[s] > cap * sizes[s]}
        if not over:
            return got
        full |= over


def test_targets_and_taken(spark):
    rows = cases.awkward_rows()
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(cases.split(r[1]))
    want = goals(sizes, 3)
    got = mixing.assign(cases.awkward(spark)).collect()
    assert len(got) == len(rows)
    taken, longest = {}, {}
    for r in got:
        size = len(cases.split(r["text"]))
        assert r["__mix_size"] == size and r["__mix_copies"] <= 3
        assert r["__mix_target"] == pytest.approx(want[r["source"]])
        taken[r["source"]] = taken.get(r["source"], 0) + size * r["__mix_copies"]
        longest[r["source"]] = max(longest.get(r["source"], 0), size)
        assert len(r["__mix_positions"]) == r["__mix_copies"] and all(0 <= p <= 1 for p in r["__mix_positions"])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= longest[s] / 2 + 1


def test_positions_invert_the_integrated_schedule(spark):
    shares = [k / 50 for k in range(51)]
    df = spark.createDataFrame([(s, p) for s in shares for p in range(3)], "share double, phase int")
    for r in df.withColumn("t", mixing.position(F.col("share"), F.col("phase"))).collect():
        knots = mixing.SCHEDULES[r["phase"]]
        area = lambda upto: sum(
            (min(t1, upto) - t0) * (w0 + (w0 + (w1 - w0) * (min(t1, upto) - t0) / (t1 - t0))) / 2
            for (t0, w0), (t1, w1) in zip(knots, knots[1:])
            if upto > t0
        )
        assert area(r["t"]) / area(1.0) == pytest.approx(r["share"], abs=1e-9)


def test_mix_repeats_whole_documents_in_order_of_position(spark):
    docs = cases.awkward(spark)
    copies = {}
    for r in mixing.assign(docs).collect():
        k = (r["doc_id"], r["text"])
        copies[k] = copies.get(k, 0) + r["__mix_copies"]
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    got = {}
    for r in mixed.collect():
        got[(r["doc_id"], r["text"])] = got.get((r["doc_id"], r["text"]), 0) + 1
    assert got == {k: n for k, n in copies.items() if n}
    assert sorted(map(str, mixed.collect())) == sorted(map(str, mixing.mix(docs).collect()))


def test_order_inside_a_source_follows_the_hash(spark):
    docs = spark.createDataFrame([(k, "x " * 10, "s") for k in range(200)] + [(k, "y", "t") for k in range(200, 210)], "doc_id long, text string, source string")
    rows = [r for r in mixing.assign(docs).collect() if r["source"] == "s"]
    rows.sort(key=lambda r: hashlib.md5(str(r["doc_id"]).encode()).hexdigest())
    firsts = [r["__mix_positions"][0] for r in rows if r["__mix_copies"]]
    assert firsts == sorted(firsts)


def test_empty(spark):
    assert mixing.mix(cases.nothing(spark)).count() == 0
    assert mixing.shares(cases.nothing(spark)).count() == 0

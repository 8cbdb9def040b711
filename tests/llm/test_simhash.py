import itertools
import random

import cases
import xxhash

from spark_climbs.llm import simhash


def plain(text: str | None) -> int:
    of = [w.lower() if w.isascii() else w.encode().lower().decode() for w in cases.split(text)]
    shingles = [" ".join(of[k : k + 4]) for k in range(len(of) - 3)] or ([" ".join(of)] if of else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_every_four_positions_hold_a_listed_set():
    sets = simhash.position_sets()
    assert len(sets) == 20
    for four in itertools.combinations(range(8), 4):
        assert any(set(s) <= set(four) for s in sets)


def test_groups_against_brute_force(spark):
    rows = cases.awkward_rows()
    prints = [plain(r[1]) for r in rows]
    label = cases.components(len(rows), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    low = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            low[label[k]] = min(low.get(label[k], r[0]), r[0])
    want = [(r[0], f"{prints[k]:016x}", low.get(label[k])) for k, r in enumerate(rows)]
    got = [tuple(r) for r in simhash.near_duplicates(cases.awkward(spark)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_links_of_random_clusters(spark):
    rng = random.Random(3)
    prints = set()
    for _ in range(60):
        centre = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            centre ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5)))
            prints.add(centre)
    prints = sorted(prints)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in prints], "fp long")
    place = {signed(x): k for k, x in enumerate(prints)}
    links = {frozenset((place[r["u"]], place[r["v"]])) for r in simhash.links(df).collect()}
    assert all((prints[a] ^ prints[b]).bit_count() <= 4 for a, b in map(tuple, links))
    assert cases.components(len(prints), lambda a, b: frozenset((a, b)) in links) == cases.components(
        len(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4
    )


def test_one_document_of_each_group_stays(spark):
    docs = cases.awkward(spark)
    kept = simhash.first_of_each(docs)
    assert kept.columns == docs.columns
    groups = {(r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted(g for g in groups if g is not None)


def test_empty(spark):
    assert simhash.near_duplicates(cases.nothing(spark)).count() == 0
    assert simhash.first_of_each(cases.nothing(spark)).count() == 0

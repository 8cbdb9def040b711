import math
import random
import unicodedata

import cases

from spark_climbs.llm import quality_rules as Q


def repeated(of: list[str]) -> int:
    at: dict = {}
    for k in range(len(of) - 7):
        at.setdefault(tuple(of[k : k + 8]), []).append(k)
    return len({k + j for places in at.values() if len(places) > 1 for k in places for j in range(8)})


def classes(text: str, chars: int) -> list[float]:
    def kind(c: str) -> int:
        if c in ".,;:'\"()-":
            return 2
        if c in "#*$%&|<>!?=+/@^~_[]{}\\":
            return 3
        return {"Lu": 0, "Nd": 1}.get(unicodedata.category(c), 9)

    found = [sum(kind(c) == k for c in text) for k in range(4)]
    return [*found, len(text) - chars, chars - sum(found)]


def divergence(counts, reference) -> float:
    if not sum(counts):
        return 0.0
    p, q = ([x / sum(v) for x in v] for v in (counts, reference))
    half = lambda a, b: sum(x * math.log2(x / ((x + y) / 2)) for x, y in zip(a, b) if x > 0)
    return (half(p, q) + half(q, p)) / 2


def test_against_brute_force(spark):
    rows = cases.awkward_rows()
    measured = []
    for r in rows:
        text, of = r[1] or "", cases.split(r[1])
        lines = [x for x in text.split("\n") if cases.split(x)]
        chars = sum(map(len, of))
        common = [of.count(w) for w in Q.VOCABULARY]
        counts = (len(of), chars, sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), repeated(of))
        measured.append((r[0], r[2], counts, classes(text, chars), [*common, len(of) - sum(common)]))
    references = {}
    for _, lang, _, c, w in measured:
        if lang in Q.COMMON_WORDS:
            a, b = references.setdefault(lang, ([0] * len(c), [0] * len(w)))
            references[lang] = ([x + y for x, y in zip(a, c)], [x + y for x, y in zip(b, w)])
    references = [v for v in references.values() if sum(v[1])]
    want = []
    for doc, _, counts, c, w in measured:
        failed = counts[0] < 20 or 100 * counts[4] > 30 * counts[0]
        d1, d2 = (min(divergence(x, r[k]) for r in references) for k, x in enumerate((c, w)))
        odd = counts[1] >= Q.MIN_CHARS and d1 > Q.MAX_CLASS_DIVERGENCE or counts[0] >= Q.MIN_COMMON and d2 > Q.MAX_WORD_DIVERGENCE
        want.append((doc, *counts, failed, not failed and not odd))
    got = [tuple(r) for r in Q.verdicts(cases.awkward(spark)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_accepted_keeps_columns(spark):
    docs = cases.awkward(spark)
    kept = Q.accepted(docs)
    assert kept.columns == docs.columns
    assert kept.count() == Q.verdicts(docs).filter("kept").count()


def test_no_reference_rejects_nothing_by_divergence(spark):
    docs = spark.createDataFrame([(1, "A!! B?? " * 4 + "word " * 30, None)], "doc_id long, text string, lang string")
    row = Q.verdicts(docs).first()
    assert row["kept"] == (not row["base_failed"])


def test_empty(spark):
    assert Q.verdicts(cases.nothing(spark)).count() == 0


def test_planted_junk_goes_and_prose_stays(spark):
    d = "/root/testdata/sf0.01"
    judged = Q.verdicts(spark.read.parquet(f"{d}/documents.parquet")).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id")
    good = judged.filter("quality = 1 and not base_failed")
    assert good.filter("kept").count() >= 0.99 * good.count()
    assert judged.filter("quality = 0 and not kept").count() >= 0.7 * judged.filter("quality = 0").count()


def test_clean_documents_of_any_language_stay(spark):
    rng = random.Random(11)
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "lang", "text")
    known = [tuple(r) for r in d.collect()]
    common = "i w na z do nie się jest że o jak po".split()
    rare = ["".join(rng.choices("acekmnoprstwyz", k=rng.randint(4, 9))) for _ in range(3000)]

    def prose(n: int) -> str:
        of = [rng.choice(common) if rng.random() < 0.3 else rng.choice(rare) for _ in range(n)]
        return ". ".join(" ".join(of[k : k + 12]).capitalize() for k in range(0, n, 12)) + "."

    clean = [(10_000 + k, "pl", prose(rng.randint(100, 400))) for k in range(60)]
    lists = [(20_000 + k, "pl", ". ".join(" ".join(rng.choices(rare, k=12)).capitalize() for _ in range(12))) for k in range(3)]
    few = [(30_000 + k, lang, prose(150)) for k, lang in enumerate(["cs", "cs", "sk", None])]
    rows = spark.createDataFrame([*known, *clean, *lists, *few], d.schema)
    kept = {r["doc_id"]: r["kept"] for r in Q.verdicts(rows).collect()}
    assert all(kept[k] for k, _, _ in [*clean, *few])
    assert not any(kept[k] for k, _, _ in lists)
    before = {r["doc_id"]: r["kept"] for r in Q.verdicts(d).collect()}
    assert all(kept[k] == v for k, v in before.items())

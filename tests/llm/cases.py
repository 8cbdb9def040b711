"""Small tables with the awkward cases, and plain restatements of what is computed."""

from __future__ import annotations

import random

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, n long, __own long, size long"


def awkward_rows() -> list[tuple]:
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, and extra
    columns with names that operators use."""
    rng = random.Random(7)
    vocabulary = ["the", "of", "and", "to", "in"] + ["".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choices(vocabulary, k=n))
    passage = prose(90)
    rows = []
    for k in range(40):
        text = prose(rng.randint(1, 120))
        if k % 5 == 0:
            text = f"{text}\n{passage}\n{prose(20)}"
        rows.append((k, text, rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", "\U0001f600", None]), len(text)))
    copy = prose(100)
    rows += [(k, copy, "en", "a", len(copy)) for k in (50, 51, 52)]
    near = copy.split()
    rows += [(53, " ".join([*near[:50], "zzz", *near[51:]]), "en", "b", 1)]
    rows += [
        (60, None, "en", "a", None),
        (61, "", None, None, 0),
        (62, " \n\t\n", "en", "b", 4),
        (63, "\x0b\x0c\r", "fr", "b", 3),
        (64, "é☃ \U0001f600\U0001f600 É\n\x00▁x\xa0y\x85z", "fr", "c", 9),
        (65, prose(20_000), "en", "a", 1),
        (66, "one two", None, "c", 7),
        (67, "Thing Thing " * 200, "en", "c", 1),
        (None, prose(50), None, None, None),
        (None, None, None, None, None),
        (70, copy, "en", "a", len(copy)),
        (70, copy, "en", "a", len(copy)),
        (70, prose(40), "en", "a", 1),
    ]
    return [(*r, "k", 5, 6, 7) for r in rows]


def awkward(spark):
    return spark.createDataFrame(awkward_rows(), DOC_SCHEMA).repartition(3)


def nothing(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


def split(text: str | None) -> list[str]:
    return [w.decode() for w in text.encode().split()] if text else []


def components(n: int, linked) -> list[int]:
    """Smallest reachable index of every index."""
    label = list(range(n))

    def root(k: int) -> int:
        while label[k] != k:
            k = label[k]
        return k

    for a in range(n):
        for b in range(a):
            if linked(a, b):
                x, y = root(a), root(b)
                label[max(x, y)] = min(x, y)
    return [root(k) for k in range(n)]

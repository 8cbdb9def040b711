import hashlib
import zlib

import cases
import pytest

from spark_climbs.llm import merkle_manifest as M


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row) -> str:
    of = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row]
    return sha("".join(of))


def levels(nodes: list[str]) -> list[list[str]]:
    out = [nodes]
    while len(out[-1]) > 1:
        last = out[-1]
        out.append([sha("".join(last[k : k + 2])) for k in range(0, len(last), 2)])
    return out


def way(tree: list[list[str]], at: int):
    """Sibling (or none) and whether it stands left, level by level."""
    for level in tree[:-1]:
        other = at ^ 1
        yield (level[other] if other < len(level) else None), other < at
        at >>= 1


def expected(rows: list[tuple]) -> list[tuple]:
    """``doc_id, leaf, subroot, root, proof, folded, verified`` of rows of doc_id, source, lang, n_chars, text."""
    groups: dict = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {g: levels([leaf(r) for r in groups[g]]) for g in order}
    crown = levels([trees[g][-1][0] for g in order])
    out = []
    for k, g in enumerate(order):
        for at, r in enumerate(groups[g]):
            steps = [*way(trees[g], at), *way(crown, k)]
            wrong = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            node = leaf((*r[:3], r[3] + 1, r[4])) if wrong else leaf(r)
            for other, left in steps:
                node = sha(node if other is None else other + node if left else node + other)
            proof = sha("".join(o for o, _ in steps if o is not None))
            out.append((r[0], leaf(r), trees[g][-1][0], crown[-1][0], proof, node, node == crown[-1][0]))
    return out


def of(df):
    return [tuple(r) for r in df.select("doc_id", "source", "lang", "n_chars", "text").collect()]


def same(found, want):
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, found), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("bits", [1, 2, 12])
def test_awkward_rows(spark, monkeypatch, bits):
    monkeypatch.setattr(M, "BLOCK_BITS", bits)
    rows = cases.awkward(spark)
    found = M.tampering(rows).collect()
    same(found, expected(of(rows)))
    assert {r["verified"] for r in found} == {True, False}


@pytest.mark.parametrize("size", [1, 2, 3, 5, 300])
def test_sizes(spark, monkeypatch, size):
    monkeypatch.setattr(M, "BLOCK_BITS", 3)
    rows = spark.createDataFrame([(k, "s", ["a", None, "é", "\U0001f600"][k % 4 if size > 5 else 0], k % 3, f"text {k}") for k in range(size)], "doc_id long, source string, lang string, n_chars long, text string")
    same(M.tampering(rows).collect(), expected(of(rows)))


def test_changed_rows_alone_fail(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = M.tampering(rows).collect()
    assert all(r["verified"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 != 0) for r in found)
    assert len({r["root"] for r in found}) == 1 and found[0]["root"] == expected(of(rows))[0][3]


def test_other_columns_and_groups(spark):
    """Any columns, group and order; columns named like the operator's own are hashed as they are."""
    rows = spark.createDataFrame([(f"id{k}", k % 2, k, "x") for k in range(9)], "name string, grp int, pos int, path string")
    found = M.prove(rows, ("name", "grp", "pos", "path"), group="grp", order="name", size=M.F.col("pos")).collect()
    assert {(r["name"], r["grp"], r["pos"]) for r in found} == {(f"id{k}", f"={k % 2}", k // 2) for k in range(9)}
    assert all(M.fold(r["leaf"], r["path"]) == r["root"] for r in found)
    assert all(r["size"] == int(r["name"][2:]) for r in found)


def test_nothing(spark):
    assert M.tampering(cases.nothing(spark)).count() == 0

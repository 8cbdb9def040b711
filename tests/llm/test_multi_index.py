import cases
import numpy as np

from spark_climbs.llm import multi_index as X

SCHEMA = "vec_id long, embedding array<float>, label int, key long, n long"


def plain(rows):
    fine = [k for k, (_, e) in enumerate(rows) if e is not None and len(e) == 8 and None not in e and np.isfinite(e).all() and np.any(e)]
    unit = {k: np.array(rows[k][1], dtype=np.float32).astype(float) for k in fine}
    unit = {k: x / np.linalg.norm(x) for k, x in unit.items()}
    near = lambda a, b: a in unit and b in unit and unit[a] @ unit[b] >= 0.95
    label = cases.components(len(rows), near)
    low = {}
    for k, (v, _) in enumerate(rows):
        if v is not None:
            low[label[k]] = min(low.get(label[k], v), v)
    out = []
    for k, (v, _) in enumerate(rows):
        links = sum(near(k, b) for b in range(len(rows)) if b != k)
        out.append((v, links, low.get(label[k]), v is not None and v == low.get(label[k])))
    return out


def test_against_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = []
    for c in range(30):
        centre = rng.normal(size=8)
        for _ in range(rng.integers(1, 12)):
            rows.append((len(rows) * 3, (centre * rng.uniform(0.5, 3) + rng.normal(size=8) * 0.08).tolist()))
    rows += [(1000 + k, rows[0][1]) for k in range(5)] + [(1000, rows[0][1])]
    rows += [(2000, None), (2001, [0.0] * 8), (2002, [1.0, None] * 4), (2003, [float("nan")] * 8), (2004, [float("inf")] + [0.0] * 7), (2005, []), (2006, [1.0, 2.0]), (None, rows[0][1]), (None, None)]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA).repartition(3)
    got = [tuple(r) for r in X.near_duplicates(df).collect()]
    assert sorted(got, key=repr) == sorted(plain(rows), key=repr)


def test_split_cells_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(k, (np.ones(8) + rng.normal(size=8) * 0.05).tolist()) for k in range(60)] + [(100 + k, rng.normal(size=8).tolist()) for k in range(20)]
    monkeypatch.setattr(X, "PART", 7)
    got = [tuple(r) for r in X.near_duplicates(spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA)).collect()]
    assert sorted(got, key=repr) == sorted(plain(rows), key=repr)


def test_multi_sequence_gives_the_nearest_cells():
    rng = np.random.default_rng(7)
    for _ in range(50):
        a, b = rng.random(rng.integers(1, 9)), rng.random(rng.integers(1, 9))
        n = int(rng.integers(1, len(a) * len(b) + 1))
        sums = (a[:, None] + b).ravel()
        got = X.multi_sequence(a, b, n)
        assert len(set(got)) == n and np.allclose(sums[got], np.sort(sums)[:n])


def test_recall_on_the_given_table(spark):
    d = "/root/testdata/sf0.1/embeddings.parquet"
    found = X.near_duplicates(spark.read.parquet(d)).toPandas()
    rows = spark.read.parquet(d).select("vec_id", "embedding").toPandas()
    x = X.unit(np.stack(rows["embedding"].to_numpy()).astype(float))
    links = sum(int((x[k : k + 500] @ x.T >= 0.95).sum()) for k in range(0, len(x), 500)) - len(x)
    assert links * 0.9 <= found["n_links"].sum() <= links


def test_nothing(spark):
    assert X.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    only = spark.createDataFrame([(1, None, 1, 1, 1)], SCHEMA)
    assert [tuple(r) for r in X.near_duplicates(only).collect()] == [(1, 0, 1, True)]


def test_a_link_found_from_one_side_counts_for_both(spark, monkeypatch):
    monkeypatch.setattr(X, "RECALL", 0.0, raising=False)
    monkeypatch.setattr(X, "MIN_VISITS", 1)
    monkeypatch.setattr(X.Index, "learn", lambda *_: None, raising=False)
    rng = np.random.default_rng(8)
    rows = []
    for c in range(150):
        centre = rng.normal(size=8)
        rows += [(len(rows), centre.tolist()), (len(rows) + 1, (centre + rng.normal(size=8) * 0.1 * np.linalg.norm(centre)).tolist())]
    far = lambda p: (np.abs(p[..., 1]) * 1e4).astype(int) % 2 == 0

    # some vectors visit every cell and the others their own: many links are found from one side
    def visited(self, points):
        d1, d2 = self._distances(points)
        every = len(self.first) * len(self.second)
        return [X.multi_sequence(x, y, every if far(p) else 1) for p, x, y in zip(points, d1, d2)]
    monkeypatch.setattr(X.Index, "visited", visited)
    found = X.near_duplicates(spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA)).collect()
    n = {r["vec_id"]: r["n_links"] for r in found}
    unit = X.unit(np.array([np.array(e, dtype=np.float32) for _, e in rows]).astype(float))
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    want = near & (far(unit)[:, None] | far(unit))
    assert all(n[k] >= want[k].sum() for k in n) and want.sum() > 50
    assert all(n[k] <= near[k].sum() for k in n)


def test_recall_of_pairs_outside_the_sample(spark, monkeypatch):
    monkeypatch.setattr(X, "SAMPLE", 100)
    rng = np.random.default_rng(9)
    x = X.unit(np.ones(32) / 32**0.5 + rng.normal(size=(3000, 32)) * 0.09)
    away = rng.normal(size=(3000, 32))
    away = X.unit(away - (away * x).sum(axis=1, keepdims=True) * x)
    rows = np.concatenate([x, 0.951 * x + (1 - 0.951**2) ** 0.5 * away]).astype(np.float32)
    df = spark.createDataFrame([(k, e.tolist(), 1, 2, 3) for k, e in enumerate(rows)], SCHEMA)
    exact = X.unit(rows.astype(float))
    links = (exact @ exact.T >= 0.95).sum(axis=1) - 1
    found = X.near_duplicates(df).toPandas().set_index("vec_id")["n_links"].sort_index().to_numpy()
    assert (found <= links).all() and links.sum() >= 6000 and found.sum() >= 0.9 * links.sum()

"""Near-duplicate vectors through an inverted multi-index.

Vectors are scaled to length one and cut into two halves. Each half has its own codebook,
fitted by k-means on a bounded sample; the pairs of codewords make a grid of cells, and
every vector is listed in its cell. A query visits cells from the nearest on, by the
multi-sequence order (the sums of both halves' distances, ascending). How far it must go is
learnt from a sample of queries compared with all rows: the highest rank of a cell that
holds a true partner, and a high rank of planted ones for tables with few. Visited cells' vectors are verified by their cosine in double precision.

A cell is verified in blocks, a product of queries and listed vectors at a time; it gives
for each query the number of links and the smallest partner, for each listed vector the
number of links that it does not find as a query itself, and links of a spanning forest,
but no list of pairs. Equal vectors are one entry with a count. Large cells are
split: their listed vectors are dealt to parts, and each query visits every part. The
number of parts follows from the cell's count, so none grows with the data.

Bounds: codebooks and queries of the sample are at most ``SAMPLE`` vectors (chosen by hash),
which each task compares with its rows in blocks; they
and the table of split cells (at most ``CELLS``) are all that leaves the tasks.

Defined results: vectors that are null, empty, zero, of another length than most, or with
null or non-finite components link with nothing and are their own component; a null
vec_id takes part without naming a component; equal rows link with each other; other
columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spark_climbs.materialize import materialize
from spark_climbs.operators.graph import components

COSINE = 0.95
#: Codewords of each half, and the sample they are fitted on.
CODEWORDS, SAMPLE, ROUNDS = 64, 4000, 12
CELLS = CODEWORDS * CODEWORDS
#: Cells visited at least, and the share of partners planted at the least cosine to reach.
MIN_VISITS, PLANTED = 4, 0.99
#: Listed vectors of a part of a cell.
PART = 500
#: Queries compared at a time.
BLOCK = 512


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def kmeans(points: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Codewords by Lloyd's rounds from evenly spread points of the sample, in the order
    of their first coordinate."""
    order = np.lexsort(points.T[::-1])
    centres = points[order[np.linspace(0, len(points) - 1, min(k, len(points))).astype(int)]].copy()
    for _ in range(rounds):
        own = distances(points, centres).argmin(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        n = np.bincount(own, minlength=len(centres))
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((points**2).sum(1)[:, None] - 2 * points @ centres.T + (centres**2).sum(1), 0)


def multi_sequence(first: np.ndarray, second: np.ndarray, n: int) -> list[int]:
    """The ``n`` cells with the smallest sums of both distances, nearest first: a heap over
    the grid of both sorted lists, where a cell enters once its left and lower
    neighbours have left."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    heap, out = [(first[a[0]] + second[b[0]], 0, 0)], []
    done = np.zeros(len(a), dtype=np.int64)
    while heap and len(out) < n:
        _, i, j = heapq.heappop(heap)
        out.append(int(a[i]) * len(second) + int(b[j]))
        done[i] = j + 1
        if i + 1 < len(a) and (done[i + 1] == j):
            heapq.heappush(heap, (first[a[i + 1]] + second[b[j]], i + 1, j))
        if j + 1 < len(b) and (i == 0 or done[i - 1] >= j + 2):
            heapq.heappush(heap, (first[a[i]] + second[b[j + 1]], i, j + 1))
    return out


class Index:
    """Codebooks of both halves and the number of cells to visit."""

    def __init__(self, sample: np.ndarray):
        half = sample.shape[1] // 2
        self.half = half
        self.first, self.second = kmeans(sample[:, :half], CODEWORDS), kmeans(sample[:, half:], CODEWORDS)
        self.visits = min(MIN_VISITS, len(self.first) * len(self.second))

    def ranks(self, points: np.ndarray) -> np.ndarray:
        """For every point, the visits it takes to reach each cell."""
        d1, d2 = self._distances(points)
        grid = (d1[:, :, None] + d2[:, None, :]).reshape(len(points), -1)
        return np.stack([np.searchsorted(np.sort(g), g, side="right") for g in grid]).astype(np.int32)

    def learn(self, rows: DataFrame, keys: np.ndarray, sample: np.ndarray) -> None:
        """Visits that reach every partner that the sampled vectors have among all rows, and
        most of the partners set at the least cosine from them in random directions."""
        rng = np.random.default_rng(1)
        away = rng.normal(size=sample.shape)
        away = unit(away - (away * sample).sum(axis=1, keepdims=True) * sample)
        planted = self.cells(COSINE * sample + (1 - COSINE**2) ** 0.5 * away)
        found = [self.ranks(sample[k : k + BLOCK])[np.arange(len(sample[k : k + BLOCK])), planted[k : k + BLOCK]] for k in range(0, len(sample), BLOCK)]
        least = int(np.quantile(np.concatenate(found), PLANTED, method="higher"))
        highest = rows.select("key", "embedding").mapInArrow(_partner_ranks(self, keys, sample), "rank int").agg(F.max("rank")).first()[0]
        self.visits = max(self.visits, least, highest or 0)

    def _distances(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return distances(points[:, : self.half], self.first), distances(points[:, self.half :], self.second)

    def cells(self, points: np.ndarray) -> np.ndarray:
        d1, d2 = self._distances(points)
        return d1.argmin(axis=1) * len(self.second) + d2.argmin(axis=1)

    def visited(self, points: np.ndarray) -> list[list[int]]:
        d1, d2 = self._distances(points)
        return [multi_sequence(x, y, self.visits) for x, y in zip(d1, d2)]


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def _partner_ranks(index: Index, keys: np.ndarray, sample: np.ndarray):
    """The highest rank of a cell of the rows that holds a partner of a sampled vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most, ranks, known = 0, None, np.zeros(len(sample), dtype=bool)
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                points = unit(_matrix(part.column("embedding"), sample.shape[1]))
                near = (sample @ points.T >= COSINE) & (keys[:, None] != part.column("key").to_numpy())
                rows = np.flatnonzero(near.any(axis=1))
                if not len(rows):
                    continue
                if ranks is None:
                    ranks = np.zeros((len(sample), len(index.first) * len(index.second)), dtype=np.int32)
                new = rows[~known[rows]]
                for k in range(0, len(new), BLOCK):
                    ranks[new[k : k + BLOCK]] = index.ranks(sample[new[k : k + BLOCK]])
                known[new] = True
                at, column = np.nonzero(near)
                most = max(most, int(ranks[at, index.cells(points)[column]].max()))
        yield pa.RecordBatch.from_arrays([pa.array([most], pa.int32())], ["rank"])

    return run


def _listing(index: Index, size: int, parts: dict[int, int]):
    """Each vector listed in (a part of) its cell, with the cells that it visits, and as a
    query in those."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            points = unit(_matrix(batch.column("embedding"), size))
            cells, visited = index.cells(points), index.visited(points)
            keys = batch.column("key").to_numpy()
            at, cell, part, query, visits = [], [], [], [], []
            for k, own in enumerate(visited):
                at.append(k)
                cell.append(int(cells[k]))
                part.append(int(keys[k]) % parts.get(int(cells[k]), 1))
                query.append(False)
                visits.append(own)
                for c in own:
                    for p in range(parts.get(c, 1)):
                        at.append(k)
                        cell.append(c)
                        part.append(p)
                        query.append(True)
                        visits.append(None)
            take = pa.array(at)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell, pa.int32()), pa.array(part, pa.int32()), pa.array(query), batch.column("key").take(take), batch.column("n").take(take), pa.array(cells.astype(np.int32)).take(take), pa.array(visits, pa.list_(pa.int32())), batch.column("embedding").take(take)],
                ["cell", "part", "query", "key", "n", "home", "visits", "embedding"],
            )

    return run


def _smallest(near: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Of every row and column, the smallest key it is connected with through ``near``."""
    most = np.iinfo(np.int64).max
    while True:
        left = np.minimum(rows, np.where(near, columns, most).min(axis=1))
        right = np.minimum(columns, np.where(near, left[:, None], most).min(axis=0))
        if (left == rows).all() and (right == columns).all():
            return np.concatenate([left, right])
        rows, columns = left, right


def _verified(size: int):
    """For the queries of each part: links with its listed vectors. A link counts for the
    query, and for the listed vector too if that does not visit the query's cell."""

    def compare(listed: list, queries: np.ndarray, keys: np.ndarray, weights: np.ndarray, homes: np.ndarray):
        own_keys, own_n, own = (np.concatenate([x[k] for x in listed]) for k in range(3))
        own_visits = [v for x in listed for v in x[3]]
        for start in range(0, len(queries), BLOCK):
            part, names = queries[start : start + BLOCK], keys[start : start + BLOCK]
            near = (part @ own.T >= COSINE) & (names[:, None] != own_keys)
            found = near @ own_n
            some = np.flatnonzero(found)
            if not len(some):
                continue
            back = np.flatnonzero(near.any(axis=0))
            linked = near[np.ix_(some, back)]
            u = np.concatenate([names[some], own_keys[back]])
            v = _smallest(linked, names[some], own_keys[back])
            returned = np.zeros((len(back), CELLS), dtype=bool)
            for k, b in enumerate(back):
                returned[k, own_visits[b]] = True
            unseen = linked & ~returned[:, homes[start : start + BLOCK][some]].T
            n = np.concatenate([found[some], weights[start : start + BLOCK][some] @ unseen])
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(n)], ["u", "v", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, listed = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            cell, part = (batch.column(c).to_numpy().astype(np.int64) for c in ("cell", "part"))
            query = batch.column("query").to_numpy(zero_copy_only=False)
            group = (cell << 32 | part) * 2 + query
            points = unit(_matrix(batch.column("embedding"), size))
            keys, n, home = (batch.column(c).to_numpy() for c in ("key", "n", "home"))
            cuts = np.flatnonzero(np.diff(group)) + 1
            for start, end in zip(np.r_[0, cuts], np.r_[cuts, len(group)]):
                place, is_query = group[start] // 2, bool(query[start])
                if place != now:
                    now, listed = place, []
                if not is_query:
                    visits = batch.column("visits").slice(start, end - start).to_pylist()
                    listed.append((keys[start:end], n[start:end], points[start:end], visits))
                elif listed:
                    yield from compare(listed, points[start:end], keys[start:end], n[start:end], home[start:end])

    return run


def near_duplicates(embeddings: DataFrame) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every vector."""
    rows = embeddings.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding"))
    fine = F.col("embedding").isNotNull() & F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    ) & F.exists("embedding", lambda x: x != 0)
    rows = materialize(rows.withColumn("fine", F.coalesce(fine, F.lit(False))), "vectors")
    sound = rows.filter("fine")
    usual = sound.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), "size").first()
    alone = rows.filter(~F.col("fine"))
    lone = lambda df: df.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    if usual is None:
        return _kept(lone(alone))
    size = usual["size"]
    odd = sound.filter(F.size("embedding") != size)
    distinct = (
        sound.filter(F.size("embedding") == size)
        .groupBy("embedding")
        .agg(F.min("vec_id").alias("low"), F.count("*").alias("n"))
        .withColumn("key", F.xxhash64("embedding"))
    )
    distinct = materialize(distinct, "distinct_vectors")
    sample = distinct.orderBy(F.xxhash64("key"), "key").limit(SAMPLE).select("key", "embedding").toPandas()
    points = unit(np.stack(sample["embedding"].to_numpy()).astype(np.float64))
    index = Index(points)
    index.learn(distinct, sample["key"].to_numpy(), points)
    schema = "cell int, part int, query boolean, key long, n long, home int, visits array<int>, embedding array<double>"
    counts = distinct.select("embedding").mapInArrow(_cell_of(index, size), "cell int").groupBy("cell").count()
    parts = {r["cell"]: -(-r["count"] // PART) for r in counts.filter(F.col("count") > PART).collect()}
    listed = distinct.select("key", "n", "embedding").mapInArrow(_listing(index, size, parts), schema)
    dealt = listed.repartition("cell", "part").sortWithinPartitions("cell", "part", "query")
    links = materialize(dealt.mapInArrow(_verified(size), "u long, v long, n long"), "vector_links")
    n_links = links.groupBy(F.col("u").alias("key")).agg(F.sum("n").alias("found"))
    found = components(links.select("u", "v"))
    classed = (
        distinct.select("key", "low", "n")
        .join(n_links, "key", "left")
        .join(found.select(F.col("vertex").alias("key"), "component"), "key", "left")
        .select("key", "low", (F.coalesce("found", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "key").alias("component"))
    )
    least = classed.groupBy("component").agg(F.min("low").alias("component_id"))
    named = classed.join(least, "component").select("key", "n_links", "component_id")
    linked = (
        sound.filter(F.size("embedding") == size)
        .select("vec_id", F.xxhash64("embedding").alias("key"))
        .join(named, "key")
        .select("vec_id", "n_links", "component_id")
    )
    return _kept(linked.unionByName(lone(alone)).unionByName(lone(odd)))


def _cell_of(index: Index, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cells = index.cells(unit(_matrix(batch.column("embedding"), size)))
                yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32))], ["cell"])

    return run


def _kept(rows: DataFrame) -> DataFrame:
    own = F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))
    return rows.select("vec_id", "n_links", "component_id", own.alias("kept"))

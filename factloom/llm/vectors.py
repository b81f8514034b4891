"""Vector search: approximate neighbours with an adaptive dimension scan, and exact top-k by branch and bound.

Both deal candidates into cells, each vector to one cell, and send each query to the cells that it asks. A task holds the
candidates of one cell and streams the queries past them, so that its memory is bounded by the cell, and only queries
are copied: one for each cell asked, which are fewer the larger cells are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Candidates of a cell, at most on average: what a task holds.
CANDIDATES = 1 << 17


def usable(embedding: Column, nonzero: bool) -> Column:
    """True for vectors that are not null and hold finite components only; ``nonzero`` asks for one that isn't 0."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ok = embedding.isNotNull() & (F.size(embedding) > 0) & finite
    return F.coalesce(ok & F.exists(embedding, lambda x: x != 0) if nonzero else ok, F.lit(False))


def prepared(vectors: DataFrame, nonzero: bool, id_col: str = "vec_id", vector_col: str = "embedding") -> list[tuple[DataFrame, int, int]]:
    """Usable rows (vec_id, v) for each number of dimensions, with their number and that of dimensions."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("v"), nonzero))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy("d").collect()
    return [(rows.where(F.size("v") == r["d"]), r["count"], r["d"]) for r in sizes]


def _one_each(queries: DataFrame) -> DataFrame:
    """Repeated query ids count once, with the least of their vectors."""
    return queries.groupBy("vec_id").agg(F.min("v").alias("v"))


def _matrix(column: pa.ListArray, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype("f8").reshape(-1, dims)


def _best(found: list[DataFrame], k: int, order: list[Column], schema: str, vectors: DataFrame) -> DataFrame:
    if not found:
        return vectors.sparkSession.createDataFrame([], schema)
    ranked = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _parts(n: int, spark) -> int:
    """Cells for n candidates: as many as cores there are, while that leaves thousands of candidates in each, and as their size asks."""
    return max(1, -(-n // CANDIDATES), min(spark.sparkContext.defaultParallelism, -(-n // 4096)))


def _stream(candidates: DataFrame, queries: DataFrame, dims: int, hold: Callable, score: str) -> DataFrame:
    """Columns query_id, vec_id and score: ``hold(matrix, ids)`` takes a cell's candidates, and gives what finds, for a batch of
    queries and what is known to bound each, arrays of these columns. Both sides are (cell, vec_id, v), queries may have a
    ``bound``; in a cell, candidates come first."""
    bound = F.col("bound") if "bound" in queries.columns else F.lit(float("inf"))
    both = candidates.select("cell", F.lit(0).alias("side"), "vec_id", "v", F.lit(0.0).alias("bound")).unionAll(queries.select("cell", F.lit(1).alias("side"), "vec_id", "v", bound))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, parts, find = None, [], None
        for batch in batches:
            cells, sides, ids = (batch.column(i).to_numpy() for i in range(3))
            marks = np.flatnonzero((np.diff(cells) != 0) | (np.diff(sides) != 0)) + 1
            for a, b in zip([0, *marks.tolist()], [*marks.tolist(), len(cells)]):
                if a == b:
                    continue
                if cells[a] != held:
                    held, parts, find = cells[a], [], None
                rows = ids[a:b], _matrix(batch.column(3).slice(a, b - a), dims)
                if sides[a] == 0:
                    parts.append(rows)
                elif parts:
                    find = find or hold(np.concatenate([m for _, m in parts]), np.concatenate([i for i, _ in parts]))
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in find(rows[1], rows[0], batch.column(4).slice(a, b - a).to_numpy())], names=["query_id", "vec_id", "score"])

    return both.repartition("cell").sortWithinPartitions("cell", "side").mapInArrow(run, f"query_id long, vec_id long, score {score}")


def _columns(found: list[tuple[int, np.ndarray, np.ndarray]], kind: str) -> list[np.ndarray]:
    """One array for each column, from (query, ids, scores)."""
    sizes = [len(ids) for _, ids, _ in found]
    return [np.repeat(np.array([q for q, _, _ in found], "i8"), sizes), np.concatenate([np.zeros(0, "i8"), *[i for _, i, _ in found]]), np.concatenate([np.zeros(0, kind), *[x.astype(kind) for _, _, x in found]])]


# --- exact top-k -------------------------------------------------------------------------------------------------


def branch_and_bound(x: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int, block: int = 16) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query, ids and inner products of its ``k`` best of ``x`` (rows), ties to smaller ids, itself excluded.

    ``x`` is laid out by dimension. Inner products grow block by block of dimensions; after each, candidates whose
    partial sum and remaining mass (by Cauchy and Schwarz) can't reach the k-th best known are compacted away.
    The k-th best known starts from whole products of a few candidates. Sums of integers below 2^53 are exact.
    """
    yield from Vertical(x, ids, block).best(queries, query_ids, k)


class Vertical:
    """Candidates laid out by dimension, the heaviest first, with what mass is left after each block of dimensions."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, block: int = 16):
        self.ids, self.block = ids, block
        self.order = np.argsort(-(x**2).sum(axis=0), kind="stable")
        self.columns = np.ascontiguousarray(x.T[self.order])
        self.cuts = list(range(0, x.shape[1], block))
        self.rest = np.stack([np.sqrt((self.columns[c + block :] ** 2).sum(axis=0)) for c in self.cuts])

    def best(self, queries: np.ndarray, query_ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        ids, columns, block, queries = self.ids, self.columns, self.block, queries[:, self.order]
        n, cuts, rest = len(ids), self.cuts, self.rest
        first = min(n, max(4 * k, n // 32))
        for q, own in zip(queries, query_ids):
            seed = q @ columns[:, :first]
            seed = seed[ids[:first] != own]
            floor = np.partition(seed, -k)[-k] if len(seed) >= k else -np.inf
            alive, partial = np.flatnonzero(ids != own), None
            for c, left in zip(cuts, rest):
                # while most are alive, whole rows cost less than picking from them
                part = (q[c : c + block] @ columns[c : c + block])[alive] if 2 * len(alive) > n else q[c : c + block] @ columns[c : c + block, alive]
                partial = part if partial is None else partial + part
                mass = np.sqrt((q[c + block :] ** 2).sum())
                bound = partial + mass * left[alive] * (1 + 1e-9) + 1e-6
                keep = bound >= floor
                if not keep.all():
                    alive, partial = alive[keep], partial[keep]
            top = np.lexsort((ids[alive], -partial))[:k]
            yield int(own), ids[alive[top]], partial[top]


def exact_top_k(vectors: DataFrame, k: int = 20, query_every: int = 20, scale: float = 64.0) -> DataFrame:
    """Columns query_id, rank, vec_id and score: the ``k`` largest inner products of floor(scale * component).

    Queries are the rows whose id ``query_every`` divides, candidates all rows but those of the query's id, of the same
    number of dimensions. Candidates are dealt into cells of bounded size, past which all queries are streamed; each
    cell gives its k best of each query, and those are ranked. Ties go to the smaller vec_id. Rows with a null id, and
    vectors that are null, empty, or hold null or non-finite components take no part. Repeated query rows count once,
    repeated candidates each. Scores are exact below 2^53.
    """
    found = []
    for rows, n, dims in prepared(vectors, nonzero=False):
        parts = _parts(n, vectors.sparkSession)
        rows = rows.select("vec_id", F.transform("v", lambda x: F.floor(x * scale).cast("double")).alias("v"))
        own = rows.withColumn("cell", F.pmod(F.xxhash64("vec_id", "v"), F.lit(parts)))
        asked = _one_each(rows.where(F.col("vec_id") % query_every == 0)).withColumn("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))

        def hold(x: np.ndarray, ids: np.ndarray) -> Callable:
            laid = Vertical(x, ids)
            return lambda queries, query_ids, _: _columns([(q, i, np.rint(s)) for q, i, s in laid.best(queries, query_ids, k)], "i8")

        found.append(_stream(own, asked, dims, hold, "long"))
    return _best(found, k, [F.desc("score"), F.col("vec_id")], "query_id long, rank int, vec_id long, score long", vectors)


# --- approximate neighbours --------------------------------------------------------------------------------------


class Index:
    """Inverted lists: a random rotation, centroids in rotated space, and how many lists a query probes."""

    def __init__(self, sample: np.ndarray, n: int, seed: int = 7, lists: int | None = None, recall: float = 0.97):
        rng = np.random.default_rng(seed)
        dims = sample.shape[1]
        self.rotation = np.linalg.qr(rng.standard_normal((dims, dims)))[0]
        x = sample @ self.rotation
        lists = min(len(x), lists or int(max(1, np.sqrt(n) / 4)))
        self.centroids = x[rng.permutation(len(x))[:lists]]
        for _ in range(10):
            near = self.nearest(x, 1)[:, 0]
            for c in range(lists):
                if (near == c).any():
                    self.centroids[c] = x[near == c].mean(axis=0)
        self.probes = self._probes(x, rng, recall)

    def nearest(self, x: np.ndarray, k: int) -> np.ndarray:
        return np.concatenate([np.zeros((0, min(k, len(self.centroids))), int), *[np.argsort((self.centroids**2).sum(axis=1) - 2 * x[i : i + 4096] @ self.centroids.T, axis=1, kind="stable")[:, :k] for i in range(0, len(x), 4096)]])

    def _probes(self, x: np.ndarray, rng: np.random.Generator, recall: float, k: int = 10, tries: int = 200) -> int:
        """The fewest lists that hold the wanted share of the true neighbours of some rows of the sample."""
        near, lists = self.nearest(x, 1)[:, 0], len(self.centroids)
        at = np.empty((min(tries, len(x)), min(k, len(x) - 1)), dtype=int)
        for row, i in enumerate(rng.permutation(len(x))[:tries]):
            d = ((x - x[i]) ** 2).sum(axis=1)
            d[i] = np.inf
            order = self.nearest(x[i : i + 1], lists)[0]
            place = np.empty(lists, dtype=int)
            place[order] = np.arange(lists)
            at[row] = place[near[np.argsort(d, kind="stable")[: at.shape[1]]]]
        if not at.size:
            return lists
        return int(np.sort(at.ravel())[max(0, int(np.ceil(recall * at.size)) - 1)]) + 1


def adaptive_scan(x: np.ndarray, ids: np.ndarray, raw: np.ndarray, q: np.ndarray, raw_q: np.ndarray, own: int, k: int, tau: float = np.inf, block: int = 16, epsilon: float = 1.2, seen: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids and distances of about the ``k`` nearest rows in one list, by partial distances over blocks of dimensions.

    ``x`` (dimension by row) and ``q`` are rotated, so that a partial distance over d of D dimensions, times D / d,
    estimates the whole one with a deviation of about 1 / sqrt(d). After each block, a candidate is abandoned if the
    hypothesis that it is as near as the k-th known is rejected: its estimate exceeds that by 1 + epsilon / sqrt(d).
    ``tau`` is the square of a distance within which k others are known to lie; after the first block, whole
    distances of the most promising candidates tighten it. What rounding the rotation may add to a distance is allowed for, so
    that copies of the query's vector stay. The survivors' distances are computed anew on the original vectors. ``seen`` gets the number of dimensions computed and that of all.
    """
    dims, noise = len(q), 1e-18 * float(q @ q)
    alive = np.flatnonzero(ids != own)
    partial, count, all_ = np.zeros(len(alive)), 0, len(alive) * dims
    for c in range(0, dims, block):
        partial = partial + ((x[c : c + block, alive] - q[c : c + block, None]) ** 2).sum(axis=0)
        d = min(dims, c + block)
        count += len(alive) * (d - c)
        if c == 0 and d < dims and len(alive) > 16 * k:
            few = np.argpartition(partial, 2 * k)[: 2 * k]
            known = partial[few] + ((x[d:, alive[few]] - q[d:, None]) ** 2).sum(axis=0)
            count += len(few) * (dims - d)
            tau = min(tau, np.partition(known, k - 1)[k - 1])
        slack = 1 + 1e-9 if d == dims else (1 + epsilon / np.sqrt(d)) ** 2 * d / dims
        keep = np.flatnonzero(partial <= tau * slack + noise)
        if len(keep) < k:  # a list gives k, so that a query never has fewer
            keep = np.argpartition(partial, k - 1)[:k] if k < len(alive) else np.arange(len(alive))
        alive, partial = alive[keep], partial[keep]
    if seen is not None:
        seen.append((count, all_))
    if len(alive) > k:
        bar = np.partition(partial, k - 1)[k - 1] * (1 + 1e-9) + noise
        alive = alive[partial <= bar]
    score = np.sqrt(((raw[alive] - raw_q) ** 2).sum(axis=1))
    best = np.lexsort((ids[alive], score))[:k]
    return ids[alive[best]], score[best]


def nearest_neighbours(vectors: DataFrame, k: int = 10, query_every: int = 100, sample: int = 8192, lists: int | None = None, recall: float = 0.97) -> DataFrame:
    """Columns query_id, rank, vec_id and score: each query's ``k`` nearest found, by Euclidean distance.

    Queries are the rows whose id ``query_every`` divides, candidates all rows but those of the query's id, of the same
    number of dimensions. The index (rotation, centroids, lists probed) is fitted to about ``sample`` rows, or 16 for
    each list where that is more, those whose ids have the smallest checksums; lists are a quarter of the square root of
    the rows. Every row is put into its list. A list that is large, or full of copies of one vector, is cut into several
    cells, all of which its queries ask. ``recall`` is the share of true neighbours, measured on the sample, that the
    lists probed have to hold. The k-th nearest row of the sample is what a query knows when it comes to a list.

    Scores are in double precision on the original vectors; ties go to the smaller vec_id. Rows with a null id, and
    vectors that are null, empty, zero, or hold null or non-finite components take no part. Repeated query rows count
    once, repeated candidates each.
    """
    found = [_searched(rows, n, dims, k, query_every, max(sample, int(4 * np.sqrt(n))), lists, recall) for rows, n, dims in prepared(vectors, nonzero=True)]
    return _best(found, k, [F.col("score"), F.col("vec_id")], "query_id long, rank int, vec_id long, score double", vectors)


def _searched(rows: DataFrame, n: int, dims: int, k: int, query_every: int, sample: int, lists: int | None, recall: float) -> DataFrame:
    """What each query finds in the cells it asks, for ``n`` rows of ``dims`` dimensions."""
    bar = int(min(1.0, sample / n) * (1 << 32))
    few = rows.where(F.crc32(F.col("vec_id").cast("string").cast("binary")) <= bar).orderBy("vec_id", "v").limit(2 * sample).toPandas()
    if not len(few):
        few = rows.limit(sample).toPandas()
    index = Index(np.stack(few["v"].to_numpy()).astype("f8"), n, lists=lists, recall=recall)

    known, known_ids = np.stack(few["v"].to_numpy()).astype("f8"), few["vec_id"].to_numpy("i8")

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bounds = []
            for own, q in zip(batch.column(0).to_pylist(), _matrix(batch.column(1), dims)):
                d = ((known[known_ids != own] - q) ** 2).sum(axis=1)
                bounds.append(float(np.partition(d, k - 1)[k - 1]) * (1 + 1e-9) if len(d) >= k else float("inf"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bounds, pa.float64())], names=["vec_id", "v", "lists", "bound"])

    def place(count: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                near = index.nearest(_matrix(batch.column(1), dims) @ index.rotation, count)
                near = pa.ListArray.from_arrays(pa.array(np.arange(0, near.size + 1, max(1, near.shape[1]), dtype="i4")), pa.array(near.ravel().astype("i8")))
                yield pa.RecordBatch.from_arrays([*batch.columns, near], names=["vec_id", "v", "lists"])

        return run

    schema = "vec_id long, v array<double>, lists array<long>"
    placed = rows.mapInArrow(place(1), schema).select("vec_id", "v", F.get("lists", F.lit(0)).alias("list"))
    queries = _one_each(rows.where(F.col("vec_id") % query_every == 0))
    asked = queries.mapInArrow(place(index.probes), schema).mapInArrow(bounded, f"{schema}, bound double").select("vec_id", "v", "bound", F.explode("lists").alias("list"))
    # a list's share of the rows may be large, so its cells are counted; there are as many counts as lists
    sizes, usual = {r["list"]: r["count"] for r in placed.groupBy("list").count().collect()}, -(-2 * n // len(index.centroids))
    cells = [max(1, -(-sizes.get(i, 0) // min(CANDIDATES, usual))) for i in range(len(index.centroids))]
    first = np.cumsum([0, *cells])
    numbers = lambda values: F.split(F.lit(",".join(map(str, values))), ",").cast("array<long>")
    of = lambda values: F.get(numbers(values), F.col("list").cast("int"))
    own = placed.withColumn("cell", of(first[:-1]) + F.pmod(F.xxhash64("vec_id", "v"), of(cells)))
    asks = asked.withColumn("cell", F.explode(F.sequence(of(first[:-1]), of(first[1:]) - 1)))

    def hold(raw: np.ndarray, ids: np.ndarray) -> Callable:
        x = np.ascontiguousarray((raw @ index.rotation).T)

        def find(queries: np.ndarray, query_ids: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
            turned = queries @ index.rotation
            return _columns([(int(i), *adaptive_scan(x, ids, raw, q, own_q, i, k, tau)) for q, own_q, i, tau in zip(turned, queries, query_ids, bounds)], "f8")

        return find

    return _stream(own, asks, dims, hold, "double")

"""Hard-negative mining over an inverted multi-index.

Vectors are cut into two halves, each with a codebook; a vector's cell is its pair of nearest codewords. The inner
product of a query with any vector of a cell is at most the sum of two half bounds (half product with the codeword, plus
the query half's length times the codeword's radius), so a heap over the two sorted halves visits cells by falling bound
(multi-sequence), and a search ends as soon as no cell left can change what it has found. All results are exact.

Cells are laid out in parts of bounded size. A task holds one part and streams the anchors past it; an anchor asks the
parts whose bounds let them matter, judged by what it finds in a sample that is at hand everywhere.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.vectors import CANDIDATES, usable
from factloom.session import ensure_checkpoint_dir

#: Rows of the sample that codebooks and floors come from; codewords of a half, at most; rows scanned at once.
SAMPLE, WORDS, BATCH = 8192, 64, 512
OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def _upward(x: np.ndarray) -> np.ndarray:
    """Bounds with room for rounding."""
    return x + np.abs(x) * 1e-9 + 1e-6


class Codebooks:
    """Two codebooks over the halves of vectors, fitted by k-means to a sample."""

    def __init__(self, sample: np.ndarray, words: int, seed: int = 11):
        self.cut = sample.shape[1] // 2
        rng = np.random.default_rng(seed)
        self.words = [self._fit(half, words, rng) for half in self.halves(sample)]

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[:, : self.cut], x[:, self.cut :]

    @staticmethod
    def _nearest(x: np.ndarray, words: np.ndarray) -> np.ndarray:
        return np.argmin((words**2).sum(axis=1) - 2 * x @ words.T, axis=1) if len(x) else np.zeros(0, int)

    def _fit(self, x: np.ndarray, words: int, rng: np.random.Generator) -> np.ndarray:
        found = x[rng.permutation(len(x))[:words]].copy()
        for _ in range(8):
            near = self._nearest(x, found)
            for w in np.unique(near):
                found[w] = x[near == w].mean(axis=0)
        return found

    def places(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Codewords of both halves, and the distances from them."""
        near, far = [], []
        for half, words in zip(self.halves(x), self.words):
            near.append(self._nearest(half, words))
            far.append(np.sqrt(((half - words[near[-1]]) ** 2).sum(axis=1)))
        return near[0], near[1], far

    def products(self, q: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each half, the queries' products with the codewords and their lengths."""
        return [(half @ words.T, np.sqrt((half**2).sum(axis=1))) for half, words in zip(self.halves(q), self.words)]


class Cells:
    """Vectors of one part by cell, visited by falling bound."""

    def __init__(self, books: Codebooks, x: np.ndarray, ids: np.ndarray, labels: np.ndarray):
        first, second, far = books.places(x)
        order = np.lexsort((second, first))
        self.books, self.x, self.ids, self.labels = books, x[order], ids[order], labels[order]
        self.codes, self.radii = [], []
        for near, away in zip((first, second), far):
            codes = np.unique(near)
            radius = np.zeros(len(books.words[0]) if near is first else len(books.words[1]))
            np.maximum.at(radius, near, away)
            self.codes.append(codes)
            self.radii.append(radius[codes])
        key = first[order] * len(books.words[1]) + second[order]
        at = np.flatnonzero(np.diff(key, prepend=-1))
        self.rows = {int(k): (int(a), int(b)) for k, a, b in zip(key[at], at, [*at[1:].tolist(), len(key)])}

    def walk(self, q: np.ndarray, ceiling: float = np.inf) -> Iterator[tuple[np.ndarray, float]]:
        """Numbers of rows in batches, by falling bound of their cells, each with the bound of all that is left. Cells whose
        every product is over ``ceiling`` are left out."""
        tops, lows, codes = [], [], []
        for (product, length), own, radius in zip(self.books.products(q[None]), self.codes, self.radii):
            middle, reach = product[0, own], length[0] * radius
            order = np.argsort(-(middle + reach), kind="stable")
            tops.append((middle + reach)[order].tolist()), lows.append((middle - reach)[order].tolist()), codes.append(own[order].tolist())
        wide, found, size = len(self.books.words[1]), [], 0
        heap, seen = [(-(tops[0][0] + tops[1][0]), 0, 0)], {(0, 0)}
        while heap:
            _, i, j = heapq.heappop(heap)
            span = self.rows.get(codes[0][i] * wide + codes[1][j])
            if span and lows[0][i] + lows[1][j] <= ceiling:
                found.append(np.arange(*span))
                size += span[1] - span[0]
            for a, b in ((i + 1, j), (i, j + 1)):
                if a < len(tops[0]) and b < len(tops[1]) and (a, b) not in seen:
                    seen.add((a, b))
                    heapq.heappush(heap, (-(tops[0][a] + tops[1][b]), a, b))
            if size >= BATCH or not heap:
                yield np.concatenate([np.zeros(0, int), *found]), float(_upward(np.float64(-heap[0][0]))) if heap else -np.inf
                found, size = [], 0

    def best(self, q: np.ndarray, own: int, other: int | None, windows: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each window (floor, ceiling), ids and products of its ``k`` best rows, ties to smaller ids; never rows of the id
        ``own`` nor of the label ``other``. A window is certified once no cell left reaches its k-th best, or its floor."""
        none = np.zeros(0, "i8")
        found, needs = [(none, none) for _ in windows], windows[:, 0].copy()
        for rows, left in self.walk(q, windows[:, 1].max()):
            score, ids = np.rint(self.x[rows] @ q).astype("i8"), self.ids[rows]
            fits = (ids != own) if other is None else (ids != own) & (self.labels[rows] != other)
            for w, (_, high) in enumerate(windows):
                keep = fits & (score >= needs[w]) & (score <= high)
                if keep.any():
                    i, s = np.concatenate([found[w][0], ids[keep]]), np.concatenate([found[w][1], score[keep]])
                    top = np.lexsort((i, -s))[:k]
                    found[w] = i[top], s[top]
                    if len(top) == k:
                        needs[w] = max(needs[w], s[top[-1]])
            if left < needs.min():
                break
        return found


class Parts:
    """Where cells lie, how far they reach, and a sample of rows: what an anchor needs to choose the parts it asks."""

    def __init__(self, books: Codebooks, cells: list, target: int, sample: np.ndarray, ids: np.ndarray, labels: np.ndarray):
        self.books, self.sample, self.ids, self.labels = books, sample, ids, labels
        self.first, self.second = (np.array([c[i] for c in cells]) for i in (0, 1))
        self.radii = [np.array([c[i] for c in cells]) for i in (3, 4)]
        at, room, self.start, self.cuts = -1, 0, [], []
        for c in cells:  # small cells share a part, a large one is cut into several
            cuts = -(-c[2] // target)
            if cuts > 1:
                self.start.append(at + 1)
                at, room = at + cuts, 0
            else:
                if c[2] > room:
                    at, room = at + 1, target
                self.start.append(at)
                room -= c[2]
            self.cuts.append(cuts)
        self.count = at + 1

    def asked(self, q: np.ndarray, windows: np.ndarray) -> np.ndarray:
        """Parts with a cell whose products may lie in a window, all of which hold for the one query ``q``."""
        (a, la), (b, lb) = self.books.products(q[None])
        middle = a[0, self.first] + b[0, self.second]
        reach = _upward(la[0] * self.radii[0] + lb[0] * self.radii[1] + np.abs(middle) * 1e-9)
        near = np.zeros(len(middle), bool)
        for low, high in windows:
            near |= (middle + reach >= low) & (middle - reach <= high)
        return np.unique(np.concatenate([np.zeros(0, int), *[np.arange(self.start[c], self.start[c] + self.cuts[c]) for c in np.flatnonzero(near)]]))

    def floors(self, q: np.ndarray, own: int, fits: np.ndarray, windows: np.ndarray, k: int) -> np.ndarray:
        """The windows, raised to the k-th best product that the sample has in them."""
        score, out = np.rint(self.sample @ q), windows.astype("f8").copy()
        score = score[fits & (self.ids != own)]
        for w, (low, high) in enumerate(windows):
            inside = score[(score >= low) & (score <= high)]
            if len(inside) >= k:
                out[w, 0] = np.partition(inside, -k)[-k]
        return out


def _routed(queries: DataFrame, parts: Parts, k: int, same: bool) -> DataFrame:
    """Anchors (vec_id, label, v, windows) once for each part they ask, with raised floors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked, raised = [], []
            for own, label, v, flat in zip(*(batch.column(i).to_pylist() for i in range(4))):
                q = np.array(v, "f8")
                windows = parts.floors(q, own, (parts.labels == label) if same else (parts.labels != label), np.array(flat, "f8").reshape(-1, 2), k)
                asked.append(parts.asked(q, windows).tolist()), raised.append(windows.ravel().tolist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(raised, pa.list_(pa.float64())), pa.array(asked, pa.list_(pa.int64()))], names=["vec_id", "label", "v", "windows", "parts"])

    routed = queries.mapInArrow(run, "vec_id long, label long, v array<double>, windows array<double>, parts array<long>")
    return routed.select(F.explode("parts").alias("part"), "vec_id", "label", "v", "windows")


def _search(placed: DataFrame, queries: DataFrame, books: Codebooks, dims: int, k: int, same: bool) -> DataFrame:
    """Columns anchor_id, slot, vec_id and score: what each part finds for the anchors that ask it, in each of their windows.
    ``same`` looks among the anchor's label, else among the others."""
    sides = [placed.select("part", F.lit(0).alias("side"), "vec_id", "label", "v", F.lit(None).cast("array<double>").alias("windows")), queries.select("part", F.lit(1).alias("side"), "vec_id", "label", "v", "windows")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, index = None, [], None
        for batch in batches:
            numbers, sides, ids, labels = (batch.column(i).to_numpy() for i in range(4))
            marks = np.flatnonzero((np.diff(numbers) != 0) | (np.diff(sides) != 0)) + 1
            for a, b in zip([0, *marks.tolist()], [*marks.tolist(), len(numbers)]):
                if a == b:
                    continue
                if numbers[a] != part:
                    part, held, index = numbers[a], [], None
                x = batch.column(4).slice(a, b - a).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
                if sides[a] == 0:
                    held.append((x, ids[a:b], labels[a:b]))
                elif held:
                    index = index or _indexed(books, *(np.concatenate(c) for c in zip(*held)), same)
                    out = [[], [], [], []]
                    for q, own, label, flat in zip(x, ids[a:b].tolist(), labels[a:b].tolist(), batch.column(5).slice(a, b - a).to_pylist()):
                        if (cells := index(label)) is None:
                            continue
                        for slot, (found, score) in enumerate(cells.best(q, own, None if same else label, np.array(flat).reshape(-1, 2), k)):
                            for column, values in zip(out, (np.full(len(found), own), np.full(len(found), slot), found, score)):
                                column.append(values)
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, "i8"), *c]).astype("i8")) for c in out], names=["anchor_id", "slot", "vec_id", "score"])

    both = reduce(DataFrame.unionAll, sides).repartition("part").sortWithinPartitions("part", "side")
    return both.mapInArrow(run, "anchor_id long, slot long, vec_id long, score long")


def _indexed(books: Codebooks, x: np.ndarray, ids: np.ndarray, labels: np.ndarray, by_label: bool) -> Callable[[int], Cells | None]:
    """The cells that an anchor of a label looks through: those of its label alone, or all."""
    if not by_label:
        whole = Cells(books, x, ids, labels)
        return lambda label: whole
    order = np.argsort(labels, kind="stable")
    at = np.flatnonzero(np.diff(labels[order], prepend=labels.min() - 1))
    runs = {int(labels[order[a]]): order[a:b] for a, b in zip(at, [*at[1:].tolist(), len(order)])}
    known = {label: Cells(books, x[i], ids[i], labels[i]) for label, i in runs.items()}
    return known.get


def hard_negatives(vectors: DataFrame, anchor_every: int = 100, positives: int = 5, negatives: int = 10, window: tuple[int, int] = (30, 90), scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Columns anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    Anchors are the rows whose id ``anchor_every`` divides. A score is the inner product of floor(scale * component);
    higher scores come first, ties go to the smaller id. An anchor's positives are its ``positives`` first rows of its
    label, and each positive's negatives are the ``negatives`` first rows of other labels whose scores lie between
    ``window`` percent of the positive's. All rows are candidates; none is capped or sampled away.

    Rows with a null id or label, and vectors that are null, empty, or hold null or non-finite components take no part;
    vectors of different lengths never meet. Repeated anchors count once, with the least of their vectors and labels;
    repeated candidates each; no row of the anchor's own id is a positive or a negative. Scores are exact below 2^53. An
    anchor without positives, and a positive without negatives, give no rows; nor does an empty table.
    """
    ensure_checkpoint_dir(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("v"), False))
    rows = rows.select("vec_id", "label", F.transform("v", lambda x: F.floor(x * scale).cast("double")).alias("v"))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy("d").collect()
    found = [_mined(rows.where(F.size("v") == r["d"]), r["count"], r["d"], anchor_every, positives, negatives, window) for r in sizes]
    return reduce(DataFrame.unionByName, found) if found else vectors.sparkSession.createDataFrame([], OUT)


def _first(found: DataFrame, k: int, *keys: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _mined(rows: DataFrame, n: int, dims: int, every: int, positives: int, negatives: int, window: tuple[int, int]) -> DataFrame:
    spark = rows.sparkSession
    bar = int(min(1.0, SAMPLE / n) * (1 << 32))
    few = rows.where(F.crc32(F.col("vec_id").cast("string").cast("binary")) <= bar).orderBy("vec_id", "label", "v").limit(2 * SAMPLE).toPandas()
    few = few if len(few) else rows.limit(SAMPLE).toPandas()
    sample = np.stack(few["v"].to_numpy()).astype("f8")
    books = Codebooks(sample, max(1, min(WORDS, int(np.sqrt(n / 64)))))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, second, far = books.places(batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims))
            columns = [pa.array(c.astype("i8")) for c in (first, second)] + [pa.array(f) for f in far]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=["vec_id", "label", "v", "i", "j", "far_i", "far_j"])

    coded = rows.mapInArrow(place, "vec_id long, label long, v array<double>, i long, j long, far_i double, far_j double")
    # at most WORDS squared cells
    cells = coded.groupBy("i", "j").agg(F.count(F.lit(1)).alias("n"), F.max("far_i").alias("far_i"), F.max("far_j").alias("far_j")).orderBy("i", "j").collect()
    target = min(CANDIDATES, max(4096, -(-n // spark.sparkContext.defaultParallelism)))
    parts = Parts(books, cells, target, sample, few["vec_id"].to_numpy("i8"), few["label"].to_numpy("i8"))
    cell = {(r["i"], r["j"]): c for c, r in enumerate(cells)}
    flat = [cell.get((i, j), 0) for i in range(len(books.words[0])) for j in range(len(books.words[1]))]
    at = (F.col("i") * len(books.words[1]) + F.col("j")).cast("int")
    of: Callable[[list[int]], Column] = lambda values: F.get(F.split(F.lit(",".join(str(values[c]) for c in flat)), ",").cast("array<long>"), at)
    placed = coded.select("vec_id", "label", "v", (of(parts.start) + F.pmod(F.xxhash64("vec_id", "v"), of(parts.cuts))).alias("part"))

    anchors = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("v", "label")).alias("one")).select("vec_id", "one.label", "one.v")
    open_window = F.array(F.lit(float("-inf")), F.lit(float("inf")))
    near = _search(placed, _routed(anchors.select("*", open_window.alias("windows")), parts, positives, True), books, dims, positives, True)
    near = _first(near, positives, "anchor_id").select("anchor_id", "rank", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")).checkpoint()

    # whole scores s with 30 p <= 100 s <= 90 p, in whole numbers; none where p is negative
    low = lambda p: F.when(p >= 0, F.call_function("div", p * window[0] + 99, F.lit(100)).cast("double")).otherwise(float("inf"))
    high = lambda p: F.when(p >= 0, F.call_function("div", p * window[1], F.lit(100)).cast("double")).otherwise(float("-inf"))
    scores = F.transform(F.array_sort(F.collect_list(F.struct("rank", "positive_score"))), lambda p: p["positive_score"])
    asked = near.groupBy(F.col("anchor_id").alias("vec_id")).agg(scores.alias("scores")).join(anchors, "vec_id")
    bounds = F.flatten(F.transform("scores", lambda p: F.array(low(p), high(p))))
    far = _search(placed, _routed(asked.select("vec_id", "label", "v", bounds.alias("windows")), parts, negatives, False), books, dims, negatives, False)
    far = _first(far, negatives, "anchor_id", "slot").select("anchor_id", (F.col("slot") + 1).cast("int").alias("slot"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return far.join(near.withColumnRenamed("rank", "slot"), ["anchor_id", "slot"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")

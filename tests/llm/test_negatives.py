"""Hard negatives against plain Python, and on awkward rows."""

import numpy as np
import pytest

from factloom.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, part string, score string, windows string"


def mined(rows, every, positives, negatives, window):
    rows = [(i, np.floor(np.array(v, "f4").astype("f8") * 256).astype("i8"), y) for i, v, y in rows if i is not None and y is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    anchors = {}
    for i, v, y in sorted(rows, key=lambda r: (r[0], r[1].tolist(), r[2])):
        if i % every == 0:
            anchors.setdefault((i, len(v)), (v, y))
    for (own, size), (q, label) in anchors.items():
        scored = sorted((-int(v @ q), i, y) for i, v, y in rows if i != own and len(v) == size)
        for s, i, _ in [r for r in scored if r[2] == label][:positives]:
            fits = [r for r in scored if r[2] != label and window[0] * -s <= 100 * -r[0] <= window[1] * -s][:negatives]
            out |= {(own, i, n, j, -s, -t) for n, (t, j, _) in enumerate(fits, 1)}
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, v, y, "clash", "clash", "clash") for i, v, y in rows], SCHEMA)


@pytest.mark.parametrize("seed, batch, sample", [(1, 512, 8192), (2, 4, 40), (3, 1, 8)])
def test_against_brute_force(spark, monkeypatch, seed, batch, sample):
    monkeypatch.setattr(negatives, "BATCH", batch)
    monkeypatch.setattr(negatives, "SAMPLE", sample)
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(6, 12))
    x = middles[rng.integers(0, 6, 900)] + rng.normal(size=(900, 12)) * 0.15
    x[:40] = x[0]  # ties
    rows = [(i, [float(a) for a in v], int(rng.integers(0, 4))) for i, v in enumerate(x)]
    got = [tuple(r) for r in negatives.hard_negatives(frame(spark, rows), anchor_every=30, positives=3, negatives=4, window=(30, 90)).collect()]
    assert len(got) == len(set(got)) and set(got) == mined(rows, 30, 3, 4, (30, 90)) and len(got) > 100


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5], 1), (1, [0.9, 0.5], 1), (2, [0.5, 0.4], 2), (3, [0.5, 0.4], 2), (4, None, 1), (5, [], 1), (6, [nan, 1.0], 1), (7, [inf, 1.0], 2), (8, [None, 1.0], 2), (9, [1.0, 1.0], None), (None, [1.0, 1.0], 1)]
    rows += [(10, [1.0, 1.0, 1.0], 1), (11, [0.9, 1.0, 1.0], 1), (12, [0.4, 0.4, 1.0], 3), (20, [0.0, 0.0], 1), (30, [-1.0, -0.5], 7), (0, [1.0, 0.5], 1), (1, [0.9, 0.5], 1), (40, [0.3], 5)]
    got = sorted(tuple(r) for r in negatives.hard_negatives(frame(spark, rows), anchor_every=10).collect())
    want = mined(rows, 10, 5, 10, (30, 90))
    assert set(got) == want and want
    assert negatives.hard_negatives(frame(spark, [])).collect() == []


def test_clustered_rows_are_hardly_scanned():
    """The heap ends early where cells are tight, and finds the same."""
    rng = np.random.default_rng(5)
    middles = rng.normal(size=(64, 16)) * 500
    x = np.rint(middles[rng.integers(0, 64, 20_000)] + rng.normal(size=(20_000, 16)) * 3)
    books = negatives.Codebooks(x[:4000], 32)
    ids, labels = np.arange(len(x)), np.arange(len(x)) % 3
    cells = negatives.Cells(books, x, ids, labels)
    seen, walk = [], cells.walk
    cells.walk = lambda q, ceiling: ((seen.append(len(rows)), (rows, left))[1] for rows, left in walk(q, ceiling))
    for own in range(0, 200, 20):
        score = (x @ x[own]).astype("i8")
        order = [i for i in np.lexsort((ids, -score)) if i != own and labels[i] != labels[own]][:10]
        (found, _), = cells.best(x[own], own, int(labels[own]), np.array([[-np.inf, np.inf]]), 10)
        assert found.tolist() == order
    assert sum(seen) < 0.25 * 10 * len(x)

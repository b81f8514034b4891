"""Quality by a factorisation machine over hashed words, structure statistics and metadata of whole texts.

The score is a bias, a weight for each feature, and the pairwise interactions of all features at low rank. The sum
over pairs is taken in linear time: half of (the square of the sum less the sum of squares), for each factor.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from factloom.llm.labelled import scored

#: Labelled rows that a model is fitted to, at most for each label; buckets of hashed words; factors.
SAMPLE, BUCKETS, RANK = 1500, 1024, 8
CACHE = 300_000
LETTERS = re.compile(r"[^\W\d_]")


def _shape(word: str) -> int:
    """A word's form: capitals, symbols or digits in it, or none, and whether it ends a sentence."""
    core = word.rstrip(".,!?;:")
    kind = 3 if core.isalpha() and core.isupper() and len(core) > 1 else 2 if any(not c.isalnum() for c in core) else 1 if any(c.isdigit() for c in core) else 0
    return 2 * kind + (word[-1:] in ".!?")


class Features:
    """Rows of features: hashed words (damped shares), then statistics between about 0 and 1."""

    STATISTICS = 26
    WIDTH = BUCKETS + STATISTICS

    def __init__(self):
        self.known: dict[str, int] = {}

    def _place(self, word: str) -> int:
        """Bucket of the word's lower-cased form, and its shape, in one number."""
        if (n := self.known.get(word)) is None:
            if len(self.known) > CACHE:
                self.known.clear()
            n = zlib.crc32(word.lower().encode()) % BUCKETS * 8 + _shape(word)
            if len(word) < 64:
                self.known[word] = n
        return n

    def row(self, text: str) -> np.ndarray:
        out = np.zeros(self.WIDTH, dtype="f4")
        words = text.split()
        n = len(words)
        if n:
            places = np.fromiter(map(self._place, words), dtype="i8", count=n)
            out[:BUCKETS] = np.sqrt(np.bincount(places >> 3, minlength=BUCKETS) / n)
            out[BUCKETS : BUCKETS + 8] = np.bincount(places & 7, minlength=8) / n
        s = out[BUCKETS + 8 :]
        chars, lines = max(1, len(text)), [x for x in text.split("\n") if x.strip()]
        distinct, pairs = len(set(words)), len(set(zip(words, words[1:])))
        s[0] = distinct / max(1, n)
        s[1] = pairs / max(1, n - 1)
        s[2] = len(set(lines)) / max(1, len(lines))
        s[3:9] = [min(1.0, 10 * text.count(c) / max(1, n)) for c in ("|", "!", "$", "#", "*", "&")]
        s[9] = min(1.0, chars / max(1, n) / 12)
        s[10] = min(1.0, n / max(1, len(lines)) / 200)
        s[11] = np.log1p(n) / 12
        s[12] = np.log1p(len(lines)) / 8
        s[13] = min(1.0, sum(map(text.count, ".?")) * 8 / max(1, n))
        s[14] = np.log1p(chars) / 14  # metadata: the text's own length stands for n_chars, which may be null or stale
        s[15] = float(n == 0)
        s[16] = (n - distinct) ** 2 / max(1, n) ** 2
        s[17] = float(n < 20)
        return out


@dataclass
class Model:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Bias, linear part, and half the sum over factors of (sum of v x)^2 less the sum of (v x)^2."""
        return self.bias + x @ self.linear + 0.5 * ((x @ self.factors) ** 2 - (x**2) @ (self.factors**2)).sum(axis=1)


def fit(texts: list[str], labels: list[int], rank: int = RANK, rounds: int = 60, rate: float = 0.08, ridge: float = 2e-4, seed: int = 3) -> Model:
    """A model by stochastic gradients (Adam) on the log loss, labels weighted to their own shares.

    Without both labels the score is about the share of label 1, and near 1 without any.
    """
    share = (sum(labels) + 0.99) / (len(labels) + 1)
    model = Model(float(np.log(share / (1 - share))), np.zeros(Features.WIDTH, "f4"), np.zeros((Features.WIDTH, rank), "f4"))
    if len(set(labels)) < 2:
        return model
    features, rng = Features(), np.random.default_rng(seed)
    x, y = np.stack([features.row(t) for t in texts]), np.array(labels, dtype="f4")
    model.factors = rng.normal(0, 0.05, model.factors.shape).astype("f4")
    parameters = [np.array([model.bias], "f4"), model.linear, model.factors]
    first, second, step = [np.zeros_like(p) for p in parameters], [np.zeros_like(p) for p in parameters], 0
    for r in range(rounds):
        order = rng.permutation(len(y))
        for part in np.array_split(order, max(1, len(y) // 128)):
            xb, sums = x[part], x[part] @ parameters[2]
            model.bias = float(parameters[0][0])
            error = (model.score(xb) - y[part]).astype("f4") / len(part)
            slope = (xb.T @ (error[:, None] * sums)) - parameters[2] * ((xb**2).T @ error)[:, None]
            step += 1
            for i, g in enumerate([np.array([error.sum()], "f4"), xb.T @ error + ridge * parameters[1], slope + ridge * parameters[2]]):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.99 * second[i] + 0.01 * g * g
                parameters[i] -= rate * (1 - r / rounds) * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.99**step)) + 1e-6)
    model.bias = float(parameters[0][0])
    return model


def score(docs: DataFrame, model: Model, threshold: float = 0.5, keep: tuple[str, ...] = ("doc_id",), into: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """The columns in ``keep``, score (0 to 1, higher: better) and predicted (1 from ``threshold`` on), of whole texts.

    Null and empty texts are scored by their having no word. What is kept stays as it is, null doc_ids too; the names in ``into`` must not be kept ones; repeated rows are scored each;
    other columns are read only if kept; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            texts, out = batch.column(0).to_pylist(), []
            for i in range(0, len(texts), 256):
                out.append(model.score(np.stack([features.row(t) for t in texts[i : i + 256]])))
            scores = np.concatenate([*out, np.zeros(0)]).astype("f8")
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(scores)], names=[*batch.schema.names[1:], "score"])

    return scored(docs, run, threshold, keep, into)

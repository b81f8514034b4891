"""Toxicity by compression distance: windows of a text are compressed with two zstandard dictionaries.

One dictionary is trained on ordinary text, the other on what toxic text has more of. A window that the second
shortens, against no dictionary, holds such words; what the first shortens is the measure. Compressed lengths are whole bytes, and a dictionary match costs about three, which is
what a short word costs anyway; so texts are compressed as fixed-width codes of 8 bytes, one for each lower-cased word
and each of its longer beginnings, of which a match saves five or more. Words of no dictionary would cost the same
either way, and are left out.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from factloom.llm.labelled import scored

#: Labelled rows that a model is fitted to, at most for each label; codes in a window; beginnings of words, in letters.
SAMPLE, WINDOW, STEMS = 2500, 96, (3, 4, 5, 7)
WORD = re.compile(r"[^\W\d_]+")
CACHE, FEATURES = 300_000, 5
#: Score from which on a text counts as toxic.
BAR = 0.3
#: Bytes of code windows that the trainer takes for a dictionary, a few hundred times its size; slots for counting terms.
TRAINED, SLOTS = 4 << 20, 1 << 22


def terms(word: str) -> list[str]:
    """A lower-cased word and its beginnings, marked as such."""
    return [word, *[word[:n] + "+" for n in STEMS if len(word) > n]]


def code(term: str) -> bytes:
    return hashlib.blake2b(term.encode(), digest_size=8).digest()


class Codes:
    """Codes of terms and their slots for counting, those met lately at hand."""

    def __init__(self):
        self.known: dict[str, tuple[bytes, int]] = {}

    def __call__(self, term: str) -> tuple[bytes, int]:
        if (found := self.known.get(term)) is None:
            if len(self.known) > CACHE:
                self.known.clear()
            c = code(term)
            found = self.known[term] = c, int.from_bytes(c[:4], "little") % SLOTS
        return found


def _windows(codes: bytes) -> list[bytes]:
    """Windows of ``WINDOW`` codes; the last one ends with the text, and overlaps the one before it."""
    width = 8 * WINDOW
    if len(codes) <= width:
        return [codes]
    starts = [*range(0, len(codes) - width, width), len(codes) - width]
    return [codes[s : s + width] for s in starts]


@dataclass
class Model:
    """Dictionaries, the vocabulary they were trained on, and the calibration from window lengths to a score."""

    ordinary: bytes
    toxic: bytes
    vocabulary: dict[str, bytes]
    weights: list[float] = field(default_factory=lambda: [0.0] * FEATURES)
    level: int = 3

    def scorer(self):
        """Text -> features: total and largest saving of its windows by the toxic dictionary, by words and by what the
        ordinary one saves, damped."""
        import zstandard

        def compressor(content: bytes | None):
            flags = {"level": self.level, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
            if content is None:
                return zstandard.ZstdCompressor(**flags).compress
            dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            dictionary.precompute_compress(level=self.level)
            return zstandard.ZstdCompressor(dict_data=dictionary, **flags).compress

        plain, ordinary, toxic, known, vocabulary = compressor(None), compressor(self.ordinary), compressor(self.toxic), {}, self.vocabulary

        def of(word: str) -> bytes:
            if (c := known.get(word)) is None:
                if len(known) > CACHE:
                    known.clear()
                c = b"".join(vocabulary[t] for t in terms(word) if t in vocabulary)
                if len(word) < 64:
                    known[word] = c
            return c

        def features(text: str) -> list[float]:
            words = WORD.findall(text.lower())
            codes = b"".join(map(of, words))
            if not codes:
                return [1.0] + [0.0] * (FEATURES - 1)
            windows = _windows(codes)
            alone = [len(plain(w)) for w in windows]
            saved = [max(0, n - len(toxic(w))) for n, w in zip(alone, windows)]
            usual = sum(max(0, n - len(ordinary(w))) for n, w in zip(alone, windows))
            total = sum(saved)
            return [1.0, np.log1p(total), np.log1p(max(saved)), np.log1p(1000.0 * total / (8 * len(words))), np.log1p(1000.0 * total / (total + usual + 1))]

        return features

    def score(self, features: list[float]) -> float:
        return float(1 / (1 + np.exp(-np.clip(np.dot(features, self.weights), -30, 30))))


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary, or the samples' own bytes where they are too few to train one."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def fit(texts: list[str], labels: list[int], ordinary_size: int = 8192, toxic_size: int = 4096, least: int = 4, ratio: float = 4.0) -> Model:
    """A model from labelled texts. Odd rows train the dictionaries, even rows calibrate the score.

    The toxic dictionary is trained on toxic texts' terms that at least ``least`` of them hold, and that are
    ``ratio`` times as frequent there as in ordinary texts; the other one on the ordinary texts' terms that are not of
    these. Without both labels the score is about the share of label 1, and near 0 without any.
    """
    share = (sum(labels) + 0.01) / (len(labels) + 1)
    empty = Model(b"\0" * 8, b"\0" * 8, {}, [float(np.log(share / (1 - share)))] + [0.0] * (FEATURES - 1))
    if len(set(labels)) < 2:
        return empty
    words = lambda i: map(str.lower, WORD.findall(texts[i]))
    odd = [i for label in (0, 1) for i in [i for i, y in enumerate(labels) if y == label][::2]]
    n, at = [1, 1], Codes()
    in_toxic, in_ordinary = Counter(), Counter()  # ordinary documents' counts of the terms that toxic ones hold
    common = np.zeros(SLOTS, dtype="i4")  # ordinary documents that hold a term, by slots of its code
    held = lambda i: {t for w in set(words(i)) for t in terms(w)}
    for i in odd:
        if labels[i]:
            in_toxic.update(held(i))
            n[1] += 1
    for i in odd:
        if not labels[i]:
            found = held(i)
            in_ordinary.update(found & in_toxic.keys())
            common[np.unique(np.fromiter((at(t)[1] for t in found), dtype="i8", count=len(found)))] += 1
            n[0] += 1
    marked = {t for t, c in in_toxic.items() if c >= least and c / n[1] >= ratio * (in_ordinary[t] + 0.5) / n[0]}
    usual = lambda t: t not in marked and common[at(t)[1]] >= least

    def parts(label: int, keep) -> list[bytes]:
        """Code windows of one label's odd rows, those with the smallest hashes where they exceed what the trainer takes."""
        out, known = [], {}

        def of(word: str) -> bytes:
            if (c := known.get(word)) is None:
                if len(known) > CACHE:
                    known.clear()
                c = known[word] = b"".join(at(t)[0] for t in terms(word) if keep(t))
            return c

        for i in odd:
            if labels[i] == label:
                s = b"".join(map(of, words(i)))
                out += [s[k : k + 8 * WINDOW] for k in range(0, len(s), 8 * WINDOW)]
        out.sort(key=lambda x: hashlib.blake2b(x, digest_size=8).digest())
        return out[: TRAINED // (8 * WINDOW)]

    ordinary, toxic = _dictionary(parts(0, usual), ordinary_size), _dictionary(parts(1, marked.__contains__), toxic_size)
    content = {d[k : k + 8] for d in (ordinary, toxic) for k in range(len(d) - 7)}
    codes = {t: at(t)[0] for i in odd for t in held(i) if at(t)[0] in content}
    inside = {t for t in codes if t in marked or usual(t)}
    model = Model(ordinary, toxic, {t: codes[t] for t in sorted(inside)})
    features, rest = model.scorer(), sorted(set(range(len(texts))) - set(odd))
    x, y = np.array([features(texts[i]) for i in rest]), np.array([labels[i] for i in rest], dtype=float)
    model.weights = _logistic(x, y).tolist()
    return model


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic regression, by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def score(docs: DataFrame, model: Model, threshold: float = BAR, keep: tuple[str, ...] = ("doc_id",), into: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """The columns in ``keep``, score (0 to 1, higher: more toxic) and predicted (1 from ``threshold`` on), of whole texts.

    Null and empty texts have no window, and get the score of one that nothing shortens. What is kept stays as it is, null doc_ids too; the names in ``into`` must not be kept ones;
    repeated rows are scored each; other columns are read only if kept; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = model.scorer()
        for batch in batches:
            out = pa.array([model.score(features(x)) for x in batch.column(0).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], out], names=[*batch.schema.names[1:], "score"])

    return scored(docs, run, threshold, keep, into)

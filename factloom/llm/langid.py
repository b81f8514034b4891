"""Language identification of words by a linear-chain conditional random field.

Words carry hashed features (character n-grams, among them those at the word's beginning and end, which are its affixes)
and membership in the lexicons of the languages; transitions between the languages of neighbouring words are learned
with them. The forward-backward algorithm gives each word's probabilities in its whole text, so that texts that switch
languages fall into spans. Everything runs over arrays of code points, many texts at once: a text's chain is cut into
segments whose products of transition matrices pass the messages on, which gives the same probabilities as one long pass.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of the feature table, longest n-gram, and words of a segment.
BITS, NGRAM, SEGMENT = 18, 4, 64
#: Characters that are taken at once, and texts; a longer text is taken alone.
CODES, TEXTS = 1 << 19, 1 << 13
#: Documents of a language and their characters that a model is fitted to, and words of a lexicon, at most.
SAMPLE, CHARS, LEXICON = 200, 300_000, 5000
SPANS = "array<struct<start:int,end:int,lang:string,words:int,score:double>>"


@lru_cache(maxsize=1)
def _table() -> tuple[np.ndarray, np.ndarray]:
    """For code points of the first two planes: the lower-case form, and 2 for letters, 1 for marks, 0 for all others."""
    lower, kind = np.arange(1 << 17, dtype="u4"), np.zeros(1 << 17, "u1")
    for c in range(1 << 17):
        category = unicodedata.category(chr(c))
        if category[0] in "LM":
            kind[c] = 2 if category[0] == "L" else 1
            if category in ("Lu", "Lt") and len(small := chr(c).lower()) == 1:
                lower[c] = ord(small)
    return lower, kind


def _folded(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case code points, 0 where no letter or mark stands, and which are letters."""
    lower, kind = _table()
    if len(codes) and codes.max() >= len(kind):  # rare ideographs
        far = np.flatnonzero(codes >= len(kind))
        kinds = kind[np.where(codes < len(kind), codes, 0)]
        kinds[far] = [2 * chr(c).isalpha() for c in codes[far].tolist()]
        small = codes.astype("u4")
        small[codes < len(kind)] = lower[codes[codes < len(kind)]]
    else:
        kinds, small = kind[codes], lower[codes]
    return np.where(kinds > 0, small, 0), kinds == 2


@dataclass
class Words:
    """Words of many texts: places of their n-grams in the feature table, word hashes, and where they lie."""

    places: list[np.ndarray]
    begins: np.ndarray
    keys: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    def emitted(self, grams: np.ndarray) -> np.ndarray:
        """For each word the sums of its n-grams' weights, by row of ``grams``."""
        out = np.zeros((len(self.begins), len(grams)), "f4")
        for k, row in enumerate(grams if len(self.begins) else ()):
            total = row.take(self.places[0])
            for places in self.places[1:]:
                total += row.take(places)
            out[:, k] = np.add.reduceat(total, self.begins)
        return out


def _words(codes: np.ndarray) -> Words:
    """``codes`` are folded, begin and end with a 0, and have one between texts."""
    n, inside = len(codes), codes > 0
    starts = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    ends = np.flatnonzero(~inside[1:] & inside[:-1]) + 1
    wide = codes.astype("u8")
    padded = np.concatenate([wide, np.zeros(NGRAM, "u8")])
    full = np.concatenate([inside, np.zeros(NGRAM, bool)])
    rolling, inner, places = np.full(n, 0x9E37, "u8"), np.ones(n, bool), []
    for k in range(1, NGRAM + 1):
        last = padded[k - 1 : k - 1 + n]
        rolling = rolling * np.uint64(0x100000001B3) + last
        fits = inside if k == 1 else (inside | full[1 : 1 + n]) if k == 2 else inner
        hashed = ((rolling ^ (rolling >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)
        places.append(np.where(fits, hashed, 1 << BITS).astype("i8"))
        if k >= 2:  # all between the first and the last of the next longer one
            inner = inner & full[k - 1 : k - 1 + n]
    lead = int(starts[0]) if len(starts) else n
    at = np.concatenate([np.zeros(lead, "u8"), (np.arange(lead, n) - np.repeat(starts, np.diff(np.append(starts, n)))).astype("u8")])
    mixed = (wide + np.uint64(0x51ED)) * np.uint64(0xD6E8FEB86659FD93) + (at + np.uint64(1)) * np.uint64(0xA0761D6478BD642F)
    mixed = np.where(inside, (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25), 0)
    keys = np.add.reduceat(mixed, starts) if len(starts) else np.zeros(0, "u8")
    return Words(places, starts - 1, keys, starts, ends)


@dataclass
class Model:
    """Weights of n-grams (a row for each language, the last column for no n-gram), of lexicons and of transitions."""

    langs: list[str]
    grams: np.ndarray
    lexicon: np.ndarray
    member: np.ndarray
    known: np.ndarray
    moves: np.ndarray

    def emissions(self, words: Words) -> np.ndarray:
        """A row of weights for each word, by language."""
        return words.emitted(self.grams) + self.lexical(words.keys) @ self.known

    def lexical(self, keys: np.ndarray) -> np.ndarray:
        """Which lexicons have each word."""
        if not len(self.lexicon):
            return np.zeros((len(keys), len(self.langs)), "f4")
        at = np.minimum(np.searchsorted(self.lexicon, keys), len(self.lexicon) - 1)
        return self.member[at] * (self.lexicon[at] == keys)[:, None]


def _scaled(x: np.ndarray) -> np.ndarray:
    """Sums of 1 over the labels, which are the axis before the last."""
    return x / np.maximum(x.sum(axis=-2, keepdims=True), 1e-300)


def marginals(emissions: np.ndarray, moves: np.ndarray, sizes: np.ndarray, segment: int = SEGMENT) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of each word's labels in its chain, and the expected moves from label to label, summed.

    ``emissions`` has a row for each word and chains lie one after another, ``sizes`` (1 or more) words each. Chains are
    cut into segments; a segment's matrix carries a message from its beginning to its end, so that messages at all cuts
    are known before the words inside the segments get theirs, all segments at once. Arrays are (label, segment).
    """
    labels, step = len(moves), np.exp(moves - moves.max())
    cuts = -(-sizes // segment)
    first = np.concatenate([[0], np.cumsum(cuts)]).astype(int)
    n, place = first[-1], np.arange(len(emissions)) + np.repeat(first[:-1] * segment - np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(int), sizes)
    seen = np.ones((n * segment, labels), "f4")
    seen[place] = np.exp(emissions - emissions.max(axis=1, keepdims=True))
    seen = np.ascontiguousarray(seen.reshape(n, segment, labels).transpose(1, 2, 0))
    real = np.zeros(n * segment, bool)  # the rest fills up the last segments of chains
    real[place] = True
    real = np.ascontiguousarray(real.reshape(n, segment).T)
    begin = np.zeros(n, bool)  # a chain begins without a move
    begin[first[:-1]] = True
    moved_in = lambda x, t: np.where(begin, x, step.T @ x) if t == 0 else step.T @ x
    ahead, back = np.full((labels, n), 1 / labels), np.ones((labels, n))
    if (cuts > 1).any():
        carry = np.repeat(np.eye(labels)[:, :, None], n, axis=2)  # (from, to, segment)
        for t in range(segment):
            carry = moved_in(carry, t) * seen[t]
            if t % 8 == 7:
                carry /= np.maximum(carry.sum(axis=(0, 1)), 1e-300)
        for k in range(1, int(cuts.max())):
            at = first[:-1][cuts > k] + k
            ahead[:, at] = _scaled(np.einsum("is,ijs->js", ahead[:, at - 1], carry[:, :, at - 1]))
        # the last segments' matrices count fillings too, so the messages back start behind them
        late = first[1:][cuts > 1] - 1
        back[:, late - 1] = _last(seen[:, :, late], real[:, late], step)
        for k in range(2, int(cuts.max())):
            at = first[1:][cuts > k] - k
            back[:, at - 1] = _scaled(np.einsum("ijs,js->is", carry[:, :, at], back[:, at]))
    forward, now = np.empty((segment, labels, n), "f4"), ahead
    for t in range(segment):
        now = moved_in(now, t) * seen[t]
        forward[t] = now = _scaled(now) if t % 8 == 7 else now
    moved, now = np.zeros((labels, labels)), back
    for t in range(segment - 1, -1, -1):
        both, heard = forward[t] * now, seen[t] * now
        before, moving = (forward[t - 1], real[t]) if t else (ahead, real[t] & ~begin)
        arrived = step.T @ before
        moved += ((before * (moving / np.maximum((arrived * heard).sum(axis=0), 1e-300))) @ heard.T) * step
        forward[t] = _scaled(both)
        now = np.where(real[t], step @ heard, now)
        now = _scaled(now) if t % 8 == 0 else now
    return forward.transpose(2, 0, 1).reshape(-1, labels)[place], moved


def _last(seen: np.ndarray, real: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Messages back from chains' ends to the beginnings of their last segments."""
    now = np.ones(seen.shape[1:])
    for t in range(len(seen) - 1, -1, -1):
        now = np.where(real[t], step @ (seen[t] * now), now)
        now = _scaled(now) if t % 8 == 0 else now
    return now


def fit(texts: list[str], langs: list[str], rounds: int = 25, rate: float = 0.1, seed: int = 3) -> Model:
    """A model from whole texts and their languages.

    Every word of a text counts as of its language. Training chains are pieces of 5 to 40 words of shuffled texts, so
    that transitions are learned from text that switches. Words that at least three texts of a language have, the most
    frequent first, make its lexicon. Weights maximise the chains' likelihood by Adam. Without texts, a model without
    languages, which finds none.
    """
    names, rng = sorted(set(langs)), np.random.default_rng(seed)
    size = len(names)
    joined, words, owner = _joined(texts)
    keep = np.argsort([names.index(x) for x in langs], kind="stable") if texts else []
    label = np.array([names.index(x) for x in langs], "i8")[owner] if len(owner) else np.zeros(0, "i8")
    unique, at, back = np.unique(words.keys, return_index=True, return_inverse=True)
    lexicon, member = np.zeros(0, "u8"), np.zeros((0, size), "f4")
    if len(keep) and len(unique):
        texts_with = np.unique(np.stack([back, label, owner]), axis=1)
        having = np.zeros((len(unique), size), int)
        np.add.at(having, (texts_with[0], texts_with[1]), 1)
        chosen = np.zeros(having.shape, bool)
        for k in range(size):
            top = np.argsort(-having[:, k], kind="stable")[:LEXICON]
            chosen[top, k] = having[top, k] >= 3
        lexicon, member = unique[chosen.any(axis=1)], chosen[chosen.any(axis=1)].astype("f4")
    model = Model(names, np.zeros((size, (1 << BITS) + 1), "f4"), lexicon, member, np.zeros((size, size), "f4"), np.zeros((size, size), "f4"))
    if size < 2 or not len(unique):
        return model
    # one copy of each word, and pieces of texts in a new order
    spans = np.stack([words.starts[at], words.ends[at]], axis=1)
    small = _words(np.concatenate([np.zeros(1, joined.dtype), *[part for a, b in spans for part in (joined[a:b], np.zeros(1, joined.dtype))]]))
    marks, pieces = [*np.flatnonzero(np.diff(owner, prepend=-1)).tolist(), len(owner)], []
    for a, b in zip(marks, marks[1:]):
        while a < b:
            pieces.append((a, end := min(b, a + int(rng.integers(5, 41)))))
            a = end
    order = np.concatenate([np.arange(*pieces[i]) for i in rng.permutation(len(pieces))])
    chain, truth = back[order], label[order]
    sizes = np.array([SEGMENT] * (len(chain) // SEGMENT) + [r for r in [len(chain) % SEGMENT] if r])
    wanted, moved = np.zeros((len(unique), size)), np.zeros((size, size))
    np.add.at(wanted, (chain, truth), 1)
    firsts = np.cumsum(sizes)[:-1]
    inner = np.ones(len(truth) - 1, bool)
    inner[firsts - 1] = False
    np.add.at(moved, (truth[:-1][inner], truth[1:][inner]), 1)
    lexical, used = model.lexical(small.keys), np.unique(np.concatenate([[1 << BITS], *small.places]))
    small.places = [np.searchsorted(used, p) for p in small.places]  # only n-grams that occur have weights to fit
    each, every = np.repeat(np.arange(len(small.begins)), np.diff(np.append(small.begins, len(small.places[0])))), np.concatenate(small.places)
    grams = np.zeros((size, len(used)), "f4")
    weights = [grams, model.known, model.moves]
    means, squares = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for turn in range(1, rounds + 1):
        odds, steps = marginals((small.emitted(grams) + lexical @ model.known)[chain], model.moves, sizes)
        gap = wanted - np.stack([np.bincount(chain, odds[:, k], len(unique)) for k in range(size)], axis=1)
        slopes = np.stack([np.bincount(every, np.tile(gap[each, k], NGRAM), len(used)) for k in range(size)])
        slopes[:, -1] = 0
        for w, g, m, s in zip(weights, (slopes, lexical.T @ gap, moved - steps), means, squares):
            g = g / len(chain) - 1e-6 * w
            m += 0.1 * (g - m)
            s += 0.01 * (g**2 - s)
            w += (rate * (m / (1 - 0.9**turn)) / (np.sqrt(s / (1 - 0.99**turn)) + 1e-8)).astype("f4")
    model.grams[:, used] = grams
    return model


def _joined(texts: list[str]) -> tuple[np.ndarray, Words, np.ndarray]:
    """Folded code points of texts, a 0 round each, their words, and each word's text."""
    raw = np.frombuffer("\0".join(["", *texts, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
    folded, _ = _folded(raw)
    words = _words(folded)
    bounds = np.cumsum([1, *[len(t) + 1 for t in texts]])
    return folded, words, np.searchsorted(bounds, words.starts, side="right") - 1


def _labelled(texts: list[str], model: Model) -> pa.RecordBatch:
    """Spans and shares of texts. Long texts take their emissions in parts that end between words."""
    size = len(model.langs)
    emitted, owners, starts, ends = [], [], [], []
    letters = np.zeros(len(texts), bool)
    for number, part, offset in _parts(texts):
        folded, alpha = _folded(np.frombuffer(part.encode("utf-32-le", "surrogatepass"), "<u4"))
        bounds = np.cumsum([0, *[len(texts[i]) + 1 for i in number]]) if offset is None else np.array([0, len(part) + 1])
        words = _words(np.concatenate([np.zeros(1, folded.dtype), folded, np.zeros(1, folded.dtype)]))
        place = np.searchsorted(bounds, words.starts - 1, side="right") - 1
        own = np.asarray(number)[place]
        base = bounds[place] if offset is None else -offset
        starts.append(words.starts - 1 - base), ends.append(words.ends - 1 - base), owners.append(own)
        emitted.append(model.emissions(words) if size else np.zeros((len(own), 0), "f4"))
        so_far = np.concatenate([[0], np.cumsum(alpha)])
        letters[number] |= so_far[bounds[1:] - 1] > so_far[bounds[:-1]]
    emitted = np.concatenate([np.zeros((0, size), "f4"), *emitted])
    owners, starts, ends = (np.concatenate([np.zeros(0, "i8"), *x])[: len(emitted) if size else 0].astype("i8") for x in (owners, starts, ends))
    odds = marginals(emitted, model.moves, np.bincount(owners, minlength=len(texts))[np.unique(owners)])[0] if len(owners) else np.zeros((0, size))
    best = odds.argmax(axis=1) if len(odds) else np.zeros(0, int)
    counts = np.bincount(owners, minlength=len(texts))
    shares = np.stack([np.bincount(owners, odds[:, k], len(texts)) / np.maximum(counts, 1) for k in range(size)], axis=1) if size else np.zeros((len(texts), 0))
    turn = np.flatnonzero((np.diff(owners, prepend=-1) != 0) | (np.diff(best, prepend=-1) != 0))
    long = np.diff([*turn, len(owners)])
    mean = np.add.reduceat(odds[np.arange(len(best)), best], turn) / long if len(turn) else np.zeros(0)
    spans = pa.StructArray.from_arrays(
        [pa.array(starts[turn].astype("i4")), pa.array(ends[turn + long - 1].astype("i4") if len(turn) else np.zeros(0, "i4")), pa.array(model.langs, pa.string()).take(pa.array(best[turn])), pa.array(long.astype("i4")), pa.array(mean)],
        names=["start", "end", "lang", "words", "score"],
    )
    offsets = np.concatenate([[0], np.cumsum(np.bincount(owners[turn], minlength=len(texts)))]).astype("i4")
    flat = pa.ListArray.from_arrays(pa.array(np.arange(0, size * len(texts) + 1, size or 1, dtype="i4")[: len(texts) + 1] if size else np.zeros(len(texts) + 1, "i4")), pa.array(shares.ravel()))
    return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(offsets), spans), flat, pa.array(letters)], names=["spans", "shares", "letters"])


def _parts(texts: list[str]) -> Iterator[tuple[list[int], str, int | None]]:
    """Texts joined up to CODES characters, or parts of longer ones: numbers, the text, and where a part begins in its own."""
    held, size = [], 0
    for i, text in enumerate(texts):
        if len(text) > CODES:
            if held:
                yield held, "\0".join(texts[j] for j in held), None
                held, size = [], 0
            a = 0
            while a < len(text):
                b = min(len(text), a + CODES)
                while b < len(text) and unicodedata.category(text[b])[0] in "LM":
                    b += 1
                yield [i], text[a:b], a
                a = b
            continue
        if size + len(text) > CODES and held:
            yield held, "\0".join(texts[j] for j in held), None
            held, size = [], 0
        held.append(i)
        size += len(text) + 1
    if held:
        yield held, "\0".join(texts[j] for j in held), None


def label_words(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in ``keep`` with spans, shares and letters for every whole text.

    ``spans`` are the runs of words of one language (start, end, language, words, mean probability; code points, end
    exclusive), words being runs of letters and marks. ``shares`` are the languages' mean probabilities over the words,
    in the order of ``model.langs``. ``letters`` tells whether there is any letter. Null and empty texts, and those
    without letters, have no spans and shares of 0; repeated rows and null ids are labelled each; other columns may have
    any names; an empty table gives no rows. A model without languages finds no spans.
    """
    kept = [docs.schema[c] for c in keep]
    rows = docs.select(F.coalesce("text", F.lit("")).alias("text"), *[F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(kept)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            sizes = pc.utf8_length(whole.column(0)).to_numpy()
            at = 0
            while at < len(sizes):
                n = max(1, int(np.searchsorted(np.cumsum(sizes[at : at + TEXTS] + 1), CODES, side="right")))
                batch, at = whole.slice(at, n), at + n
                found = _labelled(batch.column(0).to_pylist(), model)
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], *found.columns], names=[*[f"c{i}" for i in range(len(kept))], *found.schema.names])

    fields = ", ".join([*[f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(kept)], f"spans {SPANS}", "shares array<double>", "letters boolean"])
    out = rows.mapInArrow(run, fields)
    return out.select(*[F.col(f"c{i}").alias(f.name) for i, f in enumerate(kept)], "spans", "shares", "letters")


def predict_languages(docs: DataFrame, model: Model) -> DataFrame:
    """Columns doc_id, lang_pred, score, n_words and n_spans: the language with the largest share of each whole text, ties to
    the first in order, and that share.

    Null texts, those without a letter, and all texts of a model without languages, are ``und`` with a score of 0;
    otherwise as in ``label_words``.
    """
    found = label_words(docs, model)
    top = F.array_max("shares")
    names = F.array(*[F.lit(x) for x in model.langs]) if model.langs else F.array().cast("array<string>")
    known = F.col("letters") & (F.size("shares") > 0) & (F.size("spans") > 0)
    return found.select(
        "doc_id",
        F.when(known, F.get(names, F.array_position("shares", top).cast("int") - 1)).otherwise("und").alias("lang_pred"),
        F.when(known, F.least(F.lit(1.0), top)).otherwise(0.0).alias("score"),
        F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["words"]).alias("n_words"),
        F.size("spans").cast("long").alias("n_spans"),
    )

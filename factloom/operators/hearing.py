"""What many statements say of many names and values that are single words: found by where words lie, not pair by pair."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import value_variants
from factloom.session import prepare

#: What is seen of a name and a value in a statement: the value near the name, and its surroundings there; a confirmed question; the
#: same in the wider window; a joke.
NEAR, NEAR_DODGED, NEAR_NEGATED, CONFIRMED, WIDE, WIDE_DODGED, WIDE_NEGATED, JOKE = (1 << i for i in range(8))
#: Names and values that a task holds, at most on average; characters that it reads at once.
PAIRS, CHARACTERS = 1 << 19, 1 << 18
#: Words whose cases are told by lower(), and what patterns take other characters for.
PLAIN, SAME = r"^[0-9A-Za-zÀ-ÖØ-öø-ÿ]+\z", str.maketrans("İıŸſẞ\u212a\u212b", "iiÿsßkå")
ODD = re.compile("[" + "".join(map(chr, SAME)) + "]")


def plain(name: Column, value: Column) -> Column:
    """True where name and value are words that are found by lower case alone, and the value has no other form."""
    other = F.exists(F.regexp_extract_all(value, F.lit(r"(\d{2,})"), F.lit(1)), lambda g: g != value)
    return F.coalesce(name.rlike(PLAIN) & value.rlike(PLAIN) & (value_variants(value) == F.array(value)) & ~other, F.lit(False))


@dataclass(frozen=True)
class Rules:
    """Words that grade a statement, which depend on whose statements they are, and windows in characters."""

    dodge: tuple[str, ...]
    negation: tuple[str, ...]
    agreement: tuple[str, ...]
    joke: tuple[str, ...]
    near: int = 80
    wide: int = 150
    before: int = 30


@lru_cache(1 << 14)
def whole_word(needle: str) -> re.Pattern:
    return re.compile(r"(?<!\w)" + re.escape(needle) + r"(?!\w)", re.I)


def negated(text: str, at: int, rules: Rules) -> bool:
    return any(x and whole_word(x).search(text[max(0, at - rules.before) : at]) for x in rules.negation)


def agreed(answer: str, rules: Rules) -> bool:
    reply = answer.lower().strip()
    return any(reply.startswith(x) for x in rules.agreement) and not any(x in reply for x in rules.dodge)


@dataclass(frozen=True)
class Judge:
    """``whole`` judges a statement (question, answer, name, value, variants), ``seen`` does so by what was seen of a plain name and
    value. Both give ``fields`` or None. A lower ``rank`` of the fields goes before an earlier statement."""

    rules: Rules
    whole: Callable[[str, str, str, str, list[str]], tuple | None]
    seen: Callable[[int], tuple | None]
    fields: tuple[str, ...]
    rank: Callable[[tuple], int] | None = None


class Hearing:
    """The names and values of a cell, in lower case, and what the statements heard so far are to each."""

    def __init__(self, names: list[str], values: list[str], judge: Judge):
        self.judge, self.rules = judge, judge.rules
        self.words = sorted({*names, *values})
        self.ids = {w: i for i, w in enumerate(self.words)}
        n, v = (np.array([self.ids[w] for w in side], dtype="i8") for side in (names, values))
        order = np.lexsort((n, v))
        self.name, self.value = n[order], v[order]  # by value, so that a value's names lie together
        self.begin = np.searchsorted(self.value, np.arange(len(self.words) + 1))
        self.keys = self.value * len(self.words) + self.name
        self.is_name, self.is_value = (np.isin(np.arange(len(self.words)), x) for x in (n, v))
        self.shift = np.uint64(64 - max(16, min(26, (8 * len(n)).bit_length())))
        self.slots = np.zeros(1 << (64 - int(self.shift)), dtype=bool)
        self.slots[self._slot(self.keys)] = True
        told = [judge.seen(bits) for bits in range(256)]
        self.outcomes = sorted({t for t in told if t is not None})
        self.place = {t: i for i, t in enumerate(self.outcomes)}
        self.table = np.array([self.place.get(t, -1) for t in told])
        self.count = np.zeros(len(n) * len(self.outcomes), dtype="i8")
        self.first = np.full(len(self.count) if judge.rank else 0, np.iinfo("i8").max)
        self.rows, self.at = {}, 0

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype("u8") * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def pairs(self, names: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the names and values, words side by side, are asked for, and their numbers."""
        keys = values * len(self.words) + names
        maybe = np.flatnonzero(self.slots[self._slot(keys)])
        keys = keys[maybe]
        k = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        same = self.keys[k] == keys
        return maybe[same], k[same]

    def among(self, names: np.ndarray, values: np.ndarray) -> np.ndarray:
        """The numbers of the pairs of any of the different names with any of the different values."""
        many = self.begin[values + 1] - self.begin[values]
        if len(names) * len(values) <= many.sum():
            return self.pairs(np.tile(names, len(values)), np.repeat(values, len(names)))[1]
        k = np.concatenate([np.arange(self.begin[v], self.begin[v + 1]) for v in values] or [np.zeros(0, "i8")])
        return k[np.isin(self.name[k], names)]

    def hear(self, texts: list[tuple]) -> None:
        """Takes statements (ordinal, statement_id, question, answer), in the order that decides which is first."""
        at, size = 0, 0
        for i, (_, _, question, answer) in enumerate(texts):
            size += len(question) + len(answer) + 256
            if size >= CHARACTERS or i + 1 == len(texts):
                self._hear(texts[at : i + 1])
                at, size = i + 1, 0

    def _hear(self, texts: list[tuple]) -> None:
        rules, get = self.rules, self.ids.get
        apart = max(rules.near, rules.wide, rules.before) + 1
        ids, begins, ends, owner, said, heard, sure, base = [], [], [], [], [[] for _ in rules.dodge], [], [], 0
        joke, t, e = np.zeros(len(texts), dtype="i8"), [], []
        for n, (_, _, question, answer) in enumerate(texts):
            text = f"{question} / {answer}"
            if ODD.search(text):
                e.append(np.array(self._one(question, answer, text), dtype="i8"))
                t.append(np.full(len(e[-1]), n))
                continue
            low = text.lower()
            joke[n] = JOKE * any(x in answer.lower() for x in rules.joke)
            before = len(ids)
            for m in re.finditer(r"\w+", low):
                if (i := get(m[0])) is not None:
                    a, b = m.span()
                    ids.append(i)
                    begins.append(base + a)
                    ends.append(base + b)
            owner.extend([n] * (len(ids) - before))
            for x, places in zip(rules.dodge, said):
                p = low.find(x)
                while p >= 0 and x:
                    places.append(base + p)
                    p = low.find(x, p + 1)
            heard.append((base, text))
            if agreed(answer, rules):
                asked = {i for i, b in zip(ids[before:], ends[before:]) if b - base <= len(question)}
                named = set(map(get, re.findall(r"[^\W_]+", low))) - {None} if "_" in low else set(ids[before:])
                sides = (np.array(sorted(x), dtype="i8") for x in (named, asked))
                sure.append((n, self.among(*(x[kind[x]] for x, kind in zip(sides, (self.is_name, self.is_value))))))
            base += len(text) + 2 * apart
        group, code = self._codes(*(np.array(x, dtype="i8") for x in (ids, begins, ends, owner)), said, heard, sure)
        o = self.table[code | joke[group // len(self.keys)]]
        t = np.concatenate([*t, group[o >= 0] // len(self.keys)])
        e = np.concatenate([*e, group[o >= 0] % len(self.keys) * len(self.outcomes) + o[o >= 0]])
        np.add.at(self.count, e, 1)
        if self.judge.rank:
            better = self.first[e] > self.at + t
            np.minimum.at(self.first, e[better], self.at + t[better])
            self.rows |= {self.at + int(i): texts[i][:2] for i in np.unique(t[better])}
        self.at += len(texts)

    def _one(self, question: str, answer: str, text: str) -> list[int]:
        """Entries of a statement whose words lower case alone doesn't tell: each value that it holds is judged with each name that it mentions."""
        places = lambda words: np.array(sorted({i for w in words if (i := self.ids.get(w)) is not None}), dtype="i8")
        names, values = places(re.findall(r"[^\W_]+", text.lower())), places(re.findall(r"\w+", text.translate(SAME).lower()))
        out = []
        for k in self.among(names[self.is_name[names]], values[self.is_value[values]]).tolist():
            name, value = self.words[self.name[k]], self.words[self.value[k]]
            if (got := self.judge.whole(question, answer, name, value, [value])) is not None:
                out.append(k * len(self.outcomes) + self.place[got])
        return out

    def _codes(self, ids, begins, ends, owner, said, heard, sure) -> tuple[np.ndarray, np.ndarray]:
        """Statements with numbers of pairs, as one number, and what is seen of each."""
        rules, pairs, n = self.rules, len(self.keys), len(ids)
        left, names, values, near = np.arange(n), [], [], []
        for d in range(n):
            left = left[: np.searchsorted(left, n - d)]
            gap = begins[left + d] - ends[left]
            left, gap = left[gap <= max(rules.near, rules.wide)], gap[gap <= max(rules.near, rules.wide)]
            if not len(left):
                break
            for a, b in ((left, left + d), (left + d, left))[: 1 if d == 0 else 2]:
                fit = self.is_name[ids[a]] & self.is_value[ids[b]]
                names.append(a[fit])
                values.append(b[fit])
                near.append(gap[fit])
        none = [np.zeros(0, "i8")]
        names, values, gap = (np.concatenate(x or none) for x in (names, values, near))
        hit, k = self.pairs(ids[names], ids[values])
        values, gap = values[hit], gap[hit]
        bits = max(1, n).bit_length()
        placed = ((owner[values] * pairs + k) << bits) | values

        def firsts(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            x = np.sort(x)
            group = x >> bits
            new = np.ones(len(x), dtype=bool)
            new[1:] = group[1:] != group[:-1]
            return group[new], x[new] & ((1 << bits) - 1)

        group, where = firsts(placed[gap <= rules.wide])
        close, there = firsts(placed[gap <= rules.near])
        agreed = np.unique(np.concatenate([t * pairs + k for t, k in sure] or none))
        all_ = np.unique(np.concatenate([group, close, agreed]))
        code = np.zeros(len(all_), "i8")
        negated = self._negated(np.unique(np.concatenate([where, there])), begins, ends, heard)
        code[np.searchsorted(all_, group)] |= WIDE + WIDE_DODGED * self._dodged(begins[where], ends[where], rules.wide, said) + WIDE_NEGATED * negated[where]
        code[np.searchsorted(all_, close)] |= NEAR + NEAR_DODGED * self._dodged(begins[there], ends[there], rules.near, said) + NEAR_NEGATED * negated[there]
        code[np.searchsorted(all_, agreed)] |= CONFIRMED
        return all_, code

    def _dodged(self, begins: np.ndarray, ends: np.ndarray, window: int, said: list[list[int]]) -> np.ndarray:
        out = np.zeros(len(begins), dtype="i8")
        for x, places in zip(self.rules.dodge, said):
            if not x:
                out[:] = 1
            elif places:
                p = np.array(places + [np.iinfo("i8").max // 2])
                out |= p[np.searchsorted(p, begins - window)] + len(x) <= ends + window
        return out

    def _negated(self, asked: np.ndarray, begins, ends, heard) -> np.ndarray:
        """For each word 1 if it is asked for and a negation stands before it, else 0."""
        out = np.zeros(len(begins), dtype="i8")
        starts = np.array([base for base, _ in heard], dtype="i8")
        for x in filter(None, self.rules.negation):
            some = re.compile(f"(?={re.escape(x)})", re.I)
            p = np.array([base + m.start() for base, text in heard for m in some.finditer(text)] + [np.iinfo("i8").max // 2])
            maybe = asked[p[np.searchsorted(p, begins[asked] - self.rules.before)] + len(x) <= begins[asked]]
            for i, j in zip(maybe.tolist(), (np.searchsorted(starts, begins[maybe], "right") - 1).tolist()):
                base, text = heard[j]
                out[i] = out[i] or negated(text, int(begins[i]) - base, self.rules)
        return out

    def told(self) -> Iterator[tuple]:
        """Batches of (names, values, outcomes, counts, first rows)."""
        if self.judge.rank:
            rank = np.array([self.judge.rank(o) for o in self.outcomes], dtype="i8")
            order = np.where(self.count > 0, np.tile(rank << 48, len(self.keys)) + np.minimum(self.first, 1 << 47), np.iinfo("i8").max).reshape(-1, len(self.outcomes))
            e = np.arange(len(self.keys)) * len(self.outcomes) + order.argmin(axis=1)
            e = e[self.count[e] > 0]
        else:
            e = np.flatnonzero(self.count)
        for i in range(0, len(e), 1 << 14):
            part = e[i : i + (1 << 14)]
            k, o = part // len(self.outcomes), part % len(self.outcomes)
            yield [self.words[w] for w in self.name[k]], [self.words[w] for w in self.value[k]], [self.outcomes[x] for x in o], self.count[part], [self.rows[int(r)] for r in self.first[part]] if self.judge.rank else None


def hear(pairs: DataFrame, n: int, statements: DataFrame, judge: Judge) -> DataFrame:
    """Columns name, value, the judge's fields and _k: of how many statements (ordinal, statement_id, question, answer) they are what these
    are to a plain name and value in lower case, of which there are ``n`` different ones. A judge with a rank gives each pair its
    best fields in each cell, with ordinal and statement_id.

    Pairs are dealt into groups that a task can hold, statements into parts; a cell has a group, which comes first, and a part, which streams
    past it. Nothing is laid out for a pair and a statement, and a cell gives at most a row for each pair and outcome.
    """
    spark = prepare(pairs.sparkSession)
    groups = max(1, -(-n // PAIRS))
    parts = max(1, -(-2 * spark.sparkContext.defaultParallelism // groups))
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    deal = lambda k, *by: F.pmod(F.xxhash64(*by), F.lit(k)).cast("int")
    asked = pairs.select("name", "value", deal(groups, "name", "value").alias("_group"), every(parts).alias("_part"), F.lit(0).alias("_side"))
    said = statements.select("ordinal", "statement_id", "question", "answer", deal(parts, "ordinal", "statement_id", "question").alias("_part"), every(groups).alias("_group"), F.lit(1).alias("_side"))
    columns = ["_side", "name", "value", "ordinal", "statement_id", "question", "answer"]
    rows = asked.unionByName(said, allowMissingColumns=True).select((F.col("_group") * parts + F.col("_part")).alias("_cell"), *columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, hearing, kinds = None, [], None, None

        def done() -> Iterator[pa.RecordBatch]:
            for names, values, outcomes, counts, first in hearing.told() if hearing else ():
                more = [pa.array(x, pa.string()) for x in zip(*outcomes)] + [pa.array(counts, pa.int64())]
                more += [pa.array(x, k) for x, k in zip(zip(*first), kinds)] if judge.rank else []
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(values, pa.string()), *more], [*fields, "_k", *["ordinal", "statement_id"] * bool(judge.rank)])

        for batch in batches:
            kinds = [batch.schema.field(c).type for c in ("ordinal", "statement_id")]
            texts = []
            for cell, side, name, value, ordinal, key, question, answer in zip(*(c.to_pylist() for c in batch.columns)):
                if cell != at:
                    if hearing:
                        hearing.hear(texts)
                    yield from done()
                    at, held, hearing, texts = cell, [], None, []
                if side == 0:
                    held.append((name, value))
                elif held:
                    hearing = hearing or Hearing(*zip(*held), judge)
                    texts.append((ordinal, key, question or "", answer or ""))
            if hearing:
                hearing.hear(texts)
        yield from done()

    fields = ["name", "value", *judge.fields]
    kind = {f.name: f.dataType.simpleString() for f in statements.schema.fields}
    schema = ", ".join(f"{f} string" for f in fields) + ", _k long" + (f", ordinal {kind['ordinal']}, statement_id {kind['statement_id']}" if judge.rank else "")
    return rows.repartitionById(groups * parts, F.col("_cell")).sortWithinPartitions("_cell", "_side", "ordinal", "statement_id").mapInArrow(run, schema)

"""The source divergence audit against plain Python, and on awkward rows."""

import re
from collections import Counter

import pytest

from factloom.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, term string, p long, part string"


def audited(rows, least=3, top=200):
    """The audit by its definition, over (text, lang, source)."""
    texts = [((t or ""), (g or ""), (s or "")) for t, g, s in rows]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = [(g, s, re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.translate(lower))) for t, g, s in texts]
    out = set()
    for lang in {g for g, _, _ in found}:
        having = Counter(w for g, _, words in found if g == lang for w in set(words))
        kept = [w for w, n in having.items() if n >= least]
        sources = sorted({s for g, s, _ in found if g == lang})
        counts = {s: Counter(w for g, x, words in found if (g, x) == (lang, s) for w in words) for s in sources}
        counts[None] = sum(counts.values(), Counter())
        share = {}
        for s, c in counts.items():
            total = sum(c[w] for w in kept)
            share[s] = {w: 1 + 10**9 * (c[w] + 1) // (total + len(kept)) for w in kept}
        gap = lambda p, q: (p - q) ** 2 // q
        for s in sources:
            pair = sorted(((-sum(gap(share[s][w], share[o][w]) for w in kept), o.encode(), o) for o in sources if o != s))
            term = sorted((-gap(share[s][w], share[None][w]), w.encode(), w) for w in kept if counts[s][w] and share[s][w] > share[None][w])[:top]
            out |= {(lang, s, part, x, -v, n) for part, ranked in (("pair", pair), ("term", term)) for n, (v, _, x) in enumerate(ranked, 1)}
    return out


TEXTS = [
    (1, "The Sun, the moon; the STAR's x86 été Été", "en", "a"), (2, "the sun the sun", "en", "b"), (3, "The sun über allem", "en", "c"), (4, "über the été", "en", "a"),
    (5, None, "en", "d"), (6, "", "en", None), (7, "über über 日本語", "en", "e"), (8, "the", "en", "b"), (9, "the", "en", "b"),
    (10, "alone here", "xx", "a"), (11, None, "xx", "b"), (12, "the sun", None, "a"), (13, "sun sun", None, "b"), (14, "sun", None, None), (None, "sun the", None, "a"), (3, "The sun über allem", "en", "c"),
]


@pytest.mark.parametrize("groups, terms, held", [(16, 4096, 1 << 19), (2, 2, 3), (1, 1, 1)])
def test_audit(spark, monkeypatch, groups, terms, held):
    monkeypatch.setattr(divergence, "GROUPS", groups)
    monkeypatch.setattr(divergence, "TERMS", terms)
    monkeypatch.setattr(divergence, "HELD", held)
    rows = spark.createDataFrame([(*r, "clash", 1, "clash") for r in TEXTS], SCHEMA)
    got = [tuple(r) for r in divergence.audit(rows, top=2).collect()]
    assert len(got) == len(set(got)) and set(got) == audited([r[1:] for r in TEXTS], top=2)


def test_no_rows(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).collect() == []


def test_very_long_text(spark):
    rows = [("Wort " * 300_000 + "anders", "de", "a"), ("wort anders", "de", "b"), ("wort", "de", "b"), ("anders", "de", "c")]
    frame = spark.createDataFrame([(i, *r, None, None, None) for i, r in enumerate(rows)], SCHEMA)
    assert {tuple(r) for r in divergence.audit(frame).collect()} == audited(rows)


def test_shares_are_exact(spark):
    rows = [(c, t) for t in (1, 3, 7, 10**6 + 3, 8 * 10**15 + 1) for c in (0, 1, t // 3, t - 1)]
    frame = spark.createDataFrame([(c, t) for c, t in rows], "c long, t long").select("c", "t", divergence.share("c", "t").alias("p"))
    assert all(r["p"] == 1 + 10**9 * (r["c"] + 1) // r["t"] for r in frame.collect())

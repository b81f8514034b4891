"""The language identifier: probabilities against plain recursion, spans of switching text, held-out accuracy, awkward rows."""

import os
import re
import zlib

import numpy as np
import pytest

from factloom.llm import labelled, langid

FOLDER = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string, shares string, letters string"


def brute(emissions, moves):
    step, seen = np.exp(moves), np.exp(emissions)
    ahead, back = [seen[0] / len(moves)], [np.ones(len(moves))]
    for t in range(1, len(seen)):
        ahead.append((ahead[-1] @ step) * seen[t])
        ahead[-1] /= ahead[-1].sum()
    for t in range(len(seen) - 1, 0, -1):
        back.append(step @ (seen[t] * back[-1]))
        back[-1] /= back[-1].sum()
    both = np.array(ahead) * np.array(back[::-1])
    return both / both.sum(axis=1, keepdims=True)


@pytest.mark.parametrize("segment", [1, 4, 7, 64])
def test_segments_give_the_whole_chains_probabilities(segment):
    rng = np.random.default_rng(1)
    sizes = np.array([1, 5, 64, 65, 130, 7, 300])
    emissions, moves = rng.normal(size=(sizes.sum(), 3)) * 2, rng.normal(size=(3, 3))
    want = np.concatenate([brute(x, moves) for x in np.split(emissions, np.cumsum(sizes)[:-1])])
    assert np.allclose(langid.marginals(emissions, moves, sizes, segment)[0], want, atol=1e-6)


def test_expected_moves():
    rng = np.random.default_rng(2)
    emissions, moves = rng.normal(size=(4, 2)), rng.normal(size=(2, 2))
    total, want = 0.0, np.zeros((2, 2))
    for path in np.ndindex(2, 2, 2, 2):
        weight = np.exp(sum(emissions[t, k] for t, k in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:])))
        total += weight
        for a, b in zip(path, path[1:]):
            want[a, b] += weight
    assert np.allclose(langid.marginals(emissions, moves, np.array([4]), 3)[1], want / total, atol=1e-6)


def invented(lang, n, rng):
    parts = {"aa": ["ka", "tu", "mol", "sin"], "bb": ["zh", "ev", "rho", "wyx"], "cc": ["日", "本", "語", "字"]}[lang]
    return " ".join("".join(rng.choice(parts, rng.integers(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(3)
    rows = [(invented(lang, 60, rng), lang) for lang in ("aa", "bb", "cc") for _ in range(20)]
    return langid.fit([t for t, _ in rows], [g for _, g in rows], rounds=20)


def test_spans_of_switching_text(spark, model):
    rng, rows = np.random.default_rng(4), []
    for i in range(40):
        langs, parts = [["aa", "bb", "cc"][k] for k in rng.permutation(3)], []
        for lang in langs:
            parts.append(invented(lang, int(rng.integers(8, 90)), rng).upper())
        rows.append((i, ", ".join(parts), langs, parts))
    got = {r["doc_id"]: r for r in langid.label_words(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), model).collect()}
    right = total = 0
    for i, text, langs, parts in rows:
        spans = got[i]["spans"]
        assert [s["words"] for s in spans] == [len(text[s["start"] : s["end"]].replace(",", "").split()) for s in spans]
        assert all(a["end"] < b["start"] and a["lang"] != b["lang"] for a, b in zip(spans, spans[1:]))
        assert abs(sum(got[i]["shares"]) - 1) < 1e-5
        ends = np.cumsum([len(p) + 2 for p in parts])
        for m in re.finditer(r"\w+", text):
            lang = next(s["lang"] for s in spans if s["start"] <= m.start() < s["end"])
            right, total = right + (lang == langs[int(np.searchsorted(ends, m.start(), side="right"))]), total + 1
    assert right / total > 0.97


def test_awkward_rows(spark, model):
    rows = [(1, None), (2, ""), (3, "12 - 34 ²"), (4, "\0\0"), (5, "katu\0mol sin"), (6, "İSTANBUL ß"), (7, "𠀀 日本"), (8, "́"), (None, "katu"), (1, "katu katu"), (1, "katu katu"), (9, "😀 x́")]
    frame = spark.createDataFrame([(*r, "l", "s", None, "clash", "clash", "clash") for r in rows], SCHEMA)
    got = langid.predict_languages(frame, model).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r for r in got}
    assert all((by[i]["lang_pred"], by[i]["score"], by[i]["n_words"]) == ("und", 0.0, n) for i, n in ((2, 0), (3, 0), (4, 0)))
    assert by[8]["lang_pred"] == "und" and by[5]["lang_pred"] == "aa" and by[7]["lang_pred"] == "cc" and by[6]["lang_pred"] != "und" and by[None]["lang_pred"] == "aa"
    assert sorted(r["lang_pred"] for r in got if r["doc_id"] == 1) == ["aa", "aa", "und"]
    assert langid.predict_languages(spark.createDataFrame([], SCHEMA), model).collect() == []


def test_models_of_no_or_one_language(spark):
    frame = spark.createDataFrame([(1, "some words"), (2, None)], "doc_id long, text string")
    assert {r["lang_pred"] for r in langid.predict_languages(frame, langid.fit([], [])).collect()} == {"und"}
    assert [r["lang_pred"] for r in langid.predict_languages(frame, langid.fit(["a b"], ["zz"])).orderBy("doc_id").collect()] == ["zz", "und"]


def test_very_long_texts(spark, model):
    rng = np.random.default_rng(6)
    first, second = invented("aa", 200_000, rng), invented("bb", 150_000, rng)
    rows = [(1, first + " " + second), (2, "x" * 1_200_000), (3, "katu"), (4, first)]
    assert len(rows[0][1]) > langid.CODES
    got = {r["doc_id"]: r for r in langid.label_words(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    most = {lang: sum(s["words"] for s in got[1]["spans"] if s["lang"] == lang) for lang in ("aa", "bb")}
    assert sum(most.values()) == 350_000 and abs(most["aa"] - 200_000) < 2000 and got[1]["spans"][-1]["end"] <= len(rows[0][1])
    assert [s["words"] for s in got[2]["spans"]] == [1] and got[2]["spans"][0]["end"] == 1_200_000
    assert got[3]["spans"][0]["lang"] == "aa" and got[4]["shares"][0] > 0.98


def test_sample(spark):
    rows = [(i, f"text number {i}", ["de", "en", None][i % 3]) for i in range(60)] + [(100, "x" * 500, "fr"), (102, None, "de"), (None, "no id", "de"), (103, "123", "de"), (104, "y" * 400, "fr")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    texts, langs = labelled.language_sample(frame, 3, 1, 5, 100)
    known = {t: (i, g) for i, t, g in rows}
    assert all(known[t][1] == g and zlib.crc32(str(known[t][0]).encode()) % 3 != 1 for t, g in zip(texts, langs))
    assert {g: langs.count(g) for g in set(langs)}.keys() >= {"de", "en"} and max(langs.count(g) for g in langs) <= 5
    # what is too long is passed over; where nothing fits, the shortest is taken
    assert all(sum(len(t) for t, g in zip(texts, langs) if g == x) <= 100 for x in ("de", "en")) and langs.count("fr") <= 1
    assert labelled.language_sample(frame.limit(0), 3, 1, 5, 100) == ([], [])


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the given tables aren't here")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    fitted = langid.fit(*labelled.language_sample(docs, 3, 1, 100, 150_000))
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict_languages(docs, fitted).collect()}
    held = [r for r in docs.select("doc_id", "lang").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 and r["lang"]]
    assert np.mean([got[r["doc_id"]] == r["lang"] for r in held]) > 0.98

"""Forms in texts: every way of meeting them gives the same rows, and a million forms let no more runs out than hits."""

import random
import re

import pytest
from pyspark.sql import functions as F

from factloom.operators import evidence, matching

TEXTS = [(1, "The Red-Haired captain sailed; the red haired CAPTAIN!"), (2, "captain"), (3, None), (4, ""), (5, "Über-Pirat é 7 seas"), (6, "red"), (7, "the the the"), (8, "?!")]
FORMS = [("red haired", 1), ("Captain", 2), ("über", 3), ("7 Seas", 4), ("the", 5), ("red haired captain", 6), ("...", 7), ("", 8), ("The", 9), ("captain sailed the red haired captain", 10), (None, 11)]


def brute(texts, forms):
    low = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    out = set()
    for k, t in texts:
        have = f" {' '.join(low(t))} "
        out |= {(k, f, n) for f, n in forms if low(f) and f" {' '.join(low(f))} " in have}
    return out


@pytest.mark.parametrize("whole, hashes", [(100_000, 4_000_000), (0, 4_000_000), (0, 0)])
def test_ways(spark, monkeypatch, whole, hashes):
    monkeypatch.setattr(matching, "WHOLE", whole)
    monkeypatch.setattr(matching, "HASHES", hashes)
    texts, forms = spark.createDataFrame(TEXTS, "k long, t string"), spark.createDataFrame(FORMS, "form string, n long")
    got = [tuple(r) for r in matching.find_forms(texts, ("k",), "t", forms, "form").select("k", "form", "n").collect()]
    assert len(got) == len(set(got)) and set(got) == brute(TEXTS, FORMS)
    assert matching.find_forms(texts, ("k",), "t", forms.limit(0), "form").collect() == []
    assert matching.find_forms(texts.limit(0), ("k",), "t", forms, "form").collect() == []


def test_a_million_forms(spark):
    n = F.col("id")
    forms = spark.range(1_000_000).select(F.concat(F.lit("w"), n % 50_000, F.lit(" x"), n, F.when(n % 3 == 0, F.concat(F.lit(" y"), n % 7)).otherwise("")).alias("form"), n.alias("n"))
    # every word may begin a form, and few runs are one
    texts = spark.range(500).select("id", F.array_join(F.transform(F.sequence(F.lit(0), F.lit(199)), lambda i: F.concat(F.lit("w"), (n * 977 + i * 31) % 50_000, F.lit(" x"), F.when(i % 10 == 0, (n * 977 + i * 31) % 50_000 + 50_000).otherwise(7_000_000 + i))), " ").alias("t"))
    runs, known, few = matching.leaving_runs(texts, ("id",), "t", forms, "form")
    hits = matching.find_forms(texts, ("id",), "t", forms, "form")
    left, found = runs.count(), hits.count()
    assert not few and 0 < found <= left < 2 * found
    wanted = texts.select("id", F.explode(F.regexp_extract_all("t", F.lit(r"(w\d+ x\d+)"), F.lit(1))).alias("g")).distinct().join(forms.where("n % 3 <> 0").withColumnRenamed("form", "g"), "g").count()
    assert found == wanted


def retrieved(posts, statements, topics, k):
    """The k best statements of each post by its keywords, straight from the rule."""
    low = lambda t: " " + " ".join(w for w in re.split(r"[\W_]+", t.lower()) if w) + " "
    out = set()
    for post, text in posts:
        keys = {w.lower() for w in re.findall(r"[A-Z][a-z]{2,}", text)} - {"the", "and", "this", "that"} | {t for t in topics if f" {t} " in low(text)}
        scored = []
        for statement, question, answer, ordinal in statements:
            both = [w for w in keys if f" {w} " in low(f"{question} {answer}")]
            if both:
                scored.append((-len(both) - 0.5 * sum(f" {w} " in low(question) for w in both), ordinal, statement))
        out |= {(post, s, -score, n) for n, (score, _, s) in enumerate(sorted(scored)[:k], 1)}
    return out


@pytest.mark.parametrize("heavy, most", [(10**6, 6), (0, 6), (0, 2), (40, 1)])
def test_frequent_keywords_make_no_pairs(spark, heavy, most):
    rng = random.Random(heavy + most)
    names = ["Sun", "Moon", "Star", "Gold", "Iron", "Salt", "Wind", "Rain"]
    pick = lambda n: " ".join(rng.choices(names, [30, 20, 10, 5, 3, 2, 1, 1], k=n))
    posts = [(i, f"{pick(rng.randint(0, 3))} and old road") for i in range(40)] + [(98, ""), (99, "Unknown")]
    statements = [(f"s{i}", pick(rng.randint(0, 3)) + (" Old Road" if i % 9 == 0 else ""), pick(rng.randint(0, 4)), i * 3) for i in range(90)]
    frames = spark.createDataFrame(posts, "post_id long, text string"), spark.createDataFrame(statements, "statement_id string, question string, answer string, ordinal long")
    topics = spark.createDataFrame([("old road",), ("sun",)], "term string")
    got = [tuple(r) for r in evidence.retrieve_evidence(*frames, 4, topics=topics, heavy=heavy, most=most).collect()]
    assert len(got) == len(set(got)) and set(got) == retrieved(posts, statements, ["old road", "sun"], 4)

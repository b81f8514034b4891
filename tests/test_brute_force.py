"""Queries that SQL cannot express, on the smallest given tables, against plain Python that looks at every pair."""

import os
import random
import re
from difflib import SequenceMatcher, get_close_matches

import pytest

from factloom.operators.resolution import suggest_aliases
from factloom.plans import registry
from factloom.plans.evidence import RULES
from factloom.sources.tables import statements

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the given tables aren't here")


def run(spark, name):
    return registry.QUERIES[name](spark, FOLDER).collect()


def table(spark, name):
    return spark.read.parquet(f"{FOLDER}/{name}.parquet").collect()


def whole(needle):
    return re.compile(rf"(?<!\w){re.escape(needle)}(?!\w)", re.I)


def words(text):
    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


@pytest.fixture(scope="module")
def said(spark):
    return sorted((r.asDict() for r in statements(spark, FOLDER).collect()), key=lambda r: r["ordinal"])


@pytest.fixture(scope="module")
def claims(said):
    out = []
    for s in said:
        clean = lambda t, n: re.sub(r"[\W\d_]", "", (re.split(r"\s+", t) + [""] * 9)[n])
        name, value = clean(s["question"], 0), clean(s["answer"], 3)
        if len(name) >= 4 and len(value) >= 4:
            out.append({"claim_id": s["statement_id"], "name": name, "value": value})
    return out


def first_near(text, name, value, window):
    names = list(whole(name).finditer(text))
    for m in whole(value).finditer(text):
        if any(n.start() - m.end() <= window and m.start() - n.end() <= window for n in names):
            return m
    return None


DODGES, NEGATIONS, YES = RULES.dodge, RULES.negation, RULES.agreement


def judged(q, a, name, value):
    """(grade of proving, tier, rule) of a statement about a value that is one word."""
    text = f"{q} / {a}"
    around = lambda m, w: any(d in text.lower()[max(0, m.start() - w) : m.end() + w] for d in DODGES)
    denied = lambda m: any(whole(n).search(text[max(0, m.start() - 30) : m.start()]) for n in NEGATIONS)
    near, wide = first_near(text, name, value, 80), first_near(text, name, value, 150)
    agreed = whole(value).search(q) and a.lower().strip().startswith(YES) and not any(d in a.lower().strip() for d in DODGES)
    grade = None
    if near and not around(near, 80):
        grade = "contradict" if denied(near) else "support"
    elif agreed:
        grade = "support"
    elif wide and not around(wide, 150):
        grade = "context"
    if near:
        return grade, *((None, None) if around(near, 80) or denied(near) else ("canon", "near"))
    if agreed:
        return grade, "canon", "confirmed"
    if wide:
        return grade, *((None, None) if around(wide, 150) or denied(wide) else ("likely", "wide"))
    return grade, None, None


def test_proximity(spark, said, claims):
    by = {s["statement_id"]: s for s in said}
    want = {}
    for c in claims:
        s = by[c["claim_id"]]
        text = f"{s['question']} / {s['answer']}"
        m = first_near(text, c["name"], c["value"], 80)
        want[c["claim_id"]] = (m.start(), text[max(0, m.start() - 80) : m.end() + 80]) if m else (None, None)
    assert {r["claim_id"]: (r["at"], r["snippet"]) for r in run(spark, "f3_proximity_matches")} == want


def test_evidence(spark, said, claims):
    by, want = {s["statement_id"]: s for s in said}, set()
    for c in claims:
        _, tier, rule = judged(by[c["claim_id"]]["question"], by[c["claim_id"]]["answer"], c["name"], c["value"])
        if tier:
            want.add((c["claim_id"], tier, rule))
    assert {(r["claim_id"], r["tier"], r["rule"]) for r in run(spark, "f4_evaluate_evidence")} == want and want


@pytest.fixture(scope="module")
def verdicts(said, claims):
    """(claim, statement, grade, tier, rule) of all statements that hold a claim's name, in order."""
    held = [(s, set(words(f"{s['question']} / {s['answer']}"))) for s in said]
    out = []
    for c in claims:
        for s, w in held:
            if c["name"].lower() in w:
                grade, tier, rule = judged(s["question"], s["answer"], c["name"], c["value"])
                if grade or tier:
                    out.append((c["claim_id"], s["statement_id"], grade, tier, rule))
    return out


def test_verified_claims(spark, verdicts):
    want = {}
    for claim, statement, _, tier, rule in verdicts:
        if tier and (claim not in want or (want[claim][1] == "likely" and tier == "canon")):
            want[claim] = (statement, tier, rule)
    assert {r["claim_id"]: (r["statement_id"], r["tier"], r["rule"]) for r in run(spark, "f5_verify_claims")} == want and want


def test_verified_facts_carry_both_sources(spark, verdicts, claims):
    names = {}
    for c in claims:
        names[c["name"]] = names.get(c["name"], 0) + 1
    top = set(sorted(names, key=lambda n: (-names[n], n))[:100])
    known, seen = {c["claim_id"]: c for c in claims}, {v[0] for v in verdicts if v[3]}
    rows = run(spark, "f5_verified_facts")
    assert {r["claim_id"] for r in rows} == {i for i in seen if known[i]["name"] in top}
    for r in rows:
        c = known[r["claim_id"]]
        assert (r["page"], r["field"], r["value_at_verify"]) == (f"page/{c['name']}", "says", c["value"]) and r["statement_id"]


def test_proven_claims(spark, claims, verdicts):
    facts = {}
    for c in claims:
        facts.setdefault(c["name"], []).append((c["value"], "canon" if len(c["value"]) > 6 else "likely"))
    want = {}
    for c in claims:
        pro = [t for v, t in facts[c["name"]] if v.lower() == c["value"].lower()]
        con = [t for v, t in facts[c["name"]] if v.lower() != c["value"].lower()]
        grades = [g for i, _, g, _, _ in verdicts if i == c["claim_id"]]
        support, against = pro + ["canon"] * grades.count("support"), con + ["canon"] * grades.count("contradict")
        verdict = "contradicted" if "canon" in against else "confirmed" if "canon" in support else "likely" if support else "unknown"
        want[c["claim_id"]] = (len(support), len(against), verdict, min(8, grades.count("context")))
    assert {r["claim_id"]: (r["support"], r["contradict"], r["verdict"], r["context"]) for r in run(spark, "f7_prove_claims")} == want


def test_linked_texts(spark):
    forms = sorted({m[0] for r in table(spark, "benchmark") if (m := re.match(r"\S+ \S+", r["text"]))}, key=lambda f: (-len(f), f))
    forms = [f for f in forms if len(f) >= 3 and words(f)]
    pattern = re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, forms)) + r")(?!\w)", re.I)
    want = {r["doc_id"]: r["text"] and pattern.sub(lambda m: f"[[{m[0]}]]", r["text"]) for r in table(spark, "documents")}
    assert {r["doc_id"]: r["text"] for r in run(spark, "f2_linkify")} == want and any("[[" in (t or "") for t in want.values())


def grouped(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r["conv_id"], r["turn"])):
        out.setdefault(r["conv_id"], []).append((r["turn"], r["text"]))
    return out


def test_alignment(spark):
    turns = table(spark, "conversations")
    left, right = grouped(turns), grouped([r for r in turns if (r["conv_id"] + r["turn"]) % 3])
    ordered, best = set(), set()
    alike = lambda x, y: SequenceMatcher(None, x[:60].lower(), y[:60].lower()).ratio()
    squeezed = lambda t: re.sub(r"\s+", " ", t.lower())[:60]
    for conv, texts in left.items():
        others, at = right.get(conv, []), 0
        for n, (pos, text) in enumerate(texts):
            if others:
                ratios = [SequenceMatcher(None, squeezed(text), squeezed(o)).ratio() for _, o in others]
                if max(ratios) > 0.5:
                    best.add((conv, pos, others[ratios.index(max(ratios))][0]))
            if len(texts) == len(others):
                ordered.add((conv, pos, others[n][0]))
                continue
            window = [alike(text, o.upper()) for _, o in others[at : at + 5]]
            if window and max(window) > 0.7:
                ordered.add((conv, pos, others[at + window.index(max(window))][0]))
                at += window.index(max(window)) + 1
    assert {(r["grp"], r["left_pos"], r["right_pos"]) for r in run(spark, "c12_align_by_similarity")} == ordered
    assert {(r["grp"], r["left_pos"], r["right_pos"]) for r in run(spark, "c12_best_by_similarity")} == best


def close(names, known, n=8, begins=4):
    """The n closest by ratio of all known names, then the first few that begin alike."""
    out = set()
    for name in names:
        query = name.lower().strip()
        found = get_close_matches(query, [k.lower() for k, _ in known], n=n, cutoff=0.5)
        first = [k.lower() for k, _ in sorted(known, key=lambda k: (k[1], k[0].lower())) if k.lower().startswith(query[:4])][:begins]
        out |= {(name, k, rank) for rank, k in enumerate(list(dict.fromkeys(found + first))[:n], 1)}
    return out


def test_suggested_aliases(spark):
    known = sorted({r["p_name"] for r in table(spark, "part")})
    names = sorted({" ".join(reversed(k.split(" "))) for k in known})
    assert {(r["name"], r["alias"].lower(), r["rank"]) for r in run(spark, "c11_suggest_aliases")} == close(names, [(k, 0) for k in known])


@pytest.mark.parametrize("cell", [1 << 14, 7])
def test_suggestions_miss_no_pair(spark, cell):
    rng = random.Random(5)
    word = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    known = ["ab1cd2ef", "Zed", "z", "abcd", "x" * 90, "the same start one", "the same start two", "the same start 3", "the same start 4", "the same start 5", "été", ""]
    known += sorted({word("abcde ", rng.randint(1, 12)).strip() or "q" for _ in range(150)} | {word("abcdefghij0123", rng.randint(4, 30)) for _ in range(80)} | {"comm" + word("xyz", 6) for _ in range(60)})
    known = [(k, i * 7 % 311) for i, k in enumerate(dict.fromkeys(known))]
    names = ["ab3cd4ef", " ABCD ", "a", "", "zzzz", "the same start", "x" * 100, "Été!", "comm", "qwertz"] + [word("abcde ", rng.randint(1, 12)) for _ in range(60)] + [word("abcdefghij0123", rng.randint(4, 30)) for _ in range(40)]
    got = suggest_aliases(spark.createDataFrame([(x,) for x in names] + [(None,), ("a",)], "name string"), spark.createDataFrame(known + [(None, 1)], "alias string, ordinal long"), cell=cell).collect()
    assert len(got) == len({(r["name"], r["alias"]) for r in got})
    assert {(r["name"], r["alias"].lower(), r["rank"]) for r in got} == close(set(names), known)
    assert all(abs(r["ratio"] - SequenceMatcher(None, r["alias"].lower(), r["name"].lower().strip()).ratio()) < 1e-12 for r in got)
    assert ("ab3cd4ef", "ab1cd2ef") in {(r["name"], r["alias"]) for r in got}

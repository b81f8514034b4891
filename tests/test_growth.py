"""Jobs whose work has to grow with the input: what they repeat, move and gather."""

import collections
import datetime
import itertools
import os
import random
import re

import pytest

from factloom.operators import edges, evidence, gates, resolution, texts, timelines
from factloom.plans import registry

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_equal_searches_are_made_once(spark):
    titles = [("item", i, f"Supplier {i:04d}", None if i % 3 else i) for i in range(300)] + [("subject", i, f"ring {i % 7}", None) for i in range(40)]
    catalogue = spark.createDataFrame(titles, "kind string, item_id long, title string, first long")
    asked = [(i, [" 1", "12", "RING", "", None, "007"][i % 6], None if i % 5 == 0 else 250) for i in range(600)]
    queries = spark.createDataFrame(asked, "query_id long, text string, cutoff long")
    for small in (3, 100):
        found = evidence.search(queries, catalogue, {"subject": 2}, latest=100, small=small)
        assert not any("Window" in line and "query_id" in line for line in plan(found).splitlines())
        want = set()
        for q, text, cutoff in asked:
            t = (text or "").strip().lower()
            for kind, most in (("item", 5), ("subject", 2)):
                seen = [(title, i) for k, i, title, first in titles if t and k == kind and t in title.lower() and (first <= cutoff if first is not None and cutoff is not None else k == "subject" and first is None)]
                want |= {(q, kind, i, n + 1) for n, (_, i) in enumerate(sorted(seen)[:most])}
            if t.isdigit() and 1 <= int(t) <= 100:
                want.add((q, "position", int(t), 1))
        got = [tuple(r) for r in found.collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_short_series_share_a_pass_and_none_is_lost(spark):
    day = lambda n: datetime.date(2000, 1, 1) + datetime.timedelta(n)
    rows = [(s, p, day(100 - p), False, False) for s in (None, "a", "b") for p in range(10)]
    frame = spark.createDataFrame(rows, "series string, position long, day date, approximate boolean, hard boolean")
    for block in (4, 4096):
        done = timelines.enforce_increasing(frame, block=block)
        assert "FlatMapGroups" not in plan(done)
        got = {(r["series"], r["position"]): (r["day"], r["approximate"], r["warned"]) for r in done.collect()}
        assert got == {(s, p): (day(91 - 7 * (9 - p)), p < 9, False) for s in (None, "a", "b") for p in range(10)}


def test_equal_claims_are_graded_once(spark):
    claims = spark.createDataFrame([(i, "Ivan" if i % 2 else "Ivan Ann", "says", "river stone") for i in range(40)], "claim_id long, name string, predicate string, value string")
    texts = [("where is Ivan Ann?", "The river stone, says Ivan"), ("who?", "Ivan"), ("river stone", "IVAN_x river stone"), ("who is ivan", "RIVER  stone river stone")]
    statements = spark.createDataFrame([(str(i), i, q, a) for i, (q, a) in enumerate(texts)], "statement_id string, ordinal long, question string, answer string")
    calls = spark.sparkContext.accumulator(0)

    def judge(question, answer, name, value, variants):
        calls.add(1)
        return (f"{evidence.proximity(f'{question} / {answer}', name, value, 80)}",)

    got = {(r["name"], r["statement_id"], r["side"]) for r in evidence._heard(claims, statements, judge, ("side",)).collect()}
    assert got == {("Ivan", "0", "(25, 36)"), ("Ivan", "2", "None"), ("Ivan", "3", "(27, 38)"), ("Ivan Ann", "0", "(25, 36)")} and calls.value == 4
    rules = evidence.Rules((), (), (), ())
    best = evidence.verify_claims(claims, statements, rules).collect()
    assert {(r["claim_id"], r["statement_id"], r["tier"]) for r in best} == {(i, "0", "canon") for i in range(40)} and len(best) == 40
    facts = claims.select("name", "predicate", "value").withColumn("tier", evidence.F.lit("likely"))
    proved = evidence.prove_claims(claims, facts, statements, rules).collect()
    assert {(r["claim_id"], r["support"], r["contradict"], r["verdict"]) for r in proved} == {(i, 20 + (2 if i % 2 else 1), 0, "confirmed") for i in range(40)}


def test_words_are_found_as_by_pattern():
    for text in ("Ann_x ann ANN, 'Ann' Río RÍO rí", "ſtone Stone STONE İvan K k", ""):
        for needle in ("ann", "Ann", "río", "stone", "k", "ivan", "'ann'", "", "ann_x"):
            assert evidence._find(text, needle) == ([m.span() for m in evidence._whole(needle).finditer(text)] if needle else [])


def test_copies_meet_once(spark):
    """Equal records, overrides and groups are met once, and what they make is as before."""
    records = spark.createDataFrame([("ring", 1)] * 7 + [("red ring", 1)] * 5 + [("blue ring", 2), ("ring", None), (None, 1)], "name string, position int")
    split = resolution.find_split_records(records, run=4)
    assert sorted(map(tuple, split.collect())) == [("ring", "red ring", 1)] * 35
    joined = plan(split)[plan(split).index("Join") :]
    assert joined.count("Aggregate") == 2

    kinds = [(i, n, s) for i in range(4) for n, s in (("A", "b\nB\na"), ("A", None), (None, "c"))]
    frame = spark.createDataFrame([(j, n, s) for j, (_, n, s) in enumerate(kinds)], "id long, name string, names string")
    aliases = resolution.build_aliases(frame, spark.createDataFrame([("g", "A"), ("g", "Z"), ("h", "A")], "grp string, name string"))
    assert not any("Window" in line and "id#" in line for line in plan(aliases).splitlines())
    want = {(j, *a) for j, (_, n, s) in enumerate(kinds) if n for a in ([("b", 1), ("Z", 2)] if s else [("Z", 1)])}
    assert {tuple(r) for r in aliases.collect()} == want


def test_a_fact_meets_one_override_of_a_kind(spark):
    facts = spark.createDataFrame([(i, i % 3, "R" if i % 2 else None, None, 6, None, None) for i in range(12)], "fact_id long, subject int, predicate string, reveal int, own int, cited int, volume int")
    rows = [(None, 0, None, 100 + j, j) for j in range(50)] + [(None, 0, "R", None, 7), (None, None, "R", 50, 3), (4, None, None, 40, 9), (4, 2, None, 41, 1), (None, None, None, 1, 0)]
    overrides = spark.createDataFrame(rows, "fact_id long, subject int, predicate string, reveal int, ordinal long")
    none = lambda a, b: spark.createDataFrame([], f"{a} int, {b} int")
    got = gates.derive_reveal(facts, none("volume", "last"), overrides, none("subject", "debut"))
    assert "Union" not in plan(got)
    want = {}
    for i in range(12):
        s, p = i % 3, "R" if i % 2 else None
        fit = [(-(100 * (f is not None) + 10 * (a is not None) + (b is not None)), o, r) for f, a, b, r, o in rows if any(x is not None for x in (f, a, b)) and f in (None, i) and a in (None, s) and b in (None, p)]
        over = min(fit, key=lambda x: x[:2])[2] if fit else None
        want[i] = (over, "override") if over is not None else (6, "first-position")
    assert {r["fact_id"]: (r["reveal"], r["reason"]) for r in got.collect()} == want


def test_assets_meet_members_in_lists(spark):
    assets = spark.createDataFrame([("a", i) for i in range(20)] + [("a", None), ("b", 7), (None, 1)], "grp string, asset int")
    members = spark.createDataFrame([("a", 1, True), ("b", 2, False), ("b", 3, None), ("c", 4, True), (None, 5, True)], "grp string, member int, current boolean")
    found = edges.edges_fan_out(assets, members, block=4)
    assert "repartition" in plan(found).lower() and "collect_list" in plan(found)
    want = {(1, a, None, "one of 21") for a in [*range(20), None]} | {(2, 7, False, None), (3, 7, None, None)}
    rows = [tuple(r) for r in found.collect()]
    assert set(rows) == want and len(rows) == len(want)


def test_entries_without_a_key_lie_apart_and_json_is_parsed_once(spark):
    entries = spark.createDataFrame([(i, None, ["Film 1999", "Episode 5", "some day", None][i % 4], []) for i in range(40)], "entry_id long, rungs array<struct<ch:int>>, explicit string, users array<string>")
    films = spark.createDataFrame([(1999, 9)], "year int, gate int")
    episodes = spark.createDataFrame([(5, [50])], "key long, positions array<int>")
    got = gates.derive_gates(entries, spark.createDataFrame([], "name string, debut int"), films, episodes)
    assert any("Join LeftOuter" in line and "pmod" in line for line in plan(got).splitlines())
    assert {r["entry_id"]: (r["gate"], r["source"]) for r in got.collect()} == {i: [(9, "film"), (50, "episode"), (None, "none"), (None, "none")][i % 4] for i in range(40)}
    text = spark.createDataFrame([('{"b":1.0,"a":[2e0]}',), ("1.50",), ("{x",)], "t string").select(edges.canonical(edges.F.col("t")).alias("c"))
    assert [r["c"] for r in text.collect()] == ['{"a":[2],"b":1}', "1.5", "{x"] and plan(text).lower().count("parse_json") + plan(text).count("parseJson") == 1


def test_values_of_boxes_are_freed_of_markup(spark):
    frame = spark.createDataFrame([(1, "{{box|a={{ref|x}}|b=<b>y</b> [[p|q]]|c=y q|d={{n|1|{{m}}}}z}}")], "k int, t string")
    got = texts.parse_infobox(frame, "k", "t", "box", {"one": ["a", "b"], "two": ["b", "c", "d"]}, ("two",), cleaned=True).first()
    assert (got["one"], got["two"]) == ("y q", "y q · z")


def test_most_alike_texts_meet_in_cells(spark):
    from difflib import SequenceMatcher

    chance = random.Random(3)
    made = lambda: "".join(chance.choice("abc  de") for _ in range(chance.randrange(0, 70)))
    texts = [made() for _ in range(60)] + ["", "", None]
    left = [(g, i, chance.choice(texts)) for g in (1, 2, 3, None) for i in range({2: 150}.get(g, 6))]
    left += [left[0], left[0], (9, 1, "without a right side"), (2, None, "aabbcc")]
    right = [(g, i % 70, chance.choice(texts + [made().upper(), made()])) for g in (1, 2, 3, None) for i in range({2: 90}.get(g, 4))] + [(1, None, "abc de"), (8, 1, "alone")]
    schema = "grp long, pos long, text string"
    shown = lambda t: re.sub(r"\s+", " ", t.lower())[:60]
    want = []
    for g, i, t in left:
        others = sorted((p is not None, p or 0, shown(o)) for k, p, o in right if k == g and o is not None) if g is not None and t is not None else []
        ratios = [SequenceMatcher(None, shown(t), o).ratio() for _, _, o in others]
        if ratios and max(ratios) > 0.5:
            known, pos, _ = others[ratios.index(max(ratios))]
            want.append((g, i, pos if known else None, max(ratios)))
    a, b = spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)
    whole = resolution.best_by_similarity(a, b, "grp")
    assert "collect_list" not in plan(whole)  # no row holds a group's whole right side
    for found in (whole, resolution.best_by_similarity(a, b, "grp", cell=(16, 8))):
        assert found.columns == ["grp", "left_pos", "right_pos", "ratio"]
        assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)
    calls = 0
    for x, y in [(chance.choice(texts) or "", chance.choice(texts) or "") for _ in range(300)]:
        matcher = SequenceMatcher(None, x, y)
        ratio, find = matcher.ratio(), matcher.find_longest_match

        def counted(*part):
            nonlocal calls
            calls += 1
            return find(*part)

        matcher.find_longest_match = counted
        assert resolution._ratio_over(matcher, -1.0) == ratio and resolution._ratio_over(matcher, ratio) is None
        calls = 0
        assert (resolution._ratio_over(matcher, 0.99) is not None) == (ratio > 0.99) and (calls < 3 or ratio > 0.9)


def test_plain_words_are_heard_together(spark, monkeypatch):
    """No pair of a claim and a statement is made for plain words, and each outcome is as by judging every pair."""
    chance = random.Random(5)
    rules = evidence.Rules(("no comment", "b", "zzz d"), ("not", "ann-", "Ñu"), ("yes", "to"), ("lol",), 20, 45, 9)
    vocabulary = "ann Ann ANN bob río RÍO stone Stone 1987 87 not hardly yes to lol no comment zzz d ñu ann- a_b ann_x, so it is. x y straße ÿ".split()
    odd = ["ſtone", "K", "İstone", "Ÿ", "œuvre", "STRAẞE", "日本"]
    made = lambda n, more: " ".join(chance.choice(vocabulary + more) for _ in range(chance.randrange(n)))
    texts = [(f"s{i % 50}{i}", i // 2 if i % 9 else None, made(9, odd * (i % 4 == 0)), chance.choice(["", "yes ", "to "]) + made(30, odd * (i % 4 == 0))) for i in range(150)] + [("none", 5, None, "ann bob")]
    words = ["Ann", "ann", "bob", "RÍO", "stone", "1987", "87", "not", "x", "straße", "ÿ", "k", "zzz", "œuvre", "a_b", "ann\n", "", None]
    claims = [(i, n, "says", v) for i, (n, v) in enumerate((n, v) for n in words for v in [*words, "ann bob", "no 87", "1,987"])]
    statements = spark.createDataFrame(texts, "statement_id string, ordinal long, question string, answer string")
    frame = spark.createDataFrame(claims, "claim_id long, name string, predicate string, value string")
    variants = {r["value"]: r["v"] for r in frame.select("value").distinct().select("value", evidence.value_variants(evidence.F.col("value")).alias("v")).collect()}
    split = lambda t: f" {' '.join(re.findall(r'[^\W_]+', t.lower()))} "
    strange = re.compile("[İıŸſẞ\u212a\u212b]")
    held = [(k, o, q or "", a or "", split(f"{q or ''} / {a or ''}")) for k, o, q, a in texts]
    plain = {tuple(r) for r in frame.where(evidence.plain(evidence.F.col("name"), evidence.F.col("value"))).select("name", "value").distinct().collect()}
    best, sides, usual = {}, {}, {}
    for n, v in {(n, v) for _, n, _, v in claims if n and v}:
        heard = [(k, o, strange.search(q + a), evidence.grade(q, a, n, v, variants[v], rules), evidence.evaluate(q, a, n, v, variants[v], rules)) for k, o, q, a, t in held if split(n) in t]
        for into, ok in ((best, [x for x in heard if (n, v) in plain]), (usual, [x for x in heard if not x[2]])):
            if found := [(e[0] != "canon", o is not None, o or 0, k, e) for k, o, _, _, e in ok if e]:
                into[n, v] = min(found)[3:]
        sides |= {(n, v, s): c for s in ("support", "contradict", "context") if (n, v) in plain and (c := sum(g == s for *_, g, _ in heard))}
    assert {e[2] for _, e in best.values()} == {"near", "wide", "confirmed"} and {e[1] for _, e in best.values()} > {"joke", "serious"}
    odds = sum(bool(strange.search((q or "") + a)) for _, _, q, a in texts)
    assert len(plain) == 13 * 13 and 0 < odds < 40
    clear = statements.where(f"not rlike(concat_ws(' ', question, answer), '{strange.pattern}')")
    alone = frame.where(evidence.plain(evidence.F.col("name"), evidence.F.col("value")))
    for size, least in ((1 << 19, 1 << 18), (20, 300)):
        monkeypatch.setitem(evidence.hear.__globals__, "PAIRS", size)
        monkeypatch.setitem(evidence.hear.__globals__, "CHARACTERS", least)
        for asked, said, want in ((alone, statements, best), (frame, clear, usual)):
            got = evidence.verify_claims(asked, said, rules).collect()
            assert {r["claim_id"]: (r["statement_id"], (r["tier"], r["intent"], r["rule"])) for r in got} == {i: want[n, v] for i, n, _, v in claims if (n, v) in want} and len(got) == len({r["claim_id"] for r in got})
        calls = spark.sparkContext.accumulator(0)

        def whole(question, answer, name, value, variants):
            calls.add(1)
            return (got,) if (got := evidence.grade(question, answer, name, value, variants, rules)) is not None else None

        judge = evidence.Judge(rules, whole, lambda seen: (got,) if (got := evidence.grade_seen(seen)) is not None else None, ("side",))
        counts = {}
        for r in evidence._told(alone, statements, judge).collect():
            counts[r["name"], r["value"], r["side"]] = counts.get((r["name"], r["value"], r["side"]), 0) + r["_k"]
        assert counts == sides and 0 < calls.value <= odds * len(plain)
    before = calls.value
    assert evidence._told(alone, clear, judge).count() and calls.value == before


def test_facts_meet_values_by_key(spark):
    """A name's claims and facts meet where values may be equivalent, the other facts are counted as what is left."""
    values = ["Ring", "ring (old)", "(old)", "RING  (new) ", "", " ", "12 and 7", "7", "no 12", "7, 12", "77", "(7)", "a 7 b", None]
    claims = [(i, n, p, v) for i, (n, p, v) in enumerate((n, p, v) for n in ("Ann", "Bob", None) for p in ("says", None) for v in values)]
    told = [("Ann", "says", v, t) for v in values for t in ("canon", "likely", None)] + [("Ann", "says", "ring", "canon")] * 3 + [("Bob", None, "ring", "canon"), (None, "says", "ring", "canon"), ("Bob", "says", "ring", "likely")]
    schema = "name string, predicate string, value string"
    asked, facts = spark.createDataFrame(claims, "claim_id long, " + schema), spark.createDataFrame(told, schema + ", tier string")
    pair = evidence.F.struct(evidence.F.col("a.value").alias("a"), evidence.F.col("b.value").alias("b"), evidence.equivalent(evidence.F.col("a.value"), evidence.F.col("b.value")).alias("same"))
    seen = asked.select("value").distinct().alias("a").crossJoin(facts.select("value").distinct().alias("b")).select(pair.alias("p")).collect()
    same = {(r["p"]["a"], r["p"]["b"]) for r in seen if r["p"]["same"]}
    assert {("12 and 7", "7"), ("7", "(7)"), ("Ring", "RING  (new) "), ("no 12", "7, 12")} <= same and ("77", "7") not in same
    statements = spark.createDataFrame([], "statement_id string, ordinal long, question string, answer string")
    found = evidence.prove_claims(asked, facts, statements, evidence.Rules((), (), (), ()))
    joins = [line for line in plan(found).splitlines() if "Join" in line]
    assert any("_key" in line for line in joins) and all("_key" in line for line in joins if "regexp" in line)
    want = {}
    for i, n, p, v in claims:
        own = [(w, t) for m, q, w, t in told if n is not None and p is not None and (m, q) == (n, p)]
        pro, con = ([t for w, t in own if ((v, w) in same) == side] for side in (True, False))
        want[i] = (len(pro), len(con), "contradicted" if "canon" in con else "confirmed" if "canon" in pro else "likely" if pro else "unknown", 0)
    got = found.collect()
    assert {r["claim_id"]: (r["support"], r["contradict"], r["verdict"], r["context"]) for r in got} == want and len(got) == len(claims)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the given tables aren't here")
def test_statements_are_paired_once_for_all_uses_of_claims(spark):
    for name in ("f5_verified_facts", "f7_prove_claims"):
        found = registry.QUERIES[name](spark, FOLDER)
        assert sum("Window [lead" in line for line in plan(found).splitlines()) == 1 and not any("MapInArrow" in line and "variants" in line for line in plan(found).splitlines())


def test_members_and_assets_meet_list_by_list(spark):
    """Each member's copies meet each asset's, and a task's rows of a group and of a list of assets lie side by side."""
    assets = spark.createDataFrame([("a", i) for i in range(40)] + [("b", 7)] + [("c", i % 3 or None) for i in range(9)] + [("d", 1), (None, 1)], "grp string, asset int")
    members = spark.createDataFrame([("abce"[i % 4] if i % 50 else None, i // 3, i % 2 == 0) for i in range(4000)] + [("c", 5, None), ("c", None, True)] * 3, "grp string, member int, current boolean")
    groups, own = {}, collections.Counter()
    for g, a in assets.collect():
        groups.setdefault(g, []).append(a)
    for g, m, current in members.collect():
        for a in groups.get(g, []) if g else []:
            own[m, a, current if len(groups[g]) == 1 else None, f"one of {len(groups[g])}" if len(groups[g]) > 1 else None] += 1
    found = edges.edges_fan_out(assets, members, block=16).withColumn("_p", evidence.F.spark_partition_id()).collect()
    assert collections.Counter(tuple(r)[:4] for r in found) == own
    tasks = [[r["note"] for r in rows] for _, rows in itertools.groupby(found, lambda r: r["_p"])]
    assert len(tasks) > 4 and max(map(len, tasks)) < 2.5 * len(found) / 8
    for rows in tasks:
        runs = [k for k, _ in itertools.groupby(rows)]
        assert len(runs) == len(set(runs))
    lists = [[r["to_id"] for r in rows] for (_, note), rows in itertools.groupby(found, lambda r: (r["_p"], r["note"])) if note == "one of 40"]
    assert all(len({tuple(x[i : i + 8]) for i in range(0, len(x), 8)}) <= 5 for x in lists)  # the same lists again and again

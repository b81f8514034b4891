"""Examples of single operators that need their branches shown."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from factloom.functions import text as t
from factloom.operators import edges, evidence, facts, gates, profile, reconcile, resolution, statements, texts, timelines
from factloom.operators.pages import image_alt_audit
from factloom.sources import catalogue

RULES = evidence.Rules(dodge=("ask again", "no comment"), negation=("not", "never"), agreement=("sure", "so it is"), joke=("only teasing",))
EVIDENCE = [
    ("Does Adah like oranges?", "Adah likes oranges a lot.", ("canon", "serious", "near")),
    ("What of Adah?", "Adah is not fond of oranges.", None),
    ("What of Adah?", "Oranges? No comment, Adah. Later: Adah has oranges.", None),
    ("Is it true about oranges?", "So it is, quite.", ("canon", "confirmation", "confirmed")),
    ("Is it true about oranges?", "Sure, but ask again.", None),
    ("Adah " + "x " * 60 + "oranges", "ok", ("likely", "serious", "wide")),
    ("Adah likes oranges", "well, only teasing", ("canon", "joke", "near")),
    ("nothing", "at all", None),
]


@pytest.mark.parametrize("question,answer,want", EVIDENCE)
def test_evidence_branches(question, answer, want):
    assert evidence.evaluate(question, answer, "Adah", "oranges", ["oranges", "oranges"], RULES) == want


def test_evidence_by_variant_and_digits():
    assert evidence.evaluate("q", "Adah has 1500 coins", "Adah", "1,500 (old)", ["1,500 (old)", "1,500", "1500"], RULES) == ("likely", "serious", "variant")
    assert evidence.evaluate("q", "Adah is 87 or so", "Adah", "87cm", ["87cm"], RULES) == ("likely", "ambiguous", "digits")


def test_verify_takes_the_earliest_canon_statement(spark):
    rows = [("s1", 1, "Adah", "x " * 60 + "oranges"), ("s2", 2, "What?", "Adah likes oranges."), ("s3", 3, "What?", "Adah likes oranges."), ("s4", 4, "What?", "Bert sleeps.")]
    s = spark.createDataFrame(rows, "statement_id string, ordinal long, question string, answer string")
    claims = spark.createDataFrame([(1, "Adah", "likes", "oranges"), (2, "Bert", "likes", "oranges"), (3, "Adah", "likes", None)], "claim_id long, name string, predicate string, value string")
    got = evidence.verify_claims(claims, s, RULES).collect()
    assert [(r["claim_id"], r["statement_id"], r["tier"]) for r in got] == [(1, "s2", "canon")]
    f = spark.createDataFrame([("Bert", "likes", "sleep", "canon")], "name string, predicate string, value string, tier string")
    verdicts = {r["claim_id"]: r["verdict"] for r in evidence.prove_claims(claims, f, s, RULES).collect()}
    assert verdicts[1] == "confirmed" and verdicts[2] == "contradicted"


def test_prove_counts_every_statement(spark):
    far = "Adah " + "x " * 50 + "plums"
    rows = [("s1", 1, "What?", "Adah likes pears."), ("s2", 2, "Does Adah like pears?", "Sure"), ("s3", 3, "What?", "Adah never likes figs."), ("s4", 4, "What?", "Adah likes figs."), ("s5", 5, "What?", far)]
    s = spark.createDataFrame(rows, "statement_id string, ordinal long, question string, answer string")
    claims = spark.createDataFrame([(1, "Adah", "likes", "pears"), (2, "Adah", "likes", "figs"), (3, "Adah", "likes", "plums"), (4, "Adah", "likes", None)], "claim_id long, name string, predicate string, value string")
    f = spark.createDataFrame([("Bert", "likes", "sleep", "canon")], "name string, predicate string, value string, tier string")
    got = {r["claim_id"]: tuple(r)[1:] for r in evidence.prove_claims(claims, f, s, RULES).collect()}
    assert got == {1: (2, 0, "confirmed", "canon", 0), 2: (1, 1, "contradicted", "disproven", 0), 3: (0, 0, "unknown", "speculation", 1), 4: (0, 0, "unknown", "speculation", 0)}


def test_authority_only_overrides_from_the_gap_on(spark):
    first = spark.createDataFrame([("A", 10, "cover"), ("B", 10, "cover"), ("C", 10, "cover")], "subject string, position int, kind string")
    records = spark.createDataFrame([("a", 5), ("b", 6), ("c", 90)], "subject string, position int")
    got = {r["subject"]: (r["position"], r["kind"], r["overridden"]) for r in facts.apply_authority(first, records).collect()}
    assert got == {"A": (5, "full", True), "B": (10, "cover", False), "C": (10, "cover", False)}


def test_first_rows_win_ties(spark):
    obs = spark.createDataFrame([(3, "x", "cover", 2), (3, "x", "full", 1), (5, "x", "full", 0), (None, "x", "full", 9)], "position int, subject string, kind string, ordinal long")
    assert facts.debuts(obs.where("position is not null")).first()["kind"] == "full"
    got = {r["predicate"]: (r["value"], list(r["positions"])) for r in facts.derive_facts(obs).collect()}
    assert got == {"first_position": (3, [3]), "appearances": (2, [3, 5]), "cover_appearances": (1, [3])}


def test_conflicts_compare_with_the_first_only(spark):
    rows = [("s", "age", "19 (then 21)", 0), ("s", "age", "21", 1), ("s", "age", "19", 2), ("u", "age", "7", 0), ("u", "age", "8", 1), ("u", "note", "a", 0), ("u", "note", "b", 1)]
    f = spark.createDataFrame(rows, "subject string, predicate string, value string, ordinal long")
    got = [(r["subject"], r["predicate"]) for r in reconcile.find_conflicts(f, ("note",)).collect()]
    assert got == [("u", "age")]


def test_slugs_see_natural_numbers(spark):
    base = spark.createDataFrame([("x", 1), ("x", 2), ("x-2", 3), ("y", 4)], "base string, ordinal long")
    taken = spark.createDataFrame([("y",), ("y-2",)], "slug string")
    got = {r["ordinal"]: r["slug"] for r in resolution.unique_slugs(base, taken).collect()}
    assert got == {1: "x", 2: "x-2", 3: "x-2-2", 4: "y-3"}


def test_loose_names(spark):
    records = spark.createDataFrame([("K-Row",), ("Marlo Karp",)], "name string")
    index = spark.createDataFrame([("old miller", "K-Row")], "alias_key string, name string")
    names = spark.createDataFrame([("K Row",), ("Marlo Carp (Jr.)",), ("Old Miller the Great",), ("nobody",), (None,)], "n string")
    got = {r["n"]: (r["record"], r["how"]) for r in resolution.resolve_loose(names, "n", records, index).collect()}
    assert got == {"K Row": ("K-Row", "name"), "Marlo Carp (Jr.)": ("Marlo Karp", "swapped"), "Old Miller the Great": ("K-Row", "alias")}


def test_asof_over_ranges(spark):
    events = spark.createDataFrame([(k,) for k in (-5, 1, 10, 4000, 9000, 50000)], "key long")
    mapping = spark.createDataFrame([(1, [3, 9]), (8999, [7])], "key long, positions array<int>")
    got = {r["key"]: (r["position"], r["how"]) for r in edges.asof_position(events, mapping).collect()}
    assert got == {-5: (9, "filler"), 1: (9, "exact"), 10: (7, "filler"), 4000: (7, "filler"), 9000: (7, "filler"), 50000: (7, "filler")}


def test_owner_chain_resets_after_an_unknown_link(spark):
    chains = spark.createDataFrame([("i", 0, "A", False), ("i", 1, "?", False), ("i", 2, "B", True)], "item_id string, pos int, owner string, current boolean")
    index = spark.createDataFrame([("a", "id:a"), ("b", "id:b")], "alias_key string, entity_id string")
    got = {r["from_id"]: r["from_owner"] for r in edges.edges_owns(chains, index).collect()}
    assert got == {"id:a": None, "id:b": None}


ENTRIES = "entry_id long, fields map<string,string>, gate int, rungs array<struct<ch:int,max_ch:int,fields:map<string,string>>>"


def test_rungs_take_the_highest_earned(spark):
    rows = [
        (1, {"label": "base", "text": "old", "_note": "x"}, 5, [(10, 20, {"label": "early"}), (15, None, {"label": "late"}), (15, None, {"text": None, "image": "a.png"}), (None, None, {"label": "?"})]),
        (2, {"label": "base"}, 7, []),
        (3, {"label": "base"}, 7, [(99, None, {"label": "never"})]),
        (4, None, None, [(3, None, {"label": "new"})]),
        (5, {"label": "kept"}, 9, [(3, 8, None), (2, None, None)]),
        (6, None, None, None),
    ]
    e = spark.createDataFrame(rows, ENTRIES)
    at = lambda c: {r["entry_id"]: (r["fields"], r["gate"]) for r in gates.resolve_rungs(e, c).collect()}
    same = {2: ({"label": "base"}, 7), 4: ({"label": "new"}, 3), 5: ({"label": "kept"}, 2), 6: (None, None)}
    assert at(25) == same | {1: ({"label": "base", "_note": "x", "text": None, "image": "a.png"}, 15)}
    assert at(14) == same | {1: ({"label": "early", "text": "old", "_note": "x"}, 10)}
    assert at(8)[5] == ({"label": "kept"}, 3) and 1 not in at(8) and at(100)[3] == ({"label": "never"}, 99)
    assert gates.resolve_rungs(e.limit(0), 5).collect() == []


def test_entries_are_judged_as_they_are_resolved(spark):
    rows = [
        (1, {"text": "the golden key"}, 2, [(4, None, {"text": "a key"}), (8, None, {"label": "Golden!"})]),
        (2, {"text": "the golden key"}, 2, []),
        (3, {"text": "nothing"}, None, []),
        (4, {"text": "nothing", "_draft": "golden", "secret": "golden"}, 2, None),
        (5, {"text": "nothing"}, 2, [(7, None, {"text": "something"})]),
    ]
    e, lexicon = spark.createDataFrame(rows, ENTRIES), spark.createDataFrame([("golden", 9), ("key", 1)], "term string, ch int")
    seen = lambda c: {r["entry_id"]: r["fields"].get("text") for r in gates.visible_at(e, c, lexicon, 50, ("secret",)).collect()}
    assert seen(3) == {4: "nothing"} and seen(5) == {1: "a key", 4: "nothing"} and seen(8) == {4: "nothing", 5: "something"}
    assert seen(9) == {1: "the golden key", 2: "the golden key", 4: "nothing", 5: "something"} and seen(50) == seen(9) | {3: "nothing"}
    leaks = {tuple(r) for r in gates.version_leaks(e, lexicon, [1, 3, 5, 8, 9], ("secret",)).select("entry_id", "field", "term", "cutoff").collect()}
    assert leaks == {(1, "label", "golden", 8), (1, "text", "golden", 8), (2, "text", "golden", 3)}
    assert {tuple(r) for r in gates.rung_leaks(e, lexicon).collect()} == {(1, 8, "label", "golden", 9)}


def test_terms_of_several_words(spark):
    e = spark.createDataFrame([(1, "The North Road, at last", 3), (2, "north old road", 3), (3, "", 3), (4, None, 3)], "entry_id long, text string, gate int")
    lexicon = spark.createDataFrame([("north road", 9)], "term string, ch int")
    got = {r["entry_id"]: r["gate"] for r in gates.raise_for_terms(e, lexicon).collect()}
    assert got == {1: 9, 2: 3, 3: 3, 4: 3}


def test_dates_are_made_to_increase(spark):
    day = lambda n: dt.date(2020, 1, 1) + dt.timedelta(days=n)
    rows = [(1, 1, day(30), False, False), (1, 2, day(10), False, True), (1, 3, day(8), False, False), (1, 4, day(20), False, False)]
    tl = spark.createDataFrame(rows, "series long, position long, day date, approximate boolean, hard boolean")
    got = [(r["position"], r["day"], r["approximate"], r["warned"]) for r in timelines.enforce_increasing(tl).orderBy("position").collect()]
    assert got == [(1, day(3), True, False), (2, day(10), False, True), (3, day(8), False, False), (4, day(20), False, False)]


def test_markup_tables_and_boxes(spark):
    df = spark.createDataFrame([(1, "{{Box|a=x [[p|q]]|b={{n|1|2}}y|c=}}", "[[File:a.png|x]]'''B''' {{t|{{u}}}}[[p|q]]<ref>z</ref>")], "k long, box string, m string")
    r = texts.parse_infobox(df, "k", "box", "box", {"one": ["zz", "a"], "two": ["b", "c"]}, ("two",)).first()
    assert (r["one"], r["two"]) == ("x [[p|q]]", "{{n|1|2}}y")
    assert df.select(t.strip_markup(F.col("m"))).first()[0] == "B q"
    image = image_alt_audit(spark.createDataFrame([(1, '<p>\n<img src="a">\n<img alt="" src="b"><img src="${c}">')], "page_id long, html string"))
    assert sorted((r["line"], r["verdict"]) for r in image.collect()) == [(2, "missing"), (3, "empty")]


def test_pairs_of_turns(spark):
    rows = [(1, 0, "user", "first question"), (1, 1, "system", "ignored text"), (1, 2, "assistant", "the answer"), (1, 3, "user", "second one"), (1, 4, "user", "third one"), (1, 5, "assistant", "ok"), (1, 6, "assistant", "more")]
    got = statements.pair_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert [(r["turn"], r["answer"]) for r in got] == [(0, "the answer")]


def test_round_trips(spark, tmp_path):
    (tmp_path / "log.csv").write_text("chapter,name,type\n1, A ,Cover\nx,B,full\n2,,full\n3,C,\n")
    assert sorted(map(tuple, catalogue.read_observations(spark, str(tmp_path / "log.csv")).collect())) == [(1, "A", "cover"), (3, "C", "full")]
    (tmp_path / "m.json").write_text('﻿{"x": {"size": 1}, "note": "text", "y": {"size": 2}}')
    assert sorted(map(tuple, catalogue.read_records(spark, str(tmp_path / "m.json"), "map", "size int").collect())) == [("x", 1), ("y", 2)]
    (tmp_path / "w.json").write_text('{"teams": [{"size": 3}, 7]}')
    assert [r["size"] for r in catalogue.read_records(spark, str(tmp_path / "w.json"), "wrapped", "size int", "teams").collect()] == [3]


def test_gaps_and_groups(spark):
    df = spark.createDataFrame([(1,), (4,), (6,)], "n long")
    assert sorted(r["n"] for r in profile.sequence_gaps(df, "n", spark.createDataFrame([(5,)], "n int")).collect()) == [2, 3]
    assert profile.sequence_gaps(df.where("n > 9"), "n").count() == 0


def test_links_take_the_longest_form(spark):
    docs = spark.createDataFrame([(1, "Blue Ring and blue sea, bluering"), (2, None), (3, "none")], "k long, text string")
    names = spark.createDataFrame([("blue",), ("blue ring",), ("an",)], "form string")
    got = {r["k"]: r["text"] for r in evidence.linkify(docs, "k", "text", names).collect()}
    assert got == {1: "[[Blue Ring]] and [[blue]] sea, bluering", 2: None, 3: "none"}


def test_forms_of_any_length(spark):
    long = "one two three four five six seven"
    docs = spark.createDataFrame([(1, f"Well, {long.upper()}; eight"), (2, "one two three four five six"), (3, None), (4, "Émile-Zola street")], "k long, text string")
    names = spark.createDataFrame([("L", long), ("Z", "émile zola"), ("none", "..."), ("S", "street")], "name string, form string")
    assert sorted((r["name"], r["k"]) for r in evidence.mentions(names, docs, "k", "text").collect()) == [("L", 1), ("S", 4), ("Z", 4)]
    assert evidence.mentions(names.where("name = 'none'"), docs, "k", "text").count() == 0
    entries = spark.createDataFrame([(1, {"text": f"of {long}"}, 3, None)], ENTRIES)
    assert gates.visible_at(entries, 5, spark.createDataFrame([(long, 9)], "term string, ch int"), 100).count() == 0


def test_brackets_alone_are_no_value(spark):
    rows = spark.createDataFrame([("(x)", "(y)"), ("(x)", "(X)"), ("", ""), (None, "a"), ("a (x)", "A (y)"), ("1 (x)", "2 (y)")], "a string, b string")
    assert [r["s"] for r in rows.select(t.equivalent(F.col("a"), F.col("b")).alias("s")).collect()] == [False, True, True, False, True, False]


def test_first_of_repeated_keys_and_equal_numbers(spark):
    a = spark.createDataFrame([(1, "2", 0), (1, "1", 1), (2, "x", 0), (None, "9", 0)], "k long, v string, n int")
    b = spark.createDataFrame([(1, "2.0", 0), (2, "x.0", 0), (None, "9.00", 0)], "k long, v string, n int")
    assert [(r["k"], r["field"], r["old"], r["new"]) for r in edges.diff_tables(a, b, "k", ["v"], "n").collect()] == [(2, "v", "x", "x.0")]


def test_plain_slugs_are_numbered(spark):
    base = spark.createDataFrame([("unknown", i * 7) for i in range(50)] + [("y", 3)], "base string, ordinal long")
    got = {r["ordinal"]: r["slug"] for r in resolution.unique_slugs(base, spark.createDataFrame([], "slug string")).collect()}
    assert got[0] == "unknown" and got[7] == "unknown-2" and got[49 * 7] == "unknown-50" and got[3] == "y"


def test_repeated_events_and_groups_of_positions(spark):
    events = spark.createDataFrame([("a", 5), ("a", 5), ("b", 5), ("a", None)], "g string, key long")
    mapping = spark.createDataFrame([("a", 9, [1, 4]), ("b", 2, [8])], "g string, key long, positions array<int>")
    got = sorted((r["g"], r["key"], r["position"], r["how"]) for r in edges.asof_position(events, mapping, ("g",)).collect())
    assert got == [("a", 5, 4, "filler"), ("a", 5, 4, "filler"), ("b", 5, 8, "filler")]


def test_nested_values_have_one_form(spark):
    same = [('{"a":1,"b":2}', '{"b":2.0,"a":1}'), ('[1.0, {"z":1e0,"y":[10.50]}]', '[1,{"y":[10.5],"z":1}]'), ("[1E22]", "[10000000000000000000000]"), ("[1e-7, -0.0]", "[0.0000001, 0]"), (" {} ", "{}"), ('{"é":"\\u00e9"}', '{"é":"é"}'), ("2.0", "2"), ('["a\\"1.0"]', '["a\\"1.0"]'), (None, None)]
    other = [("[1,2]", "[2,1]"), ('{"a":"1.0"}', '{"a":"1"}'), ('{"a":1}', '{"a":"1"}'), ('{"a":null}', "{}"), ("[1.5]", "[1]"), ('["1E2"]', '["100"]'), ('{"a":{"b":1}}', '{"a":{"b":2}}'), ("{bad}", "{bad }"), ("", None), ("[9007199254740993]", "[9007199254740992]")]
    frame = lambda rows, side: spark.createDataFrame([(i, r[side]) for i, r in enumerate(rows)], "k long, v string")
    assert edges.diff_tables(frame(same, 0), frame(same, 1), "k", ["v"]).collect() == []
    assert edges.diff_tables(frame(other, 0), frame(other, 1), "k", ["v"]).count() == len(other)
    typed = spark.createDataFrame([(1, {"a": 1.0, "b": 2.5}, [1, 2])], "k long, m map<string,double>, l array<int>")
    text = spark.createDataFrame([(1, '{"b":2.5,"a":1}', "[1, 2.0]")], "k long, m string, l string")
    assert edges.diff_tables(typed, text, "k", ["m", "l"]).collect() == []


def test_values_in_brackets_relations_and_first_facts(spark):
    e = spark.createDataFrame([(1, 7, "B", "son"), (2, 7, "B", "friend"), (3, 8, "B", "son"), (4, None, "B", "son"), (5, 7, "C", "son")], "edge_id long, entity_id long, target string, relation string")
    f = spark.createDataFrame([(1, 7, "A · ( b )", "canon", "son", 2), (2, 7, "(C)", "likely", "friend", 1), (3, None, "B", "canon", "son", 3), (4, 8, None, "canon", "son", 4)], "fact_id long, entity_id long, value string, tier string, relation string, ordinal long")
    got = lambda *a, **b: {r["edge_id"]: (r["tier"], r["outcome"], r["evidence"]) for r in edges.link_values(*a, **b).collect()}
    assert got(e, f) == {1: ("canon", "match", 1), 2: (None, "conflict", None), 3: (None, "conflict", None), 4: (None, "no-fact", None), 5: (None, "conflict", None)}
    assert got(e.drop("relation"), f, True, F.lit("low")) == {1: ("canon", "match", 1), 2: ("canon", "match", 1), 3: ("low", "partial", None), 4: ("low", "no-fact", None), 5: ("likely", "match", 2)}
    assert got(e.drop("relation"), f, first_only=True) == {1: (None, "conflict", None), 2: (None, "conflict", None), 3: (None, "conflict", None), 4: (None, "no-fact", None), 5: ("likely", "match", 2)}
    assert got(e.drop("relation"), f, composite=False)[1] == (None, "conflict", None)


def test_a_failed_write_leaves_the_old_version(spark, tmp_path):
    path = f"{tmp_path}/shard"
    first = spark.createDataFrame([(1, ["b", "a"]), (2, ["c"])], "grp int, members array<string>")
    catalogue.write_shard(first, path, ["grp"])
    read = lambda: sorted((r["grp"], tuple(r["members"])) for r in catalogue.read_shard(spark, path, "grp int, members array<string>").collect())
    assert read() == [(1, ("a", "b")), (2, ("c",))]
    broken = first.withColumn("members", F.when(F.col("grp") == 2, F.raise_error(F.lit("broken"))).otherwise(F.col("members")))
    with pytest.raises(Exception, match="broken"):
        catalogue.write_shard(broken, path, ["grp"])
    assert read() == [(1, ("a", "b")), (2, ("c",))]
    # a shard may be written from itself
    catalogue.write_shard(catalogue.read_shard(spark, path, "grp int, members array<string>").withColumn("grp", F.col("grp") + 1), path, ["grp"])
    assert read() == [(2, ("a", "b")), (3, ("c",))]
    left = [x.name for x in (tmp_path / "shard").iterdir() if not x.name.endswith(".crc")]
    assert sorted(left)[0] == "CURRENT" and len(left) == 2  # older versions and what failed are gone

    out = f"{tmp_path}/slices"
    rows = spark.createDataFrame([(i, f"n{i}") for i in range(20)], "k int, name string")
    catalogue.publish_slices(rows, "k", ["name"], out, 4)
    with pytest.raises(Exception, match="broken"):
        catalogue.publish_slices(rows.withColumn("name", F.when(F.col("k") == 7, F.raise_error(F.lit("broken"))).otherwise("x")), "k", ["name"], out, 4)
    index, slices = catalogue.read_slices(spark, out, "k int, name string")
    assert {tuple(r) for r in index.select("k", "name").collect()} == {tuple(r) for r in slices.select("k", "name").collect()} == {(i, f"n{i}") for i in range(20)}


def test_records_of_one_file_in_parts(spark, tmp_path):
    (tmp_path / "map.json").write_text('\ufeff{"a, {b": {"x": "1,2", "y": [1, {"z": "}"}]}, "_n": 7, "q\\"k": {"x": null, "y": []},\n "last\\\\": {"x": "e\\\\", "y": ["a,b"]} }')
    (tmp_path / "list.json").write_text('[{"x": "a"}, 5, [1,2], {"x": "b,{[", "y": [[1], [2]]},{"x":"\\u00e9"}\n]')
    (tmp_path / "wrapped.json").write_text('{"note": {"items": [1]}, "items": [{"x": "p"}, {"x": "q, r"}], "more": {"items": [{"x": "no"}]}}')
    (tmp_path / "empty.json").write_text("{}")
    fields, usual = "x string", spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in (1 << 26, 7):
        if size == 7:  # a file is several splits
            spark.conf.set("spark.sql.files.maxPartitionBytes", "24")
            assert spark.read.option("lineSep", ",").text(f"{tmp_path}/map.json").rdd.getNumPartitions() > 3
        rows = lambda name, shape, wrapper=None: {tuple(r) for r in catalogue.read_records(spark, f"{tmp_path}/{name}.json", shape, fields, wrapper, part=size).collect()}  # noqa: B023, E731
        assert rows("map", "map") == {("a, {b", "1,2"), ('q"k', None), ("last\\", "e\\")}
        assert rows("list", "list") == {("a",), ("b,{[",), ("é",)}
        assert rows("wrapped", "wrapped", "items") == {("p",), ("q, r",)}
        assert rows("empty", "map") == set()
    spark.conf.set("spark.sql.files.maxPartitionBytes", usual)

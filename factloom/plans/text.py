"""Text functions on the given tables; inputs of the needed form are put together from names, brands and ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import text as t
from factloom.operators import texts as x
from factloom.plans.registry import query
from factloom.session import table
from factloom.sources.tables import STATEMENTS, statements


def _parts(spark, sf_dir, **columns):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), *[F.expr(e).alias(n) for n, e in columns.items()])


def _pairs(c, *fields):
    return F.array_join(F.transform(c, lambda p: F.concat_ws("=", *[F.coalesce(p[f].cast("string"), F.lit("-")) for f in fields])), "|")


#: Texts of several shapes, some empty or null, in words that both engines read alike; each operator meets all of them.
_VARIED = """CASE p_partkey % 10 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN p_name || ' the ' || p_brand || ' (' || p_type || ')' WHEN 3 THEN p_type || ', ' || p_name || ' (formerly); ' || p_brand || ' (Sworn) ; x;' || p_name
  WHEN 4 THEN p_name || ' (Brother); ' || p_brand || '; (alone); y' WHEN 5 THEN 'Voice: ' || p_name || ' (young); unknown · ' || p_type || ' ep. 12-30; 77 · N/A' WHEN 6 THEN p_name || ', of old → ' || p_brand || ' → ' || p_type || ' (destroyed in war)'
  WHEN 7 THEN p_name || ' (' || p_size || ') · 1,0' || (p_size + 10) || '; ' || p_name || ' , 12' WHEN 8 THEN '  ' || p_name || ' →  ' || p_brand || ' (Captain, alleged)  ' ELSE 'from ' || p_partkey || ' to 2,000 or ' || p_size || ', 3,4; ' || p_brand END"""
_SQL_VARIED = f"v AS (SELECT p_partkey AS k, {_VARIED} AS c FROM part)"
_SQL_SQUEEZE = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"


def _varied(spark, sf_dir):
    return _parts(spark, sf_dir, c=_VARIED)


@query("b1_strip_invisible", "SELECT doc_id, length(text) AS n FROM documents")
def strip(spark, sf_dir):
    marked = F.concat(F.lit("​﻿"), "text", F.lit("⁠"))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(t.strip_invisible(marked)).cast("long").alias("n"))


_FOLD = "lower(strip_accents(string_split(text, chr(10))[1]))"


@query("b2_slugify", f"WITH s AS (SELECT doc_id, trim(regexp_replace({_FOLD}, '[^a-z0-9]+', '-', 'g'), '-') AS s FROM documents) SELECT doc_id, CASE WHEN s = '' THEN 'unknown' ELSE s END AS slug FROM s")
def slugify(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", t.slugify(F.col("text")).alias("slug"))


@query("b3_normalise_key", "SELECT doc_id, regexp_replace(lower(strip_accents(text)), '[^a-z0-9]', '', 'g') AS key FROM documents")
def key(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", t.normalise_key(F.col("text")).alias("key"))


@query("b4_name_variants", f"""WITH {_SQL_VARIED}, p AS (SELECT k, c, trim(regexp_replace(c, '\\s*\\([^)]*\\)', '', 'g')) AS plain FROM v), f AS (SELECT k, list_filter([trim(c), plain, trim(split_part(plain, ' the ', 1)), trim(split_part(plain, ',', 1)), list_last(string_split(plain, ' '))], lambda x: x <> '') AS f FROM p)
  SELECT k, array_to_string(list_filter(f, lambda x, i: list_position(list_transform(f, lambda y: lower(y)), lower(x)) = i), '|') AS forms FROM f""")
def variants(spark, sf_dir):
    return _varied(spark, sf_dir).select("k", F.array_join(t.name_variants(F.col("c")), "|").alias("forms"))


@query("b5_split_qualified", f"""WITH {_SQL_VARIED}, p AS (SELECT k, list_transform(string_split(c, ';'), lambda x: {{'n': {_SQL_SQUEEZE.format("regexp_replace(x, '\\s*\\([^)]*\\)\\s*$', '')")}, 's': lower(trim(regexp_extract(x, '\\(([^)]*)\\)\\s*$', 1)))}}) AS f FROM v)
  SELECT k, array_to_string(list_transform(list_filter(f, lambda y: length(y.n) >= 3), lambda y: y.n || '=' || CASE WHEN contains(y.s, 'former') THEN 'former' WHEN contains(y.s, 'sworn') THEN 'sworn' WHEN contains(y.s, 'temporary') THEN 'temporary' WHEN contains(y.s, 'alleged') THEN 'alleged' WHEN y.s <> '' THEN y.s ELSE 'current' END), '|') AS parts FROM p""")
def qualified(spark, sf_dir):
    return _varied(spark, sf_dir).select("k", _pairs(t.qualified_parts(F.col("c")), "name", "status").alias("parts"))


@query("b6_split_relations", f"""WITH {_SQL_VARIED}, p AS (SELECT k, list_transform(string_split(c, ';'), lambda x: {{'n': {_SQL_SQUEEZE.format("regexp_replace(x, '\\s*\\([^)]*\\)\\s*$', '')")}, 's': lower(trim(regexp_extract(x, '\\(([^)]*)\\)\\s*$', 1)))}}) AS f FROM v)
  SELECT k, array_to_string(list_transform(list_filter(f, lambda y: length(y.n) >= 2), lambda y: y.n || '=' || CASE WHEN y.s <> '' THEN y.s ELSE '-' END), '|') AS parts FROM p""")
def relations(spark, sf_dir):
    return _varied(spark, sf_dir).select("k", _pairs(t.relation_parts(F.col("c")), "name", "relation").alias("parts"))


@query("b7_split_credits", f"""WITH {_SQL_VARIED}, p AS (SELECT k, list_transform(string_split_regex(c, '[;·]'), lambda x: {_SQL_SQUEEZE.format("regexp_replace(regexp_replace(regexp_replace(x, '^\\s*[^:;()]*:\\s*', ''), '[(\\[].*$', ''), '(?i)\\bep\\. .*$', '')")}) AS f FROM v)
  SELECT k, array_to_string(list_filter(f, lambda n: regexp_matches(n, '\\p{{L}}') AND lower(n) NOT IN ('unknown', 'various', 'n/a')), '|') AS names FROM p""")
def credit(spark, sf_dir):
    return _varied(spark, sf_dir).select("k", F.array_join(t.credit_parts(F.col("c")), "|").alias("names"))


@query("b8_parse_owner_chain", f"""WITH {_SQL_VARIED}, p AS (SELECT k, string_split(c, '→') AS l FROM v), q AS (SELECT k, list_transform(l, lambda x, i: {{'o': {_SQL_SQUEEZE.format("regexp_replace(split_part(x, ',', 1), '\\([^)]*\\)', '', 'g')")}, 'i': i - 1, 'c': i = len(l) AND NOT regexp_matches(lower(x), '\\((former|destroyed)[^)]*\\)')}}) AS f FROM p)
  SELECT k, array_to_string(list_transform(list_filter(f, lambda y: y.o <> ''), lambda y: y.i || '=' || y.o || '=' || y.c), '|') AS links FROM q""")
def chain(spark, sf_dir):
    return _varied(spark, sf_dir).select("k", _pairs(t.owner_chain(F.col("c")), "pos", "owner", "current").alias("links"))


@query("b9_value_variants", f"""WITH {_SQL_VARIED}, p AS (SELECT k, c, regexp_replace(c, '\\D', '', 'g') AS d, string_split_regex(c, ' · |; | , ') AS l FROM v),
  f AS (SELECT k, list_filter(list_concat(list_concat([trim(c), {_SQL_SQUEEZE.format("regexp_replace(c, '\\([^)]*\\)', '', 'g')")}], flatten(list_transform(l, lambda x: [trim(x), {_SQL_SQUEEZE.format("regexp_replace(x, '\\([^)]*\\)', '', 'g')")}]))), [CASE WHEN length(d) >= 3 THEN d END, replace(trim(c), ',', '')]), lambda x: x <> '') AS f, c FROM p)
  SELECT k, CASE WHEN c IS NOT NULL THEN array_to_string(list_filter(f, lambda x, i: list_position(f, x) = i), '|') END AS forms FROM f""")
def value_variants(spark, sf_dir):
    return _varied(spark, sf_dir).select("k", F.array_join(t.value_variants(F.col("c")), "|").alias("forms"))


@query("b10_position", "SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 0 AND p_size > 1 THEN CAST(p_size - 1 AS INTEGER) END AS position, CASE WHEN p_partkey % 3 < 2 AND p_size > 1 THEN CAST(p_size - 1 AS INTEGER) END AS loose FROM part")
def position(spark, sf_dir):
    p = _parts(spark, sf_dir, c="case p_partkey % 3 when 0 then 'Chapter ' || (p_size - 1) || ' (x)' when 1 then 'vol ' || (p_size - 1) else 'none' end")
    return p.select("k", t.position(F.col("c")).alias("position"), t.loose_position(F.col("c")).alias("loose"))


@query("b11_position_list", "SELECT p_partkey AS k, array_to_string(list_sort(list_distinct(list_concat(range(p_size, p_size + 4), [p_size + 2, 700, 1400]))), ',') AS positions FROM part")
def positions(spark, sf_dir):
    p = _parts(spark, sf_dir, c="'see ' || p_size || '-' || (p_size + 3) || ' and ' || (p_size + 2) || ', 700-1400'")
    return p.select("k", F.array_join(t.position_list(F.col("c")).cast("array<string>"), ",").alias("positions"))


@query("b12_largest_amount", f"""WITH {_SQL_VARIED} SELECT k, list_max(list_filter(list_transform(regexp_extract_all(c, '(\\d[\\d,]*)', 1), lambda x: TRY_CAST(replace(x, ',', '') AS BIGINT)), lambda n: n >= 1000)) AS amount FROM v""")
def amount(spark, sf_dir):
    return _varied(spark, sf_dir).select("k", t.largest_amount(F.col("c")).alias("amount"))


@query("b13_strip_markup", "SELECT p_partkey AS k, 'The ' || p_name || ' of ' || p_brand || ' is ' || p_type || '.' AS text FROM part")
def markup(spark, sf_dir):
    p = _parts(spark, sf_dir, c="\"== The ==\n'''[[\" || p_type || '|' || p_name || \"]]''' of [[\" || p_brand || ']]<ref>x</ref> {{a|{{b}}|c}}is [[File:x.png|thumb|see [[y]]]]<b>' || p_type || '</b>.'")
    return p.select("k", t.strip_markup(F.col("c")).alias("text"))


@query("b14_parse_infobox", "SELECT p_partkey AS k, p_name AS name, 'x ' || p_type || ' · ' || p_brand AS kind FROM part")
def infobox(spark, sf_dir):
    p = _parts(spark, sf_dir, c="'intro {{Char Box\n| Name = ' || p_name || '\n| kind = x {{nowrap|}}' || p_type || '\n| kind2=' || p_brand || '\n|empty=\n}} tail'")
    return x.parse_infobox(p, "k", "c", "char box", {"name": ["ename", "name"], "kind": ["kind", "kind2", "empty"]}, ("kind",), cleaned=True)


@query("b15_extract_mentions", "SELECT p_partkey AS k, p_name AS name, 'flashback' AS kind FROM part UNION ALL SELECT p_partkey, p_type, 'full' FROM part")
def mentions(spark, sf_dir):
    p = _parts(spark, sf_dir, c="'x [[no]]\n== Characters ==\n* [[' || p_name || '|n]] (Flashback)\n* [[' || p_type || ']] and [[File:z]]\n* [[' || p_type || ']]\n[[not a bullet]]\n== Next ==\n* [[after]]'")
    return x.extract_mentions(p, "k", "c")


@query("b16_pair_turns", f"WITH {STATEMENTS} SELECT statement_id, volume, length(question) AS q, length(answer) AS a FROM statements")
def turns(spark, sf_dir):
    return statements(spark, sf_dir).select("statement_id", "volume", F.length("question").cast("long").alias("q"), F.length("answer").cast("long").alias("a"))


@query("b16_pair_markers", "SELECT p_partkey AS k, CAST(0 AS INTEGER) AS n, 'who is ' || p_name || '?' AS question, 'it is ' || p_brand AS answer FROM part UNION ALL SELECT p_partkey, 2, 'and ' || p_type || '?', 'long ago' FROM part")
def pair_markers(spark, sf_dir):
    from factloom.operators.statements import pair_markers as pair

    p = _parts(spark, sf_dir, c="'intro Q: who is ' || p_name || '? A: it is ' || p_brand || ' Q: no answer Q: and ' || p_type || '? A: long ago Q: x A: y'")
    return pair(p, "k", "c")


@query("b17_signature", f"""WITH {_SQL_VARIED}, p AS (SELECT k, [trim(regexp_extract(c, '; ([^;.]*)', 1)), trim(regexp_extract(c, ' (?:to|the|of) ([^(;→]*)', 1)), trim(regexp_extract(c, '^([^(;]*)', 1))] AS f FROM v)
  SELECT k, list_filter(f, lambda n: length(n) BETWEEN 2 AND 40 AND lower(n) NOT IN ('x', 'y', 'old') AND regexp_matches(n, '\\p{{L}}') AND 2 * length(regexp_replace(n, '[^0-9]', '', 'g')) <= length(n))[1] AS name FROM p""")
def signature(spark, sf_dir):
    return _varied(spark, sf_dir).select("k", t.signature(F.col("c"), ["; ([^;.]*)", " (?:to|the|of) ([^(;→]*)", "^([^(;]*)"], ("x", "y", "old")).alias("name"))


@query("b18_credits_tail", "SELECT p_partkey AS k, p_name AS body, CASE WHEN p_size > 9 THEN p_brand END AS credits FROM part")
def credits_tail(spark, sf_dir):
    p = _parts(spark, sf_dir, c="p_name || ' Volume 7' || if(p_size > 9, ' Translators: ' || p_brand, '')")
    return p.select("k", t.credits_tail(F.col("c")).alias("x")).select("k", "x.body", "x.credits")


@query("b19_flatten_tables", "SELECT p_partkey AS k, 'a [h · i  ||  ' || p_name || ' · ' || p_brand || '] b' AS text FROM part")
def flatten(spark, sf_dir):
    p = _parts(spark, sf_dir, c="'a {| class=x\n! h !! i\n|-\n| ' || p_name || ' || ' || p_brand || '\n|} b'")
    return p.select("k", t.flatten_tables(F.col("c")).alias("text"))


@query("b20_unpivot_tables", "SELECT p_partkey AS k, p_name AS name, 'age' AS field, CAST(p_size AS VARCHAR) AS value, false AS refused FROM part UNION ALL SELECT p_partkey, p_brand, 'age', '7', false FROM part UNION ALL SELECT p_partkey, NULL, 'type', NULL, true FROM part UNION ALL SELECT p_partkey, 'Z', 'age', p_type, false FROM part")
def unpivot(spark, sf_dir):
    p = _parts(spark, sf_dir, c="'[Name · ' || p_name || ' · ' || p_brand || ' || Age · ' || p_size || ' · 7 || Type · x || Odd · 1 · 2] and [no · name || Age · Z] [note · Name · Age || x · Z · ' || p_type || '] [a || b]'")
    return x.unpivot_positional_tables(p, "k", "c", ("age", "type"))


@query("b21_attribute_attachments", "SELECT p_partkey AS doc, 'd' || p_size AS file, CAST(1 AS BIGINT) AS item, 'deferred' AS part FROM part UNION ALL SELECT p_partkey, 'q', 1, 'question' FROM part UNION ALL SELECT p_partkey, 'a', 1, 'answer' FROM part UNION ALL SELECT p_partkey, 'h', 2, 'deferred' FROM part")
def attachments(spark, sf_dir):
    p = _parts(spark, sf_dir, c="'[[File:d' || p_size || ']]\nQ: x [[File:q|thumb]]\nA: y\n[[File:a]]\n== Next ==\n[[File:h]]\nQ: z\n'")
    return x.attribute_attachments(p, "k", "c")


@query("b22_sanitise", "SELECT doc_id, CASE WHEN length(c) > 300 THEN substr(c, 1, 300) || '…' ELSE c END AS text FROM (SELECT doc_id, regexp_replace(regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g'), '(?i)token|password', '[marker]', 'g') AS c FROM documents)")
def sanitise(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", t.sanitise(F.col("text"), ["(?i)token|password"], 300).alias("text"))


@query("b23_quality_gate", """SELECT doc_id AS id, n_chars AS score, CASE WHEN source = 'src3' THEN 'moderated' WHEN n_chars < 400 THEN 'score' WHEN doc_id < 30 THEN 'age' WHEN length(trim(text)) < 500 THEN 'text' END AS reason,
  CASE WHEN NOT (source = 'src3' OR n_chars < 400 OR doc_id < 30 OR length(trim(text)) < 500) THEN regexp_replace(substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 120), '\\s+\\S*$', '') || '…' END AS summary FROM documents""")
def gate(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    posts = d.select(F.col("doc_id").alias("id"), F.col("n_chars").alias("score"), F.date_add(F.lit("2020-01-01").cast("date"), F.col("doc_id").cast("int")).alias("day"), "text", "source")
    return x.quality_gate(posts, F.col("source") == "src3", 400, F.date_add(F.lit("2020-01-01").cast("date"), 30), 500, 120)


_RULES = [("(?i)^eco", "cheap"), ("(?i)promo|std", "special"), ("O", "other")]


@query("b26_classify", "SELECT p_partkey AS k, CASE WHEN regexp_matches(p_type, '(?i)^eco') THEN 'cheap' WHEN regexp_matches(p_type, '(?i)promo|std') THEN 'special' WHEN regexp_matches(p_type, 'O') THEN 'other' ELSE 'none' END AS label FROM part")
def classify(spark, sf_dir):
    return _parts(spark, sf_dir, c="p_type").select("k", t.classify(F.col("c"), _RULES, "none").alias("label"))


@query("b27_rank", "SELECT p_partkey AS k, CASE WHEN p_partkey % 4 = 0 THEN 60 WHEN p_type = 'ECONOMY' THEN 1 WHEN p_type = 'PROMO' THEN 2 ELSE 60 END AS rank FROM part")
def rank(spark, sf_dir):
    p = _parts(spark, sf_dir, c="if(p_partkey % 4 = 0, 'Former ', '') || p_type || '; PROMO'")
    return p.select("k", t.rank(F.col("c"), [("^economy", 1), ("^promo", 2)]).alias("rank"))


@query("b27_priority", "SELECT p_partkey AS k, CASE WHEN p_partkey % 5 = 0 THEN 60 WHEN p_type = 'ECONOMY' THEN 0 WHEN p_type = 'PROMO' THEN 80 ELSE 60 END AS priority FROM part")
def priority(spark, sf_dir):
    p = _parts(spark, sf_dir, c="if(p_partkey % 5 = 0, NULL, ' ' || lower(p_type) || ' ')")
    return p.select("k", t.priority(F.col("c"), {"economy": 0, "promo": 80}).alias("priority"))


@query("b28_tags", f"""WITH {_SQL_VARIED}, n AS (SELECT v.k, lower(c) AS c, CASE WHEN p_size % 7 <> 0 THEN p_size * 3 END AS n FROM v JOIN part ON p_partkey = v.k)
  SELECT k, array_to_string(list_filter([CASE WHEN contains(c, 'brand') THEN 'maker' END, CASE WHEN contains(c, 'formerly') THEN 'past' END, CASE WHEN contains(c, 'red') THEN 'colour' END, CASE WHEN n >= 100 THEN 'main' WHEN n >= 20 THEN 'recurring' ELSE 'minor' END], lambda x: x IS NOT NULL), ',') AS tags FROM n""")
def tags(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.expr(_VARIED).alias("c"), F.when(F.col("p_size") % 7 != 0, F.col("p_size") * 3).alias("n"))
    return p.select("k", F.array_join(t.tags(F.col("c"), {"brand": "maker", "formerly": "past", "red": "colour"}, F.col("n")), ",").alias("tags"))


_LOOSE = """CASE p_partkey % 8 WHEN 0 THEN upper(p_name) WHEN 1 THEN p_name || ' (' || p_type || ')' WHEN 2 THEN '900 and ' || p_size || ' or 5' WHEN 3 THEN '7 things' WHEN 4 THEN '(' || p_type || ')' WHEN 5 THEN NULL WHEN 6 THEN ' ' || p_name || '  (x) (y)' ELSE '' END"""
_PLAIN = """CASE p_partkey % 8 WHEN 2 THEN p_size || ' of 900' WHEN 3 THEN p_name || ' ' || p_size WHEN 4 THEN '(' || p_brand || ')' WHEN 7 THEN '' ELSE p_name END"""


@query("b29_equivalent", f"""WITH x AS (SELECT p_partkey AS k, lower({_PLAIN}) AS a, lower({_LOOSE}) AS b FROM part),
  y AS (SELECT k, trim(regexp_replace(a, '\\s+', ' ', 'g')) AS la, trim(regexp_replace(b, '\\s+', ' ', 'g')) AS lb, trim(regexp_replace(regexp_replace(a, '\\([^)]*\\)', '', 'g'), '\\s+', ' ', 'g')) AS ba, trim(regexp_replace(regexp_replace(b, '\\([^)]*\\)', '', 'g'), '\\s+', ' ', 'g')) AS bb, regexp_extract_all(a, '\\d+') AS da, regexp_extract_all(b, '\\d+') AS db FROM x)
  SELECT k, coalesce(la = lb OR (ba <> '' AND ba = bb) OR (len(da) > 0 AND len(db) > 0 AND (list_has_all(da, db) OR list_has_all(db, da))), false) AS same FROM y""")
def equivalent(spark, sf_dir):
    p = _parts(spark, sf_dir, a=_PLAIN, b=_LOOSE)
    return p.select("k", t.equivalent(F.col("a"), F.col("b")).alias("same"))


@query("b30_entry_text", f"""WITH {_SQL_VARIED} SELECT k, concat_ws(' ', c, p_brand, CASE WHEN k % 3 = 0 THEN NULL WHEN k % 3 = 1 THEN concat_ws(' ', p_type, c) ELSE p_name END) AS text FROM v JOIN part ON p_partkey = k""")
def entry(spark, sf_dir):
    k = F.col("p_partkey") % 3
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.expr(_VARIED).alias("a"), F.col("p_brand").alias("b"), F.when(k == 1, F.array(F.col("p_type"), F.expr(_VARIED))).when(k == 2, F.array("p_name")).alias("c"))
    return p.select("k", t.entry_text([F.col("a"), F.col("b")], [F.col("c")]).alias("text"))


@query("b31_score_filenames", """WITH f AS (SELECT p_name || '-' || p_type || '.png' AS file, p_brand AS page, p_name, p_type FROM part GROUP BY ALL), tg AS (SELECT p_name || ' ' || p_size AS target, p_brand AS page, p_name, p_partkey FROM part),
  pr AS (SELECT target, file, CASE WHEN w1 + w2 > 0 THEN w1 + w2 + CASE WHEN lower(file) LIKE '%promo%' THEN 3 ELSE 0 END ELSE 0 END AS score FROM (SELECT tg.target, f.file, (SELECT coalesce(sum(length(w)), 0) FROM (SELECT DISTINCT unnest(string_split(tg.p_name, ' ')) AS w) WHERE list_contains(list_concat(string_split(f.p_name, ' '), [lower(f.p_type)]), w)) AS w1, 0 AS w2 FROM tg JOIN f USING (page)))
  SELECT target, arg_min(file, (-score, file)) AS file, CAST(max(score) AS INTEGER) AS score FROM pr GROUP BY target""")
def filenames(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    files = p.select(F.concat("p_name", F.lit("-"), "p_type", F.lit(".png")).alias("file"), F.col("p_brand").alias("page")).distinct()
    targets = p.select(F.concat_ws(" ", "p_name", "p_size").alias("target"), F.col("p_brand").alias("page")).distinct()
    return x.score_filenames(targets, files, {"promo": 3})

"""Gated views on the given tables: parts and documents are entries, benchmark words the lexicon, customers readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import gates as g
from factloom.plans.registry import query
from factloom.session import table


@query("g1_derive_reveal", """WITH f AS (SELECT l_orderkey * 10 + l_linenumber AS fact_id, CAST(l_partkey % 200 AS INTEGER) AS subject, l_returnflag AS predicate, CAST(CASE WHEN l_linenumber = 1 THEN 5 END AS INTEGER) AS reveal, CAST(CASE WHEN l_linenumber = 2 THEN 6 END AS INTEGER) AS own, CAST(CASE WHEN l_linenumber = 3 THEN 7 END AS INTEGER) AS cited, CAST(l_suppkey % 40 AS INTEGER) AS volume FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_returnflag) AS l_returnflag, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY 1, 2)),
  o AS (SELECT CAST(NULL AS BIGINT) AS f, CAST(p_partkey % 200 AS INTEGER) AS s, CASE WHEN p_partkey % 2 = 0 THEN 'R' END AS p, CAST(p_size AS INTEGER) AS r, p_partkey AS ordinal FROM part WHERE p_partkey % 50 = 0 UNION ALL SELECT NULL, NULL, 'N', 99, 100000000),
  m AS (SELECT fact_id, o.r, row_number() OVER (PARTITION BY fact_id ORDER BY (CASE WHEN s IS NOT NULL THEN 10 ELSE 0 END + CASE WHEN p IS NOT NULL THEN 1 ELSE 0 END) DESC, ordinal) AS rn FROM f JOIN o ON (s IS NULL OR s = subject) AND (p IS NULL OR p = predicate)),
  j AS (SELECT f.fact_id, f.reveal, m.r AS over, own, cited, CASE WHEN volume < 20 THEN volume * 10 END AS last, CASE WHEN subject < 100 THEN subject END AS debut FROM f LEFT JOIN m ON m.fact_id = f.fact_id AND rn = 1)
  SELECT fact_id, coalesce(reveal, over, own, cited, last, debut) AS reveal, CASE WHEN reveal IS NOT NULL THEN 'kept' WHEN over IS NOT NULL THEN 'override' WHEN own IS NOT NULL THEN 'first-position' WHEN cited IS NOT NULL THEN 'citation' WHEN last IS NOT NULL THEN 'volume' WHEN debut IS NOT NULL THEN 'debut' ELSE 'none' END AS reason FROM j""")
def reveal(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.min("l_returnflag").alias("predicate"), F.min("l_suppkey").alias("s"))
    n = F.col("l_linenumber")
    facts = l.select((F.col("l_orderkey") * 10 + n).alias("fact_id"), (F.col("p") % 200).cast("int").alias("subject"), "predicate", F.when(n == 1, 5).alias("reveal"), F.when(n == 2, 6).alias("own"), F.when(n == 3, 7).alias("cited"), (F.col("s") % 40).cast("int").alias("volume"))
    k = F.col("p_partkey")
    over = table(spark, sf_dir, "part").where(k % 50 == 0).select(F.lit(None).cast("long").alias("fact_id"), (k % 200).cast("int").alias("subject"), F.when(k % 2 == 0, "R").alias("predicate"), F.col("p_size").alias("reveal"), k.alias("ordinal"))
    over = over.union(spark.createDataFrame([(None, None, "N", 99, 100000000)], over.schema))
    of = lambda column, n, most: table(spark, sf_dir, "lineitem").select((F.col(column) % n).cast("int").alias("i")).distinct().where(F.col("i") < most)
    volumes, subjects = of("l_suppkey", 40, 20), of("l_partkey", 200, 100)
    return g.derive_reveal(facts, volumes.select(F.col("i").alias("volume"), (F.col("i") * 10).alias("last")), over, subjects.select(F.col("i").alias("subject"), F.col("i").alias("debut")))


@query("g2_derive_gates", """SELECT p_partkey AS entry_id, CASE p_partkey % 4 WHEN 0 THEN least(p_size, 20) WHEN 1 THEN CAST(p_size AS INTEGER) WHEN 2 THEN CASE WHEN s_suppkey IS NOT NULL THEN s_nationkey END END AS gate,
  CASE p_partkey % 4 WHEN 0 THEN 'rungs' WHEN 1 THEN 'explicit' WHEN 2 THEN CASE WHEN s_suppkey IS NOT NULL THEN 'users' ELSE 'none' END ELSE 'none' END AS source FROM part LEFT JOIN supplier ON s_suppkey = p_partkey % 150""")
def derive_gates(spark, sf_dir):
    k = F.col("p_partkey") % 4
    rung = lambda ch: F.struct(ch.cast("int").alias("ch"), F.lit(None).cast("int").alias("max_ch"), F.lit("x").alias("label"))
    e = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("entry_id"), F.when(k == 0, F.array(rung(F.col("p_size")), rung(F.lit(20)))).alias("rungs"), F.when(k == 1, F.concat(F.lit("chapter "), "p_size", F.lit(" of 9"))).alias("explicit"), F.when(k == 2, F.array(F.concat(F.lit(" SUPPLIER#"), F.lpad((F.col("p_partkey") % 150).cast("string"), 9, "0")))).otherwise(F.array().cast("array<string>")).alias("users"))
    return g.derive_gates(e, table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("debut")))


_LEX = "lex AS (SELECT DISTINCT lower(string_split(p_name, ' ')[2]) AS term, CAST(length(p_name) * 3 AS INTEGER) AS ch FROM part), lexicon AS (SELECT term, max(ch) AS ch FROM lex GROUP BY 1)"
_ENTRIES = "entries AS (SELECT s_suppkey AS entry_id, lower(p_name) AS text, CAST(s_nationkey AS INTEGER) AS gate FROM supplier JOIN part ON p_partkey = s_suppkey)"


def _lexicon(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.groupBy(F.lower(F.split_part("p_name", F.lit(" "), F.lit(2))).alias("term")).agg(F.max(F.length("p_name") * 3).alias("ch"))


def _entries(spark, sf_dir):
    s, p = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "part")
    return s.join(p, F.col("p_partkey") == F.col("s_suppkey")).select(F.col("s_suppkey").alias("entry_id"), F.col("p_name").alias("text"), F.col("s_nationkey").alias("gate"))


@query("g2_gates_from_texts", """WITH x AS (SELECT o_orderkey AS k, CASE o_orderkey % 6 WHEN 0 THEN 'Film: Gold (' || (1990 + o_custkey % 20) || ')' WHEN 1 THEN 'Episode ' || o_custkey WHEN 2 THEN 'Episode 7, Chapter ' || o_custkey % 1000 WHEN 3 THEN 'after ' || o_custkey % 1000 WHEN 4 THEN 'some day' END AS t FROM orders),
  m AS (SELECT DISTINCT p_partkey AS key, p_partkey * 2 + 1 AS p FROM part WHERE p_partkey % 13 = 5), e AS (SELECT k, o_orderkey % 6 AS r, o_custkey, 1990 + o_custkey % 20 AS y FROM x JOIN orders ON o_orderkey = k),
  a AS (SELECT k, r, CASE WHEN r = 1 THEN coalesce((SELECT arg_min(p, key) FROM m WHERE key >= o_custkey), (SELECT arg_max(p, key) FROM m WHERE key < o_custkey)) END AS ep, CASE WHEN r = 1 THEN o_custkey IN (SELECT key FROM m) END AS hit, o_custkey, y FROM e)
  SELECT k AS entry_id, CAST(CASE r WHEN 0 THEN CASE WHEN y % 4 <> 0 THEN y - 1900 END WHEN 1 THEN ep WHEN 2 THEN 7 WHEN 3 THEN o_custkey % 1000 END AS INTEGER) AS gate,
    CASE r WHEN 0 THEN CASE WHEN y % 4 <> 0 THEN 'film' ELSE 'none' END WHEN 1 THEN CASE WHEN hit THEN 'episode' ELSE 'episode-filler' END WHEN 2 THEN 'explicit' WHEN 3 THEN 'explicit' ELSE 'none' END AS source FROM a""")
def gates_from_texts(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey") % 6
    cust = F.col("o_custkey")
    text = F.when(k == 0, F.concat(F.lit("Film: Gold ("), 1990 + cust % 20, F.lit(")"))).when(k == 1, F.concat(F.lit("Episode "), cust)).when(k == 2, F.concat(F.lit("Episode 7, Chapter "), cust % 1000)).when(k == 3, F.concat(F.lit("after "), cust % 1000)).when(k == 4, "some day")
    rungs = F.lit(None).cast("array<struct<ch:int,max_ch:int,label:string>>")
    entries = o.select(F.col("o_orderkey").alias("entry_id"), rungs.alias("rungs"), text.alias("explicit"), F.array().cast("array<string>").alias("users"))
    years = o.select((1990 + cust % 20).cast("int").alias("year")).distinct().where("year % 4 <> 0")
    parts = table(spark, sf_dir, "part").where("p_partkey % 13 = 5").select(F.col("p_partkey").alias("key"), F.array(F.col("p_partkey"), F.col("p_partkey") * 2 + 1).alias("positions"))
    debuts = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("debut"))
    return g.derive_gates(entries, debuts, years.withColumn("gate", F.col("year") - 1900), parts)


@query("g3_raise_for_terms", f"WITH {_LEX}, {_ENTRIES} SELECT entry_id, CASE WHEN ch > gate THEN ch ELSE gate END AS gate, CASE WHEN ch > gate THEN term END AS blocked_by FROM entries LEFT JOIN lexicon ON term = string_split(text, ' ')[2]")
def raise_terms(spark, sf_dir):
    return g.raise_for_terms(_entries(spark, sf_dir), _lexicon(spark, sf_dir))


#: What an entry is at a cutoff: part names, of which a third has no rungs (an empty array or null), a fifteenth one that comes late.
_FORMS = """raw AS (SELECT p_partkey AS k, p_size, p_name, p_brand, p_type FROM part),
  picked AS (SELECT raw.*, CASE WHEN k % 3 = 0 THEN 0 WHEN k % 15 = 1 THEN CASE WHEN p_size <= {cut} THEN 1 END WHEN p_size <= {cut} AND p_size > 10 THEN 1 WHEN {cut} >= 10 THEN 3 WHEN p_size <= {cut} THEN 1 END AS i FROM raw),
  forms AS (SELECT k AS entry_id, CASE WHEN i = 1 THEN 'late ' || p_brand ELSE p_name END AS label, CASE i WHEN 0 THEN 'plain' WHEN 1 THEN upper(p_name) ELSE p_type END AS text, CASE i WHEN 0 THEN 'none.png' WHEN 3 THEN p_brand || '.png' END AS image,
    CASE WHEN i = 3 THEN p_name END AS caption, CAST(CASE WHEN i = 3 THEN 10 WHEN i = 1 THEN p_size WHEN k % 9 <> 0 THEN p_size END AS INTEGER) AS gate FROM picked WHERE i IS NOT NULL)"""


def _runged(spark, sf_dir):
    k = F.col("p_partkey")
    some = lambda **texts: F.map_from_arrays(F.array(*[F.lit(n) for n in texts]), F.array(*[t.cast("string") for t in texts.values()]))
    rung = lambda ch, end, fields: F.struct(ch.cast("int").alias("ch"), end.cast("int").alias("max_ch"), fields.alias("fields"))
    none = F.lit(None).cast("string")
    late = rung(F.col("p_size"), none, some(label=F.concat(F.lit("late "), "p_brand"), text=F.upper("p_name"), image=none))
    mid, wide = rung(F.lit(10), F.lit(25), some(label=F.lit("mid"))), rung(F.lit(10), none, some(text=F.col("p_type"), image=F.concat("p_brand", F.lit(".png")), caption=F.col("p_name")))
    rungs = F.when(k % 6 == 0, F.lit(None)).when(k % 3 == 0, F.array()).when(k % 15 == 1, F.array(late)).otherwise(F.array(late, mid, wide))
    fields = some(label=F.col("p_name"), text=F.lit("plain"), image=F.lit("none.png"), _note=F.col("p_name"))
    return table(spark, sf_dir, "part").select(k.alias("entry_id"), fields.alias("fields"), F.when(k % 9 != 0, F.col("p_size")).alias("gate"), rungs.cast("array<struct<ch:int,max_ch:int,fields:map<string,string>>>").alias("rungs"))


def _named(entries):
    return entries.select("entry_id", *[F.col("fields")[n].alias(n) for n in ("label", "text", "image", "caption")], "gate")


@query("g4_resolve_rungs", f"WITH {_FORMS.format(cut=30)} SELECT * FROM forms")
def rungs(spark, sf_dir):
    return _named(g.resolve_rungs(_runged(spark, sf_dir), 30))


@query("g5_visible_at", f"""WITH {_LEX}, {_FORMS.format(cut=33)}, w AS (SELECT entry_id, unnest(string_split_regex(lower(concat_ws(' ', label, text, image, caption)), '[^a-z0-9]+')) AS term FROM forms),
  late AS (SELECT DISTINCT entry_id FROM w JOIN lexicon USING (term) WHERE ch > 33) SELECT forms.* FROM forms ANTI JOIN late USING (entry_id) WHERE gate <= 33""")
def visible(spark, sf_dir):
    return _named(g.visible_at(_runged(spark, sf_dir), 33, _lexicon(spark, sf_dir), 1000))


_CUTS = [5, 9, 10, 20, 31, 35, 44]


@query("g7_version_leaks", "WITH " + _LEX + ", " + ", ".join(_FORMS.format(cut=c).replace("raw AS", f"raw{c} AS").replace("FROM raw)", f"FROM raw{c})").replace("raw.*", f"raw{c}.*").replace("picked", f"picked{c}").replace("forms AS", f"forms{c} AS") for c in _CUTS)
       + ", f AS (" + " UNION ALL ".join(f"SELECT *, {c} AS cut FROM forms{c}" for c in _CUTS)
       + """), s AS (SELECT entry_id, cut, unnest(['label', 'text', 'image', 'caption']) AS field, unnest([label, text, image, caption]) AS v FROM f WHERE gate <= cut),
  w AS (SELECT entry_id, cut, field, left(v, 70) AS snippet, unnest(string_split_regex(lower(v), '[^a-z0-9]+')) AS term FROM s WHERE v IS NOT NULL)
  SELECT entry_id, field, snippet, term, min(cut) AS cutoff FROM w JOIN lexicon USING (term) WHERE ch > cut GROUP BY ALL""")
def version_leaks(spark, sf_dir):
    return g.version_leaks(_runged(spark, sf_dir), _lexicon(spark, sf_dir), _CUTS)


@query("g6_visibility_matrix", "SELECT p_brand AS page, count(*) FILTER (p_size <= 1) AS at_1, count(*) FILTER (p_size <= 10) AS at_10, count(*) FILTER (p_size <= 40) AS at_40, min(p_size) AS first_gate FROM part GROUP BY 1")
def matrix(spark, sf_dir):
    return g.visibility_matrix(table(spark, sf_dir, "part").select(F.col("p_brand").alias("page"), F.col("p_size").alias("gate")), [1, 10, 40])


@query("g7_leak_audit", f"""WITH {_LEX}, {_ENTRIES}, c AS (SELECT unnest([1, 5, 20, 31, 35]) AS c) SELECT entry_id AS string_id, term, min(c) AS cutoff FROM entries JOIN lexicon ON term = string_split(text, ' ')[2] JOIN c ON c >= gate AND c < ch GROUP BY 1, 2""")
def leaks(spark, sf_dir):
    return g.leak_audit(_entries(spark, sf_dir).withColumnRenamed("entry_id", "string_id"), _lexicon(spark, sf_dir), [1, 5, 20, 31, 35])


@query("g6_blank_pages", """WITH p AS (SELECT DISTINCT p_brand AS page, CASE WHEN p_brand LIKE '%1' THEN 1 WHEN p_brand LIKE '%2' THEN 9 END AS gate FROM part), e AS (SELECT p_brand AS page, min(p_size) AS low FROM part WHERE p_size > 6 AND p_brand NOT LIKE '%3' GROUP BY 1), c AS (SELECT unnest([1, 5, 8, 20]) AS c)
  SELECT page, max(c) AS worst, any_value(low) AS recommended FROM p LEFT JOIN e USING (page) JOIN c ON c >= coalesce(gate, 0) AND (low IS NULL OR c < low) GROUP BY 1""")
def blank(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumnRenamed("p_brand", "page")
    pages = p.select("page", F.when(F.col("page").endswith("1"), 1).when(F.col("page").endswith("2"), 9).alias("gate")).distinct()
    return g.blank_pages(p.where("p_size > 6 AND page NOT LIKE '%3'").select("page", F.col("p_size").alias("gate")), pages, [1, 5, 8, 20])


@query("g7_rung_leaks", f"""WITH {_LEX}, r AS (SELECT p_partkey AS k, p_size AS ch, 'label' AS field, lower(string_split(p_name, ' ')[2]) AS term FROM part UNION SELECT p_partkey, p_size + 20, 'label', lower(string_split(p_name, ' ')[1]) FROM part
  UNION SELECT p_partkey, p_size + 20, 'text', lower(string_split(p_name, ' ')[2]) FROM part) SELECT DISTINCT k AS entry_id, r.ch, field, term, lexicon.ch AS until FROM r JOIN lexicon USING (term) WHERE lexicon.ch > r.ch""")
def rung_leaks(spark, sf_dir):
    word = lambda n: F.upper(F.split_part("p_name", F.lit(" "), F.lit(n)))
    first = F.struct(F.col("p_size").alias("ch"), F.create_map(F.lit("label"), word(2), F.lit("_own"), word(1)).alias("fields"))
    second = F.struct((F.col("p_size") + 20).alias("ch"), F.create_map(F.lit("label"), word(1), F.lit("text"), F.concat(F.lit("Of "), word(2), F.lit("!"))).alias("fields"))
    return g.rung_leaks(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("entry_id"), F.array(first, second).alias("rungs")), _lexicon(spark, sf_dir))


@query("g7_gate_audit", f"WITH {_LEX}, {_ENTRIES} SELECT entry_id, gate, ch AS needed, CASE WHEN ch > gate THEN 'leaks' WHEN ch < gate THEN 'over-hidden' ELSE 'fits' END AS verdict FROM (SELECT entry_id, gate + 20 AS gate, text FROM entries) JOIN lexicon ON term = string_split(text, ' ')[2]")
def gate_audit(spark, sf_dir):
    return g.gate_audit(_entries(spark, sf_dir).withColumn("gate", F.col("gate") + 20), _lexicon(spark, sf_dir))


_READERS = """readers AS (SELECT c_custkey AS reader_id, CASE c_custkey % 5 WHEN 0 THEN 'off' WHEN 1 THEN 'strict' ELSE 'on' END AS mode, CASE WHEN c_custkey % 7 <> 0 THEN CAST(c_nationkey * 2 AS INTEGER) END AS cutoff, CASE WHEN c_custkey % 3 = 0 THEN 20 END AS ep, CASE WHEN c_custkey % 2 = 0 THEN 'detail' ELSE 'list' END AS surface FROM customer),
  eff AS (SELECT reader_id, CASE WHEN mode <> 'off' THEN greatest(0, least(45, coalesce(least(cutoff, ep), CASE WHEN mode = 'strict' THEN 0 ELSE 30 END) - CASE WHEN surface <> 'detail' OR mode = 'strict' THEN 3 ELSE 0 END)) END AS cut FROM readers)"""


def _readers(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("reader_id"), F.when(k % 5 == 0, "off").when(k % 5 == 1, "strict").otherwise("on").alias("mode"), F.when(k % 7 != 0, F.col("c_nationkey") * 2).alias("cutoff"), F.when(k % 3 == 0, 20).alias("episode_position"), F.lit(3).alias("buffer"), F.when(k % 2 == 0, "detail").otherwise("list").alias("surface"))


@query("g8_filter_for_readers", f"WITH {_READERS}, items AS (SELECT CASE WHEN p_partkey % 9 <> 0 THEN p_size END AS reveal FROM part), u AS (SELECT DISTINCT cut FROM eff), n AS (SELECT cut, (SELECT count(*) FROM items WHERE cut IS NULL OR (reveal <= cut AND reveal <= 45)) AS visible FROM u) SELECT reader_id, eff.cut AS cutoff, visible FROM eff JOIN n ON eff.cut IS NOT DISTINCT FROM n.cut")
def readers(spark, sf_dir):
    items = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), F.when(F.col("p_partkey") % 9 != 0, F.col("p_size")).alias("reveal"))
    return g.filter_for_readers(items, _readers(spark, sf_dir), 45, 30)


@query("g9_pick_version", """WITH v AS (SELECT p_brand AS item, p_size AS f, max(p_partkey) AS version FROM part GROUP BY 1, 2), r AS (SELECT c_custkey AS reader_id, CAST(c_nationkey AS INTEGER) AS cutoff, 'Brand#' || (c_custkey % 25 + 1) AS item FROM customer)
  SELECT reader_id, item AS item_id, (SELECT arg_max(version, f) FROM v WHERE v.item = r.item AND (f <= cutoff OR cutoff >= 24)) AS version FROM r WHERE item IN (SELECT item FROM v)""")
def versions(spark, sf_dir):
    p = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("item_id"), F.col("p_size").alias("from")).agg(F.max("p_partkey").alias("version"))
    r = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("reader_id"), F.col("c_nationkey").alias("cutoff"), F.concat(F.lit("Brand#"), F.col("c_custkey") % 25 + 1).alias("item_id"))
    return g.pick_version(p, r, 24)


@query("g10_gate_coverage", """WITH s AS (SELECT p_type AS source, p_name AS name, CASE WHEN p_size > 40 THEN 'unknown' ELSE 'Chapter ' || p_size END AS first FROM part)
  SELECT source, count(*) AS entities, count(*) FILTER (first LIKE 'Chapter%') AS parsed, avg(CASE WHEN first LIKE 'Chapter%' THEN 1.0::DOUBLE ELSE 0 END) AS rate, array_to_string(list_sort(list(DISTINCT name) FILTER (first = 'unknown'))[1:5], '|') AS gaps FROM s GROUP BY 1""")
def gate_coverage(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return g.gate_coverage(p.select(F.col("p_type").alias("source"), F.col("p_name").alias("name"), F.when(F.col("p_size") > 40, "unknown").otherwise(F.concat(F.lit("Chapter "), "p_size")).alias("first")))

"""Evidence and reconciliation on the given tables: conversations are statements, benchmark passages give names and posts."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import evidence as e
from factloom.operators import reconcile as r
from factloom.plans.registry import query
from factloom.session import ensure_checkpoint_dir, table
from factloom.sources.tables import OBS, STATEMENTS, observations, statements

_NAMES = "names AS (SELECT DISTINCT regexp_extract(text, '^(\\S+ \\S+)', 1) AS name FROM benchmark)"
_WORDS = r"list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
_RUN = lambda n: f"list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i : i + {n - 1}], ' '))"
#: Names met with the documents that hold their words in a row; the names of these tables have up to five words.
_MET = f"""dw AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents), fm AS (SELECT name, array_to_string({_WORDS.format('name')}, ' ') AS g FROM names),
  gr AS (SELECT doc_id, unnest(list_distinct(list_concat({', '.join(map(_RUN, (1, 2)))}))) AS g FROM dw UNION SELECT doc_id, unnest(list_distinct(list_concat({', '.join(map(_RUN, (3, 4)))}))) FROM dw UNION SELECT doc_id, unnest({_RUN(5)}) FROM dw), met AS (SELECT DISTINCT name, doc_id FROM fm JOIN gr USING (g) WHERE g <> '')"""


def _names(spark, sf_dir):
    n = table(spark, sf_dir, "benchmark").select(F.regexp_extract("text", r"^(\S+ \S+)", 1).alias("name")).distinct()
    return n.withColumn("form", F.col("name"))


@query("f1_mention_index", f"WITH {_NAMES}, {_MET}, x AS (SELECT name, doc_id, CAST(row_number() OVER (PARTITION BY name ORDER BY doc_id) AS INTEGER) AS rank FROM met WHERE length(name) >= 4) SELECT * FROM x WHERE rank <= 20")
def mention_index(spark, sf_dir):
    return e.mention_index(_names(spark, sf_dir), table(spark, sf_dir, "documents"), "doc_id", "text", "doc_id").select("name", "doc_id", "rank")


@query("f2_linkify")
def linkify(spark, sf_dir):
    return e.linkify(table(spark, sf_dir, "documents"), "doc_id", "text", _names(spark, sf_dir))


def _claims(spark, sf_dir):
    """A claim for each statement: its question's first word, with a word of its answer."""
    s = statements(spark, sf_dir)
    word = lambda c, n: F.regexp_replace(F.get(F.split(c, r"\s+", n + 2), F.lit(n)), r"[^\p{L}]", "")
    rows = s.select(F.col("statement_id").alias("claim_id"), word("question", 0).alias("name"), F.lit("says").alias("predicate"), word("answer", 3).alias("value"))
    return rows.where(F.length("name") >= 4).where(F.length("value") >= 4)


#: Stand-ins from the tables' invented prose, so that every branch has cases.
RULES = e.Rules(dodge=("was of", "by that", "no comment"), negation=("by", "hardly"), agreement=("to", "be", "so it is"), joke=("of it", "only teasing"))


@query("f3_proximity_matches")
def proximity(spark, sf_dir):
    s = statements(spark, sf_dir).select("statement_id", F.concat_ws(" / ", "question", "answer").alias("text"))
    pairs = _claims(spark, sf_dir).join(s, F.col("claim_id") == F.col("statement_id")).select("claim_id", "text", "name", "value")
    return e.proximity_matches(pairs, 80).select("claim_id", "at", "snippet")


@query("f4_evaluate_evidence")
def evaluate(spark, sf_dir):
    pairs = _claims(spark, sf_dir).join(statements(spark, sf_dir), F.col("claim_id") == F.col("statement_id")).select("claim_id", "question", "answer", "name", "value")
    return e.evaluate_evidence(pairs, RULES).select("claim_id", "tier", "intent", "rule")


@query("f5_verify_claims")
def verify(spark, sf_dir):
    return e.verify_claims(_claims(spark, sf_dir), statements(spark, sf_dir), RULES)


@query("f5_verified_facts")
def verified(spark, sf_dir):
    """Facts with their two sources, of the claims on the hundred names most often asked about."""
    ensure_checkpoint_dir(spark)
    claims, s = _claims(spark, sf_dir).checkpoint(), statements(spark, sf_dir)
    top = e.top_subjects(claims, "name", 100)
    claims = claims.join(top.select("name"), "name", "left_semi")
    found = e.verified_facts(e.verify_claims(claims, s, RULES), claims, F.concat(F.lit("page/"), "name"))
    record = F.element_at("sources", 2)
    return found.select("claim_id", "name", "tier", "intent", F.element_at("sources", 1)["item_id"].alias("statement_id"), record["page"].alias("page"), record["field"].alias("field"), record["value_at_verify"].alias("value_at_verify"))


@query("f5_top_subjects", f"WITH {OBS} SELECT subject AS name, count(*) AS observations FROM obs GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50")
def top_subjects(spark, sf_dir):
    return e.top_subjects(observations(spark, sf_dir), "subject", 50)


@query("f5_curation_queue", """WITH b AS (SELECT o_orderkey AS claim_id, o_custkey AS evidence_id, CASE WHEN o_orderstatus = 'F' THEN 'ambiguous' ELSE 'serious' END AS intent FROM orders), led AS (SELECT DISTINCT l_orderkey AS claim_id FROM lineitem WHERE l_returnflag = 'A')
  SELECT claim_id, evidence_id, 'n' || claim_id AS name, 'says' AS predicate, 'v' || claim_id AS value, 'digits' AS rule FROM b WHERE intent = 'ambiguous' AND claim_id NOT IN (SELECT claim_id FROM led)""")
def curation(spark, sf_dir):
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    k = F.col("o_orderkey")
    best = o.select(k.alias("claim_id"), F.col("o_custkey").alias("statement_id"), F.when(F.col("o_orderstatus") == "F", "ambiguous").otherwise("serious").alias("intent"), F.lit("digits").alias("rule"))
    claims = o.select(k.alias("claim_id"), F.concat(F.lit("n"), k).alias("name"), F.lit("says").alias("predicate"), F.concat(F.lit("v"), k).alias("value"))
    ledger = l.where("l_returnflag = 'A'").join(o, F.col("l_orderkey") == k).select(k.alias("claim_id"), F.col("o_custkey").alias("evidence_id"))
    return e.curation_queue(best, claims, ledger)


@query("f5_changed_since", "SELECT p_partkey AS claim_id, p_name AS then, CASE WHEN p_partkey % 3 = 0 THEN p_type END AS now FROM part WHERE p_partkey % 4 <> 0 AND p_partkey % 3 <> 1 AND (p_partkey % 3 = 2 OR p_type <> p_name)")
def changed_values(spark, sf_dir):
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    claims = p.select(k.alias("claim_id"), k.cast("string").alias("name"), F.lit("title").alias("predicate"), F.col("p_name").alias("value"))
    best = p.select(k.alias("claim_id"), k.alias("statement_id"), F.lit("canon").alias("tier"), F.lit("serious").alias("intent"), F.lit("near").alias("rule"))
    records = p.where(k % 4 != 0).select(k.cast("string").alias("page"), F.lit("title").alias("field"), F.when(k % 3 == 0, F.col("p_type")).when(k % 3 == 1, F.col("p_name")).alias("value"))
    return e.changed_since(e.verified_facts(best, claims, F.col("name")), records)


_QUEUE = """q AS (SELECT o_orderkey AS claim_id, o_custkey AS evidence_id FROM orders), led AS (SELECT l_orderkey AS claim_id, o_custkey AS evidence_id, arg_max(l_returnflag, l_linenumber * 100000000 + l_partkey) AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag <> 'N' GROUP BY 1, 2)"""


def _decided(spark, sf_dir):
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem").where("l_returnflag <> 'N'")
    queue = o.select(F.col("o_orderkey").alias("claim_id"), F.col("o_custkey").alias("evidence_id"))
    ledger = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_orderkey").alias("claim_id"), F.col("o_custkey").alias("evidence_id"), F.when(F.col("l_returnflag") == "A", "approve").otherwise("reject").alias("decision"), (F.col("l_linenumber") * 100000000 + F.col("l_partkey")).alias("ordinal"))
    facts = o.select(F.col("o_orderkey").alias("claim_id"), F.when(F.col("o_orderstatus") == "F", "likely").otherwise("rumour").alias("tier"))
    return e.apply_decisions(queue, facts, ledger)


@query("f6_apply_decisions", f"WITH {_QUEUE} SELECT claim_id, evidence_id FROM q WHERE claim_id NOT IN (SELECT claim_id FROM led)")
def decisions(spark, sf_dir):
    return _decided(spark, sf_dir)[0]


@query("f6_lifted_facts", f"WITH {_QUEUE} SELECT o_orderkey AS claim_id, CASE WHEN o_orderstatus <> 'F' THEN 'rumour' WHEN d = 'A' THEN 'canon' ELSE 'likely' END AS tier, coalesce(o_orderstatus = 'F' AND d = 'A', false) AS approved FROM orders LEFT JOIN led ON claim_id = o_orderkey")
def lifted(spark, sf_dir):
    return _decided(spark, sf_dir)[1]


@query("f7_prove_claims")
def prove(spark, sf_dir):
    ensure_checkpoint_dir(spark)
    claims = _claims(spark, sf_dir).checkpoint()
    facts = claims.select("name", "predicate", "value", F.when(F.length("value") > 6, "canon").otherwise("likely").alias("tier"))
    return e.prove_claims(claims, facts, statements(spark, sf_dir), RULES)


@query("f8_parse_claims", f"""WITH {_NAMES}, {_MET}, b AS (SELECT doc_id, max((length(name), name)) AS n FROM met WHERE length(name) >= 3 GROUP BY 1)
  SELECT d.doc_id AS text_id, n[2] AS name, 'about' AS predicate, trim(regexp_extract(text, '(?i)the\\s+([^.,;!?]*)', 1)) AS value FROM documents d JOIN b USING (doc_id) WHERE contains(lower(text), 'the') AND trim(regexp_extract(text, '(?i)the\\s+([^.,;!?]*)', 1)) <> ''""")
def parse(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_id"), "text")
    return e.parse_claims(docs, _names(spark, sf_dir).select("name"), [("about", "the", r"^(\d{9,})$")])


@query("f9_retrieve_evidence", f"""WITH {STATEMENTS}, k AS (SELECT DISTINCT item_id AS post_id, lower(unnest(regexp_extract_all(text, '(\\p{{Lu}}\\p{{L}}{{2,}})', 1))) AS w FROM benchmark), kk AS (SELECT * FROM k WHERE w NOT IN ('the', 'and', 'this', 'that')),
  sw AS (SELECT DISTINCT statement_id, ordinal, unnest(regexp_split_to_array(lower(question || ' ' || answer), '[^\\p{{L}}\\p{{N}}]+')) AS w FROM statements), qw AS (SELECT DISTINCT statement_id, unnest(regexp_split_to_array(lower(question), '[^\\p{{L}}\\p{{N}}]+')) AS w FROM statements),
  sc AS (SELECT post_id, sw.statement_id, ordinal, count(*) + 0.5::DOUBLE * count(qw.w) AS score FROM kk JOIN sw USING (w) LEFT JOIN qw ON qw.statement_id = sw.statement_id AND qw.w = kk.w GROUP BY 1, 2, 3),
  rk AS (SELECT post_id, statement_id, CAST(score AS DOUBLE) AS score, CAST(row_number() OVER (PARTITION BY post_id ORDER BY score DESC, ordinal) AS INTEGER) AS rank FROM sc) SELECT * FROM rk WHERE rank <= 5""")
def retrieve(spark, sf_dir):
    return e.retrieve_evidence(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("post_id"), "text"), statements(spark, sf_dir)).withColumn("score", F.col("score").cast("double"))


@query("f9_retrieve_by_topics", f"""WITH {STATEMENTS}, t AS (SELECT DISTINCT lower(regexp_extract(text, '^(\\p{{L}}+) (\\p{{L}}+)', 1) || ' ' || regexp_extract(text, '^(\\p{{L}}+) (\\p{{L}}+)', 2)) AS w FROM benchmark WHERE regexp_matches(text, '^\\p{{L}}+ \\p{{L}}+')),
  pw AS (SELECT item_id AS post_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS a FROM benchmark), k AS (SELECT DISTINCT item_id AS post_id, lower(unnest(regexp_extract_all(text, '(\\p{{Lu}}\\p{{L}}{{2,}})', 1))) AS w FROM benchmark),
  kk AS (SELECT * FROM k WHERE w NOT IN ('the', 'and', 'this', 'that') UNION SELECT post_id, w FROM pw JOIN t ON contains(' ' || array_to_string(a, ' ') || ' ', ' ' || w || ' ')),
  st AS (SELECT statement_id, ordinal, ' ' || array_to_string(list_filter(regexp_split_to_array(lower(question || ' ' || answer), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> ''), ' ') || ' ' AS b, ' ' || array_to_string(list_filter(regexp_split_to_array(lower(question), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> ''), ' ') || ' ' AS q FROM statements),
  ws AS (SELECT DISTINCT w FROM kk), m AS (SELECT statement_id, ordinal, w, contains(q, ' ' || w || ' ') AS in_q FROM st JOIN ws ON contains(b, ' ' || w || ' ')),
  sc AS (SELECT post_id, statement_id, ordinal, CAST(count(*) + 0.5::DOUBLE * count(*) FILTER (in_q) AS DOUBLE) AS score FROM kk JOIN m USING (w) GROUP BY 1, 2, 3),
  rk AS (SELECT post_id, statement_id, score, CAST(row_number() OVER (PARTITION BY post_id ORDER BY score DESC, ordinal) AS INTEGER) AS rank FROM sc) SELECT * FROM rk WHERE rank <= 5""")
def retrieve_topics(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    topics = b.select(F.lower(F.regexp_extract("text", r"^(\p{L}+ \p{L}+)", 1)).alias("term")).where("term <> ''").distinct()
    return e.retrieve_evidence(b.select(F.col("item_id").alias("post_id"), "text"), statements(spark, sf_dir), topics=topics).withColumn("score", F.col("score").cast("double"))


_CATALOGUE = "cat AS (SELECT 'subject' AS kind, p_partkey AS item_id, p_name AS title, CASE WHEN p_size > 5 THEN p_size END AS first FROM part UNION ALL SELECT 'item', s_suppkey, s_name, CASE WHEN s_nationkey > 3 THEN s_nationkey END FROM supplier)"


@query("f10_search", f"""WITH {_CATALOGUE}, q AS (SELECT r_regionkey AS query_id, CASE r_regionkey WHEN 0 THEN ' Ring' WHEN 1 THEN '0001' WHEN 2 THEN 'ed' WHEN 3 THEN 'x' ELSE '' END AS text, r_regionkey * 10 AS cutoff FROM region),
  h AS (SELECT query_id, kind, item_id, CAST(row_number() OVER (PARTITION BY query_id, kind ORDER BY title, item_id) AS INTEGER) AS rank FROM cat JOIN q ON contains(lower(title), lower(trim(text))) AND trim(text) <> '' WHERE coalesce(first <= cutoff, kind = 'subject' AND first IS NULL)) SELECT * FROM h WHERE rank <= CASE kind WHEN 'subject' THEN 6 ELSE 10 END""")
def search(spark, sf_dir):
    p, s, g = (table(spark, sf_dir, n) for n in ("part", "supplier", "region"))
    cat = p.select(F.lit("subject").alias("kind"), F.col("p_partkey").alias("item_id"), F.col("p_name").alias("title"), F.when(F.col("p_size") > 5, F.col("p_size")).alias("first")).union(s.select(F.lit("item"), "s_suppkey", "s_name", F.when(F.col("s_nationkey") > 3, F.col("s_nationkey"))))
    k = F.col("r_regionkey")
    q = g.select(k.alias("query_id"), F.when(k == 0, " Ring").when(k == 1, "0001").when(k == 2, "ed").when(k == 3, "x").otherwise("").alias("text"), (k * 10).alias("cutoff"))
    return e.search(q, cat, {"subject": 6, "item": 10})


@query("f10_search_positions", f"""WITH {_CATALOGUE}, q AS (SELECT c_custkey AS query_id, CAST(c_custkey % 2500 AS VARCHAR) AS text, 30 AS cutoff FROM customer),
  h AS (SELECT query_id, kind, item_id, CAST(row_number() OVER (PARTITION BY query_id, kind ORDER BY title, item_id) AS INTEGER) AS rank FROM cat JOIN q ON contains(lower(title), text) WHERE coalesce(first <= cutoff, kind = 'subject' AND first IS NULL))
  SELECT * FROM h WHERE rank <= 5 UNION ALL SELECT query_id, 'position', CAST(text AS BIGINT), 1 FROM q WHERE CAST(text AS BIGINT) BETWEEN 1 AND 1200""")
def search_positions(spark, sf_dir):
    p, s, c = (table(spark, sf_dir, n) for n in ("part", "supplier", "customer"))
    cat = p.select(F.lit("subject").alias("kind"), F.col("p_partkey").alias("item_id"), F.col("p_name").alias("title"), F.when(F.col("p_size") > 5, F.col("p_size")).alias("first")).union(s.select(F.lit("item"), "s_suppkey", "s_name", F.when(F.col("s_nationkey") > 3, F.col("s_nationkey"))))
    q = c.select(F.col("c_custkey").alias("query_id"), (F.col("c_custkey") % 2500).cast("string").alias("text"), F.lit(30).alias("cutoff"))
    return e.search(q, cat, {}, latest=1200, small=100)


@query("f11_build_cards", """SELECT 'doc:' || doc_id AS id, 'doc' AS type, CASE WHEN length(text) > 120 THEN substr(text, 1, 120) || '…' ELSE text END AS title, source AS subtitle, substr(lower(text || ' ' || source || ' ' || lang), 1, 400) AS tokens FROM documents
  UNION ALL SELECT 'part:' || p_partkey, 'part', p_name, p_brand, lower(p_name || ' ' || p_brand || ' ' || p_type) FROM part""")
def cards(spark, sf_dir):
    d, p = table(spark, sf_dir, "documents"), table(spark, sf_dir, "part")
    return e.build_cards({"doc": d.select(F.col("doc_id").alias("id"), F.col("text").alias("title"), F.col("source").alias("subtitle"), F.col("lang").alias("text")), "part": p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("subtitle"), F.col("p_type").alias("text"))})


@query("f12_find_conflicts", """WITH f AS (SELECT l_orderkey AS subject, l_returnflag AS predicate, lower(l_linestatus) || (l_linenumber % 3) AS value, l_linenumber * 10000000 + l_partkey AS ordinal FROM lineitem), g AS (SELECT subject, predicate, arg_min(value, ordinal) AS first, count(*) AS n FROM f WHERE predicate <> 'N' GROUP BY 1, 2 HAVING count(*) > 1)
  SELECT subject, predicate, any_value(n) AS n, array_to_string(list_sort(list(DISTINCT value)), ',') AS values FROM f JOIN g USING (subject, predicate) GROUP BY 1, 2 HAVING bool_or(right(value, 1) <> right(first, 1)) AND count(DISTINCT value) > 1""")
def conflicts(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    f = l.select(F.col("l_orderkey").alias("subject"), F.col("l_returnflag").alias("predicate"), F.concat(F.lower("l_linestatus"), F.col("l_linenumber") % 3).alias("value"), (F.col("l_linenumber") * 10000000 + F.col("l_partkey")).alias("ordinal"))
    return r.find_conflicts(f, ("N",)).withColumn("values", F.array_join("values", ","))


@query("f12_record_conflicts", """WITH rec AS (SELECT o_custkey AS subject, 'status' AS predicate, max(o_orderstatus) AS value FROM orders GROUP BY 1), f AS (SELECT o_custkey AS subject, arg_max(lower(o_orderstatus), o_orderkey) AS verified FROM orders GROUP BY 1)
  SELECT subject, predicate, value AS recorded, verified FROM rec JOIN f USING (subject) WHERE lower(value) <> verified""")
def record_conflicts(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("subject"), F.lit("status").alias("predicate"), "o_orderstatus", F.col("o_orderkey").alias("ordinal"))
    rec = o.groupBy("subject", "predicate").agg(F.max("o_orderstatus").alias("value"))
    return r.record_conflicts(rec, o.select("subject", "predicate", F.lower("o_orderstatus").alias("value"), "ordinal"))


@query("f13_classify_conflicts", """WITH c AS (SELECT l_returnflag AS shard, CASE l_linenumber % 3 WHEN 0 THEN 'count' WHEN 1 THEN 'position' ELSE 'value' END AS kind, l_partkey AS entity, CAST(l_quantity AS INTEGER) - 20 AS delta, l_suppkey FROM lineitem)
  SELECT shard, kind, CASE WHEN l_suppkey = 7 THEN 'unseen' WHEN kind = 'count' AND abs(delta) > 10 OR kind = 'position' AND abs(delta) > 25 + 5 THEN 'wide' WHEN kind <> 'value' THEN 'narrow' ELSE 'other' END AS class, count(*) AS n, count(DISTINCT entity) AS entities FROM c GROUP BY 1, 2, 3""")
def classify(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    n = F.col("l_linenumber") % 3
    c = l.select(F.col("l_returnflag").alias("shard"), F.when(n == 0, "count").when(n == 1, "position").otherwise("value").alias("kind"), F.col("l_partkey").alias("entity"), (F.col("l_quantity").cast("int") - 20).alias("delta"), F.when(F.col("l_suppkey") == 7, "a‎").otherwise("a").alias("name"))
    return r.classify_conflicts(c, ("unseen", "wide", "narrow", "other"), 10, 30)


@query("f14_first_position_disagreement", """WITH f AS (SELECT o_custkey AS subject, min(day(o_orderdate)) AS fact, max(month(o_orderdate)) AS record FROM orders GROUP BY 1)
  SELECT subject, CAST(fact AS INTEGER) AS fact, CAST(record AS INTEGER) AS record, CAST(record - fact AS INTEGER) AS delta, CASE WHEN record > fact THEN 'later' ELSE 'earlier' END AS kind FROM f WHERE abs(record - fact) >= 5""")
def disagreement(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("subject"))
    return r.first_position_disagreement(o.agg(F.min(F.dayofmonth("o_orderdate")).alias("position")), o.agg(F.max(F.month("o_orderdate")).alias("position")))


@query("f15_external_drift", """SELECT p_partkey AS subject, 'name' AS field, CASE WHEN p_partkey % 5 = 0 THEN 'unparsed' WHEN p_partkey % 5 = 1 THEN 'drift' WHEN p_partkey % 2 = 0 THEN 'promotable' ELSE 'same' END AS outcome FROM part""")
def drift(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    ours = p.select(k.alias("subject"), F.lit("name").alias("field"), F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("value"))
    theirs = ours.where("subject % 5 <> 0").withColumn("value", F.when(F.col("subject") % 5 == 1, F.concat(F.lit("x"), "value")).when(F.col("subject") % 5 == 2, F.substring("value", 1, 18)).otherwise(F.upper("value")))
    return r.external_drift(ours, theirs, p.where("p_partkey % 2 = 0").select(k.alias("subject")))


@query("f16_triage_queue", "SELECT p_partkey AS claim_id, CASE WHEN p_size % 4 = 0 THEN 'coincidence' WHEN p_size % 4 = 1 THEN 'confirmable' ELSE 'review' END AS verdict FROM part")
def triage(spark, sf_dir):
    n = F.col("p_size")
    q = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("claim_id"), F.col("p_name").alias("subject"), F.when(n % 4 <= 1, "birthday").otherwise("age").alias("field"), F.concat(F.lit("May "), n).alias("value"), F.when(n % 4 == 0, F.concat(F.lit("in Chapter "), n)).otherwise(F.concat(F.lit("of "), F.upper(F.split_part("p_name", F.lit(" "), F.lit(2))), F.lit(", chapter 900"))).alias("snippet"))
    return r.triage_queue(q)


@query("f17_stale_items", "SELECT o_orderkey AS key, CASE WHEN o_orderkey % 4 = 0 THEN 'unknown' WHEN o_orderkey % 4 = 1 THEN 'first-seen' WHEN o_orderstatus = 'F' THEN 'same' ELSE 'stale' END AS state FROM orders")
def stale(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("revision"))
    return r.stale_items(o.where("key % 4 <> 0").withColumn("revision", F.when(F.col("key") % 4 != 1, F.lit("F"))), o)


@query("f17_stale_checks", """WITH c AS (SELECT o_orderpriority AS "check", max(CASE WHEN o_orderstatus = 'F' OR o_orderpriority LIKE '1%' THEN CAST(o_orderdate AS DATE) END) AS last FROM orders GROUP BY 1) SELECT "check", last, last IS NULL OR last < (SELECT max(CAST(o_orderdate AS DATE)) FROM orders) AS stale FROM c""")
def stale_checks(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("check"), F.to_date("o_orderdate").alias("on"), "o_orderstatus")
    return r.stale_checks(o.withColumn("on", F.when((F.col("o_orderstatus") == "F") | F.col("check").startswith("1"), F.col("on"))), o)


@query("f18_changed_inputs", "SELECT source AS stage, bool_or(doc_id % 37 = 0 OR doc_id % 41 = 0) AS needed FROM documents GROUP BY 1")
def changed(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    k = F.col("doc_id")
    manifest = d.where(k % 37 != 0).select(k.alias("path"), F.when(k % 41 == 0, "old").otherwise(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"))
    return r.changed_inputs(d.select(F.col("source").alias("stage"), k.alias("path"), F.col("text").alias("content")), manifest)


@query("f19_stamp_age", "SELECT o_orderkey AS key, CAST(o_orderdate AS DATE) AS stamp, CAST(DATE '2005-01-01' - CAST(o_orderdate AS DATE) AS INTEGER) AS age FROM orders WHERE DATE '2005-01-01' - CAST(o_orderdate AS DATE) > 1500")
def stamps(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.concat(F.lit("as of "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(", 2001-99-99")).alias("text"))
    return r.stamp_age(o, "key", "text", F.lit("2005-01-01").cast("date"), 1500)


@query("f19_claim_drift", "SELECT o_orderkey AS key, 'orders' AS stat, o_orderkey AS claimed, (SELECT count(*) FROM orders) AS live FROM orders WHERE abs(o_orderkey - (SELECT count(*) FROM orders)) > (SELECT count(*) FROM orders) * 0.5::DOUBLE")
def claim_drift(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    docs = o.select(F.col("o_orderkey").alias("key"), F.concat(F.lit("we hold "), F.format_number("o_orderkey", 0), F.lit(" orders")).alias("text"))
    stats = o.agg(F.count(F.lit(1)).alias("live")).select(F.lit("orders").alias("stat"), "live")
    return r.claim_drift(docs, "key", "text", {"orders": r"hold ([\d,]+) orders"}, stats, 0.5)

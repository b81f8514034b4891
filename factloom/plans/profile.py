"""Profiles, rankings and comparisons on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import profile
from factloom.plans.registry import query
from factloom.session import table
from factloom.sources.tables import OBS, observations


@query("d5_profile_observations", f"""WITH {OBS} SELECT kind, count(*) AS rows, count(DISTINCT position) AS positions, count(DISTINCT subject) AS subjects,
  count(*) FILTER (position < 2 OR position > 29) AS out_of_range, count(*) FILTER (kind NOT IN ('click', 'view', 'purchase')) AS unknown_kind FROM obs GROUP BY GROUPING SETS ((kind), ())""")
def profile_(spark, sf_dir):
    return profile.profile_observations(observations(spark, sf_dir), ("click", "view", "purchase"), 2, 29)


@query("d6_sequence_gaps", """WITH p AS (SELECT DISTINCT o_orderkey AS n FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 3), e AS (SELECT unnest(range(1, (SELECT max(n) + 1 FROM p))) AS n)
  SELECT n FROM e WHERE n NOT IN (SELECT n FROM p) AND n NOT IN (SELECT c_custkey FROM customer)""")
def gaps(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("n")).where("n % 7 <> 0 AND n % 11 <> 3")
    return profile.sequence_gaps(o, "n", table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("n")), start=1)


@query("d7_membership_groups", """WITH m AS (SELECT DISTINCT l_suppkey AS grp, l_partkey AS member, CASE l_returnflag WHEN 'R' THEN 'former' WHEN 'A' THEN 'current' ELSE 'alleged' END AS status FROM lineitem)
  SELECT grp, count(*) AS members, count(*) FILTER (status = 'current') AS current FROM m GROUP BY grp ORDER BY members DESC, grp LIMIT 50""")
def groups(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    m = l.select(F.col("l_suppkey").alias("grp"), F.col("l_partkey").alias("member"), F.when(F.col("l_returnflag") == "R", "former").when(F.col("l_returnflag") == "A", "current").otherwise("alleged").alias("status"))
    return profile.top_k(profile.membership_groups(m, "grp", "member", "status"), [F.desc("members"), F.col("grp")], 50)


@query("d8_cross_tab_provenance", """WITH f AS (SELECT l_orderkey, array_to_string(list_sort(list(DISTINCT l_returnflag)), '+') AS sources FROM lineitem GROUP BY 1)
  SELECT sources, o_orderpriority AS tier, count(*) AS facts, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0.0 END) AS verified FROM f JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2""")
def provenance(spark, sf_dir):
    types = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("types"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("tier"), (F.col("o_orderstatus") == "F").cast("int").alias("verified"))
    return profile.cross_tab_provenance(types.join(o, types["l_orderkey"] == o["o_orderkey"]), "types", "tier", "verified")


@query("d9_cross_tab_totals", "SELECT p_brand, " + ", ".join(f"count(*) FILTER (p_type = '{t}') AS \"{t}\"" for t in ("ECONOMY", "STANDARD", "PROMO")) + ", count(*) AS total FROM part GROUP BY p_brand")
def totals(spark, sf_dir):
    return profile.cross_tab_totals(table(spark, sf_dir, "part"), "p_brand", "p_type", ["ECONOMY", "STANDARD", "PROMO"])


_FILL = ("lang", "source", "text", "n_chars")


@query("d10_fill_rates", " UNION ALL ".join(f"SELECT '{c}' AS field, count(*) FILTER (trim(CAST({c} AS VARCHAR)) <> '') AS filled, count(*) AS rows FROM documents" for c in _FILL))
def fill(spark, sf_dir):
    return profile.fill_rates(table(spark, sf_dir, "documents"), list(_FILL))


@query("d11_headline_stats", "SELECT (SELECT count(DISTINCT c_custkey) FROM customer) AS subjects, (SELECT count(DISTINCT lower(w)) FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) WHERE w <> 'red') AS credits, (SELECT count(*) FROM orders) AS facts")
def headline(spark, sf_dir):
    words = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("w")).where("w <> 'red'")
    return profile.headline_stats(subjects=table(spark, sf_dir, "customer").agg(F.count_distinct("c_custkey")), credits=words.agg(F.count_distinct(F.lower("w"))), facts=table(spark, sf_dir, "orders").agg(F.count(F.lit(1))))


@query("d12_invert_multivalue", "WITH w AS (SELECT DISTINCT p_brand, unnest(string_split(p_name, ' ')) AS value FROM part) SELECT value, array_to_string(list(p_brand ORDER BY p_brand), ',') AS keys, count(*) AS n FROM w GROUP BY value")
def invert(spark, sf_dir):
    out = profile.invert_multivalue(table(spark, sf_dir, "part"), "p_brand", F.split("p_name", " "), per=None)
    return out.withColumn("keys", F.array_join("keys", ","))


@query("d13_first_n_per_group", f"""WITH {OBS}, once AS (SELECT position, lower(subject) AS k, arg_min(subject, ordinal) AS subject, min(ordinal) AS ordinal FROM obs GROUP BY 1, 2),
  r AS (SELECT position, subject, CAST(row_number() OVER (PARTITION BY position ORDER BY ordinal) AS INTEGER) AS rank FROM once) SELECT * FROM r WHERE rank <= 8""")
def first_n(spark, sf_dir):
    return profile.first_n_per_group(observations(spark, sf_dir), "position", "subject", "ordinal", 8)


@query("d14_min_position_map", f"""WITH {OBS}, u AS (SELECT subject AS name, position FROM obs UNION ALL SELECT c_name, c_nationkey FROM customer UNION ALL SELECT p_name, p_size FROM part)
  SELECT name, min(position) AS position FROM u WHERE length(trim(name)) >= 2 AND position IS NOT NULL GROUP BY name""")
def min_map(spark, sf_dir):
    obs = observations(spark, sf_dir).select(F.col("subject").alias("name"), "position")
    c = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("position"))
    p = table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_size").alias("position"))
    return profile.min_position_map([obs, c, p])


@query("d15_compare_counts", """WITH e AS (SELECT l_orderkey AS entity, count(DISTINCT l_linenumber) AS edges FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1),
  f AS (SELECT o_orderkey AS entity, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 3 ELSE 2 END) AS BIGINT) AS facts FROM orders WHERE o_orderkey % 5 <> 0 GROUP BY 1)
  SELECT entity, edges, facts, CASE WHEN facts IS NULL THEN 'no-fact' WHEN edges IS NULL THEN 'no-edge' WHEN edges = facts THEN 'agree' ELSE 'disagree' END AS verdict, coalesce(edges, 0) - coalesce(facts, 0) AS delta FROM e FULL JOIN f USING (entity)""")
def parity(spark, sf_dir):
    e = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'R'").select(F.col("l_orderkey").alias("entity"), F.col("l_linenumber").alias("position"))
    f = table(spark, sf_dir, "orders").where("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("entity"), F.when(F.col("o_orderstatus") == "F", 3).otherwise(2).cast("long").alias("value"))
    return profile.compare_counts(e, f)


@query("d16_coverage", """WITH x AS (SELECT DISTINCT p_brand AS brand, lower(trim(CAST(p_partkey AS VARCHAR))) AS k FROM part), h AS (SELECT DISTINCT lower(trim(CAST(l_partkey AS VARCHAR))) AS k FROM lineitem WHERE l_quantity > 40 AND l_returnflag = 'R')
  SELECT brand, count(*) AS expected, count(*) FILTER (h.k IS NULL) AS missing, 1 - count(*) FILTER (h.k IS NULL) / count(*)::DOUBLE AS rate, 1 - count(*) FILTER (h.k IS NULL) / count(*)::DOUBLE < 0.899 AS regressed FROM x LEFT JOIN h USING (k) GROUP BY brand""")
def coverage(spark, sf_dir):
    expected = table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), F.concat(F.lit(" "), F.col("p_partkey").cast("string")).alias("k"))
    present = table(spark, sf_dir, "lineitem").where("l_quantity > 40 AND l_returnflag = 'R'").select(F.col("l_partkey").cast("string").alias("k"))
    return profile.coverage(expected, present, "k", "brand", 0.9)


@query("d17_compare_membership", """WITH a AS (SELECT c_nationkey AS grp, c_name AS name, c_acctbal > 0 AS flag FROM customer WHERE c_custkey % 97 <> 0), b AS (SELECT c_nationkey AS grp, c_name AS name, c_acctbal > CASE WHEN c_nationkey % 2 = 0 THEN 100 ELSE 0 END AS flag FROM customer WHERE c_custkey % 89 <> 0),
  j AS (SELECT coalesce(a.grp, b.grp) AS grp, a.name IS NULL OR b.name IS NULL AS one, a.name IS NOT NULL AND b.name IS NOT NULL AND a.flag <> b.flag AS f, b.name IS NULL AS oa, a.name IS NULL AS ob FROM a FULL JOIN b ON a.grp = b.grp AND a.name = b.name)
  SELECT grp, CASE WHEN bool_or(one) AND bool_or(f) THEN 'both' WHEN bool_or(one) THEN 'names' WHEN bool_or(f) THEN 'flags' ELSE 'identical' END AS verdict, count(*) FILTER (oa) AS only_a, count(*) FILTER (ob) AS only_b FROM j GROUP BY grp""")
def membership(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    a = c.where("c_custkey % 97 <> 0").select(F.col("c_nationkey").alias("grp"), F.col("c_name").alias("name"), (F.col("c_acctbal") > 0).alias("flag"))
    b = c.where("c_custkey % 89 <> 0").select(F.col("c_nationkey").alias("grp"), F.col("c_name").alias("name"), (F.col("c_acctbal") > F.when(F.col("c_nationkey") % 2 == 0, 100).otherwise(0)).alias("flag"))
    return profile.compare_membership(a, b)


@query("d18_heaviest", "SELECT page_id, length(html) AS size, CASE WHEN length(html) >= 20000 THEN 'error' WHEN length(html) >= 5000 THEN 'warning' ELSE 'ok' END AS severity FROM pages ORDER BY 2 DESC, 1 LIMIT 40")
def heaviest(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.length("html").cast("long").alias("size"))
    return profile.heaviest(p, "page_id", "size", 40, 5000, 20000)


@query("d19_summarise_findings", """WITH f AS (SELECT source AS section, CASE WHEN n_chars > 20000 THEN 'error' WHEN n_chars > 5000 THEN 'warning' ELSE 'note' END AS severity FROM documents)
  SELECT section, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'note') AS notes, max(CASE severity WHEN 'error' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END) AS code FROM f GROUP BY section""")
def findings(spark, sf_dir):
    severity = F.when(F.col("n_chars") > 20000, "error").when(F.col("n_chars") > 5000, "warning").otherwise("note")
    return profile.summarise_findings(table(spark, sf_dir, "documents").select(F.col("source").alias("section"), severity.alias("severity")))


@query("d7_keep_ids", """WITH g AS (SELECT c_nationkey AS grp, count(*) AS members FROM customer GROUP BY 1), o AS (SELECT n_nationkey AS grp, CASE WHEN n_nationkey % 3 <> 0 THEN 'g:' || n_nationkey END AS id, n_name AS slug FROM nation WHERE n_nationkey % 5 <> 0)
  SELECT g.grp, members, o.id, o.slug FROM g LEFT JOIN o ON o.grp = g.grp AND o.id IS NOT NULL""")
def kept_ids(spark, sf_dir):
    groups = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("grp")).agg(F.count(F.lit(1)).alias("members"))
    n = F.col("n_nationkey")
    old = table(spark, sf_dir, "nation").where(n % 5 != 0).select(n.alias("grp"), F.when(n % 3 != 0, F.concat(F.lit("g:"), n)).alias("id"), F.col("n_name").alias("slug"))
    return profile.keep_ids(groups, old, "grp", ["id", "slug"])


@query("d16_missing_keys", """WITH x AS (SELECT DISTINCT p_brand AS brand, CAST(p_partkey AS VARCHAR) AS k FROM part), m AS (SELECT * FROM x WHERE k NOT IN (SELECT CAST(l_partkey AS VARCHAR) FROM lineitem WHERE l_quantity > 40 AND l_returnflag = 'R'))
  SELECT brand, k, count(*) OVER (PARTITION BY brand) AS missing FROM m""")
def missing(spark, sf_dir):
    expected = table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), F.concat(F.lit(" "), F.col("p_partkey").cast("string")).alias("k"))
    present = table(spark, sf_dir, "lineitem").where("l_quantity > 40 AND l_returnflag = 'R'").select(F.col("l_partkey").cast("string").alias("k"))
    return profile.missing_keys(expected, present, "k", "brand")


@query("d16_ratchet", """WITH a AS (SELECT p_brand AS category, round(avg(CASE WHEN p_size > 10 THEN 1.0::DOUBLE ELSE 0 END), 4) AS rate FROM part WHERE p_brand <> 'Brand#3' GROUP BY 1), b AS (SELECT p_brand AS category, round(avg(CASE WHEN p_retailprice > 1000 THEN 1.0::DOUBLE ELSE 0 END), 4) AS rate FROM part WHERE p_brand <> 'Brand#4' GROUP BY 1)
  SELECT category, greatest(a.rate, b.rate) AS rate FROM a FULL JOIN b USING (category)""")
def ratchet(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumnRenamed("p_brand", "category")
    share = lambda cond: F.avg(cond.cast("double")).alias("rate")
    old = p.where("category <> 'Brand#3'").groupBy("category").agg(share(F.col("p_size") > 10)).withColumn("rate", F.round("rate", 4))
    return profile.ratchet(old, p.where("category <> 'Brand#4'").groupBy("category").agg(share(F.col("p_retailprice") > 1000)))

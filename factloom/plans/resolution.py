"""Identities on the given tables: parts, suppliers and customers are the records."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import resolution as r
from factloom.plans.registry import query
from factloom.session import table
from factloom.sources.tables import OBS, observations


def _registry(spark, sf_dir):
    n = table(spark, sf_dir, "supplier").agg((F.max("s_suppkey") + 1).alias("next"))
    return n.select(F.lit("part").alias("prefix"), "next")


@query("c1_assign_ids", """WITH n AS (SELECT max(s_suppkey) + 1 AS next FROM supplier), w AS (SELECT p_name || ' ' || p_partkey AS name, p_partkey AS ordinal, CASE WHEN p_partkey % 3 = 0 THEN 'part:' || lpad(CAST(p_partkey AS VARCHAR), 5, '0') END AS id FROM part)
  SELECT name, ordinal, 'part:' || lpad(CAST((SELECT next FROM n) + row_number() OVER (ORDER BY ordinal) - 1 AS VARCHAR), 5, '0') AS id FROM w WHERE id IS NULL
  UNION ALL SELECT name, ordinal, id FROM w WHERE id IS NOT NULL UNION ALL SELECT name || chr(8203), ordinal + 1000000000, CAST(NULL AS VARCHAR) FROM w WHERE ordinal % 50 = 1""")
def assign(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    key = F.concat(F.lit("part:"), F.lpad(F.col("p_partkey").cast("string"), 5, "0"))
    rows = p.select(F.concat_ws(" ", "p_name", "p_partkey").alias("name"), F.col("p_partkey").alias("ordinal"), F.when(F.col("p_partkey") % 3 == 0, key).alias("id"))
    marked = rows.where("ordinal % 50 = 1").select(F.concat("name", F.lit("​")).alias("name"), (F.col("ordinal") + 1000000000).alias("ordinal"), F.lit(None).cast("string").alias("id"))
    return r.assign_ids(rows.union(marked), _registry(spark, sf_dir), "part")


@query("c2_assign_ordinals", """WITH w AS (SELECT o_orderkey AS key, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey END AS num FROM orders), t AS (SELECT max(num) AS top FROM w)
  SELECT key, num FROM w WHERE num IS NOT NULL UNION ALL SELECT key, (SELECT top FROM t) + row_number() OVER (ORDER BY key) AS num FROM w WHERE num IS NULL""")
def ordinals(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey")).alias("num"), F.col("o_custkey").alias("sort"))
    return r.assign_ordinals(rows, "num", "key", "sort").select("key", "num")


@query("c3_unique_slugs", """WITH b AS (SELECT replace(p_name, ' ', '-') AS base, p_partkey AS ordinal FROM part)
  SELECT CASE WHEN rn = 1 AND base NOT LIKE 'red-%' THEN base ELSE base || '-' || (rn + CASE WHEN base LIKE 'red-%' THEN 1 ELSE 0 END) END AS slug, ordinal FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY ordinal) AS rn FROM b)""")
def slugs(spark, sf_dir):
    base = table(spark, sf_dir, "part").select(F.translate("p_name", " ", "-").alias("base"), F.col("p_partkey").alias("ordinal"))
    return r.unique_slugs(base, base.where("base like 'red-%'").select(F.col("base").alias("slug")).distinct())


@query("c3_slugs_of_numbered_names")
def numbered_names(spark, sf_dir):
    """One base beside numbered ones: a number is free for the base's row until the row of its own base has come, or if it was never taken."""
    k, orders = F.col("o_orderkey"), table(spark, sf_dir, "orders")
    base = orders.select(F.when(k % 3 == 0, F.concat(F.lit("name-"), F.col("o_custkey") % 400 + 2)).otherwise("name").alias("base"), k.alias("ordinal"))
    return r.unique_slugs(base, table(spark, sf_dir, "supplier").select(F.concat(F.lit("name-"), F.col("s_suppkey") * 5).alias("slug")))


@query("c4_natural_keys", "SELECT conv_id, turn, 'ch:' || turn AS position_key, 'st:vol' || lpad(CAST(conv_id AS VARCHAR), greatest(3, 3), '0') || '-q' || lpad(CAST(turn AS VARCHAR), 4, '0') AS item_key FROM conversations")
def natural(spark, sf_dir):
    return r.natural_keys(table(spark, sf_dir, "conversations").select("conv_id", "turn"), "turn", "conv_id", "turn")


_WORDS = "SELECT p_partkey AS id, p_name AS name, p_brand || chr(10) || upper(p_name) || chr(10) || p_type || chr(10) || lower(p_brand) AS names FROM part"


@query("c5_build_aliases", f"""WITH rec AS ({_WORDS}), grps AS (SELECT DISTINCT p_type AS grp, p_name AS name FROM part),
  own AS (SELECT id, name, pos, alias FROM (SELECT id, name, unnest(string_split(names, chr(10))) AS alias, generate_subscripts(string_split(names, chr(10)), 1) - 1 AS pos FROM rec)),
  more AS (SELECT rec.id, rec.name, 1073741824 AS pos, g2.name AS alias FROM rec JOIN grps g1 ON g1.name = rec.name JOIN grps g2 ON g2.grp = g1.grp),
  b AS (SELECT id, lower(trim(alias)) AS k, pos, trim(alias) AS alias FROM (SELECT * FROM own UNION ALL SELECT * FROM more) WHERE trim(alias) <> '' AND lower(trim(alias)) <> lower(name)),
  o AS (SELECT *, row_number() OVER (PARTITION BY id, k ORDER BY pos, alias) AS first FROM b)
  SELECT id, alias, CAST(row_number() OVER (PARTITION BY id ORDER BY pos, alias) AS INTEGER) AS rank FROM o WHERE first = 1""")
def aliases(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    rec = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.concat_ws("\n", "p_brand", F.upper("p_name"), "p_type", F.lower("p_brand")).alias("names"))
    return r.build_aliases(rec, p.select(F.col("p_type").alias("grp"), F.col("p_name").alias("name")).distinct())


_FORMS = """forms AS (SELECT p_name AS form, 'part:' || p_partkey AS entity_id, 1 AS source, p_partkey AS ordinal, 0 AS place FROM part UNION ALL SELECT p_brand, 'part:' || p_partkey, 1, p_partkey, 1 FROM part
  UNION ALL SELECT upper(p_type), 'type:' || p_partkey, 2, p_partkey, 0 FROM part UNION ALL SELECT s_name, 'supplier:' || s_suppkey, 0, s_suppkey, 0 FROM supplier),
  per AS (SELECT lower(trim(form)) AS alias_key, entity_id, min((source * 1000000000 + ordinal) * 10 + place) AS seen_at FROM forms WHERE trim(form) <> '' GROUP BY 1, 2),
  ix AS (SELECT alias_key, arg_min(entity_id, seen_at) AS entity_id, count(*) - 1 AS collisions FROM per GROUP BY 1)"""


def alias_index(spark, sf_dir):
    p, s = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    form = lambda df, c, prefix, key, source, place: df.select(c.alias("form"), F.concat(F.lit(prefix), F.col(key).cast("string")).alias("entity_id"), F.lit(source).alias("source"), F.col(key).alias("ordinal"), F.lit(place).alias("place"))
    return r.build_alias_index(form(p, F.col("p_name"), "part:", "p_partkey", 1, 0).union(form(p, F.col("p_brand"), "part:", "p_partkey", 1, 1)).union(form(p, F.upper("p_type"), "type:", "p_partkey", 2, 0)).union(form(s, F.col("s_name"), "supplier:", "s_suppkey", 0, 0)))


@query("c6_build_alias_index", f"WITH {_FORMS} SELECT * FROM ix")
def index(spark, sf_dir):
    return alias_index(spark, sf_dir)


@query("c7_resolve_exact", f"""WITH {_FORMS}, n AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN p_type ELSE p_brand || chr(8203) END AS name FROM part)
  SELECT p_partkey, name, CASE WHEN entity_id LIKE 'part:%' THEN entity_id END AS entity_id FROM n LEFT JOIN ix ON lower(trim(replace(name, chr(8203), ''))) = alias_key""")
def exact(spark, sf_dir):
    k = F.col("p_partkey") % 3
    n = table(spark, sf_dir, "part").select("p_partkey", F.when(k == 0, F.upper("p_name")).when(k == 1, F.col("p_type")).otherwise(F.concat("p_brand", F.lit("​"))).alias("name"))
    return r.resolve_exact(n, "name", alias_index(spark, sf_dir), "part:")


@query("c8_resolve_loose", """WITH n AS (SELECT DISTINCT p_name || ' (' || p_brand || ')' AS name, p_name FROM part) SELECT name, p_name AS record, 'name' AS how FROM n""")
def loose(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    n = p.select(F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")")).alias("name"))
    brands = p.groupBy(F.col("p_brand").alias("alias_key")).agg(F.min("p_name").alias("name"))
    return r.resolve_loose(n, "name", p.select(F.col("p_name").alias("name")).distinct(), brands)


@query("c9_resolve_places", """WITH raw AS (SELECT DISTINCT CASE c_custkey % 4 WHEN 0 THEN n_name WHEN 1 THEN r_name || ' (' || n_name || ')' WHEN 2 THEN r_name || ' (x; ' || n_name || ', y)' ELSE r_name || ' (nowhere)' END AS raw, c_custkey % 4 AS k, n_nationkey, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
  SELECT DISTINCT raw, CASE WHEN k < 3 THEN 'nation:' || n_nationkey ELSE 'region:' || n_regionkey END AS place_id, CASE k WHEN 0 THEN 'exact' WHEN 3 THEN 'region' ELSE 'sub-location' END AS how FROM raw""")
def places(spark, sf_dir):
    c, n, g = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    k = F.col("c_custkey") % 4
    raw = F.when(k == 0, F.col("n_name")).when(k == 1, F.concat("r_name", F.lit(" ("), "n_name", F.lit(")"))).when(k == 2, F.concat("r_name", F.lit(" (x; "), "n_name", F.lit(", y)"))).otherwise(F.concat("r_name", F.lit(" (nowhere)")))
    rows = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(g, F.col("n_regionkey") == F.col("r_regionkey")).select(raw.alias("raw"))
    known = n.select(F.col("n_name").alias("name"), F.concat(F.lit("nation:"), "n_nationkey").alias("place_id")).union(g.select("r_name", F.concat(F.lit("region:"), "r_regionkey")))
    return r.resolve_places(rows, "raw", known)


@query("c10_summarise_unresolved", f"""WITH {OBS} SELECT subject AS name, count(*) AS n, min(position) AS first FROM obs WHERE CAST(substr(subject, 6) AS INTEGER) % 3 <> 0 AND subject NOT IN ('user 1', 'user 2') GROUP BY 1""")
def unresolved(spark, sf_dir):
    obs = observations(spark, sf_dir)
    known = obs.where("cast(substr(subject, 6) as int) % 3 = 0").select(F.lower("subject").alias("alias_key"), F.concat(F.lit("user:"), "subject").alias("entity_id")).distinct()
    return r.summarise_unresolved(r.resolve_exact(obs, "subject", known), "subject", "position", spark.createDataFrame([("user 1",), ("user 2",)], "name string"))


@query("c11_suggest_aliases")
def suggest(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return r.suggest_aliases(p.select(F.reverse(F.split("p_name", " ")).alias("w")).select(F.array_join("w", " ").alias("name")), p.select(F.col("p_name").alias("alias")))


@query("c12_align_by_similarity")
def align(spark, sf_dir):
    t = table(spark, sf_dir, "conversations")
    left = t.select(F.col("conv_id").alias("grp"), F.col("turn").alias("pos"), "text")
    right = t.where("(conv_id + turn) % 3 <> 0").select(F.col("conv_id").alias("grp"), F.col("turn").alias("pos"), F.upper("text").alias("text"))
    return r.align_by_similarity(left, right, "grp")


@query("c13_fold_aliases", "SELECT p_type AS alias, 'type ' || p_size % 1 AS canonical, count(*) AS rows FROM part WHERE p_type IN ('ECONOMY', 'PROMO') GROUP BY 1, 2")
def fold(spark, sf_dir):
    aliases_ = spark.createDataFrame([("ECONOMY", "type 0"), ("PROMO", "type 0")], "alias string, canonical string")
    return r.fold_aliases(table(spark, sf_dir, "part"), "p_type", aliases_)[1]


@query("c14_build_lookup_map", """WITH g AS (SELECT p_brand AS grp, min(p_partkey) AS pos, p_name AS name FROM part GROUP BY 1, 3), k AS (SELECT DISTINCT p_name AS key FROM part WHERE p_name LIKE 'small%'),
  f AS (SELECT grp, arg_min(key, pos) AS target FROM g JOIN k ON name = key GROUP BY grp)
  SELECT key AS name, key AS target FROM k UNION ALL SELECT name, min(target) FROM g JOIN f USING (grp) WHERE name NOT IN (SELECT key FROM k) GROUP BY name""")
def lookup(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    g = p.groupBy(F.col("p_brand").alias("grp"), F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("pos"))
    return r.build_lookup_map(p.where("p_name like 'small%'").select(F.col("p_name").alias("key")).distinct(), g)


@query("c15_find_split_records", """WITH rec AS (SELECT p_name AS name, p_size AS position FROM part UNION ALL SELECT split_part(p_name, ' ', 2), p_size FROM part WHERE p_partkey % 10 = 0)
  SELECT a.name AS short, b.name AS long, a.position FROM rec a JOIN rec b ON a.position = b.position AND a.name NOT LIKE '% %' AND b.name LIKE '% %' AND string_split(b.name, ' ')[-1] = a.name""")
def split_records(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    rec = p.select(F.col("p_name").alias("name"), F.col("p_size").alias("position"))
    return r.find_split_records(rec.union(p.where("p_partkey % 10 = 0").select(F.split_part("p_name", F.lit(" "), F.lit(2)), "p_size")))


@query("c16_validate_identities", """WITH rec AS (SELECT CASE WHEN p_partkey % 100 = 1 THEN 'part' || p_partkey ELSE 'part:' || lpad(CAST(p_partkey AS VARCHAR), 5, '0') END AS id, CASE WHEN p_partkey % 90 = 0 THEN '' ELSE p_name END AS name, CASE WHEN p_partkey % 80 = 0 THEN 'a--b' ELSE 'p-' || p_partkey % 1900 END AS slug, p_type AS type, p_brand || p_size AS alias, p_partkey FROM part),
  c AS (SELECT lower(alias) AS alias, count(DISTINCT id) AS ids, count(DISTINCT type) AS types FROM rec GROUP BY 1)
  SELECT 'missing-field' AS check, 'error' AS severity, count(*) AS n FROM rec WHERE name = '' UNION ALL SELECT 'bad-id', 'error', count(*) FROM rec WHERE NOT regexp_matches(id, '^[a-z]+:[0-9]{5,}$')
  UNION ALL SELECT 'bad-slug', 'error', count(*) FROM rec WHERE slug = 'a--b' UNION ALL SELECT 'past-counter', 'error', count(*) FROM rec WHERE id LIKE 'part:%' AND p_partkey >= 1900
  UNION ALL SELECT 'slug-clash', 'error', count(*) FROM (SELECT type, slug FROM rec GROUP BY 1, 2 HAVING count(DISTINCT id) > 1)
  UNION ALL SELECT 'alias-clash', CASE WHEN types = ids OR alias LIKE 'brand#1%' THEN 'warning' ELSE 'error' END, count(*) FROM c WHERE ids > 1 GROUP BY 2""")
def validate(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    rec = p.select(F.when(k % 100 == 1, F.concat(F.lit("part"), k)).otherwise(F.concat(F.lit("part:"), F.lpad(k.cast("string"), 5, "0"))).alias("id"), F.when(k % 90 == 0, "").otherwise(F.col("p_name")).alias("name"), F.when(k % 80 == 0, "a--b").otherwise(F.concat(F.lit("p-"), k % 1900)).alias("slug"), F.col("p_type").alias("type"), F.array(F.concat("p_brand", "p_size")).alias("aliases"))
    allowed = p.where("p_brand like 'Brand#1%'").select(F.lower(F.concat("p_brand", "p_size")).alias("alias")).distinct()
    return r.validate_identities(rec, spark.createDataFrame([("part", 1900)], "prefix string, next long"), allowed)


@query("c9_match_rate", """WITH r AS (SELECT CASE c_custkey % 4 WHEN 0 THEN n_name WHEN 1 THEN 'nowhere ' || n_name WHEN 2 THEN NULL ELSE r_name END AS raw FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey), p AS (SELECT n_name AS name FROM nation UNION SELECT r_name FROM region)
  SELECT count(*) AS total, count(name) AS matched, count(name) / count(*)::DOUBLE AS rate, count(name) / count(*)::DOUBLE >= 0.95 AS passed FROM r LEFT JOIN p ON lower(raw) = lower(name) WHERE raw IS NOT NULL""")
def place_rate(spark, sf_dir):
    c, n, g = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    k = F.col("c_custkey") % 4
    raw = F.when(k == 0, F.col("n_name")).when(k == 1, F.concat(F.lit("nowhere "), "n_name")).when(k == 3, F.col("r_name"))
    rows = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(g, F.col("n_regionkey") == F.col("r_regionkey")).select(raw.alias("raw"))
    places = n.select(F.col("n_name").alias("name"), F.concat(F.lit("nation:"), "n_nationkey").alias("place_id")).union(g.select("r_name", F.concat(F.lit("region:"), "r_regionkey")))
    return r.match_rate(rows, "raw", r.resolve_places(rows, "raw", places))


@query("c12_best_by_similarity")
def best_alike(spark, sf_dir):
    t = table(spark, sf_dir, "conversations")
    left = t.select(F.col("conv_id").alias("grp"), F.col("turn").alias("pos"), "text")
    right = t.where("(conv_id + turn) % 3 <> 0").select(F.col("conv_id").alias("grp"), F.col("turn").alias("pos"), F.upper("text").alias("text"))
    return r.best_by_similarity(left, right, "grp")

"""Edges on the given tables: line items tie parts to suppliers, orders tie customers to orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import edges as e
from factloom.plans.registry import query
from factloom.session import table
from factloom.sources.tables import OBS, observations


def _users(spark, sf_dir):
    obs = observations(spark, sf_dir).where("cast(substr(subject, 6) as int) % 4 <> 0")
    return obs.select(F.lower("subject").alias("alias_key"), F.concat(F.lit("u:"), F.substr("subject", F.lit(6))).alias("entity_id")).distinct()


@query("e1_edges_observed", f"WITH {OBS} SELECT 'u:' || substr(subject, 6) AS from_id, 'ch:' || position AS to_id, kind AS src FROM obs WHERE CAST(substr(subject, 6) AS INTEGER) % 4 <> 0 AND kind <> 'error'")
def observed(spark, sf_dir):
    obs = observations(spark, sf_dir).withColumn("kind", F.when(F.col("kind") == "error", " ").otherwise(F.col("kind")))
    return e.edges_observed(obs, _users(spark, sf_dir))


_REL = """rel AS (SELECT s_name AS a, n_name AS b, CASE s_suppkey % 4 WHEN 0 THEN 'Based In' WHEN 1 THEN 'sells' WHEN 2 THEN 'near' ELSE 'owns' END AS relation,
  CASE s_suppkey % 5 WHEN 0 THEN 'Chapter ' || s_suppkey WHEN 1 THEN '' WHEN 2 THEN 'alleged' ELSE 'Vol ' || s_suppkey END AS cite, s_suppkey, s_nationkey FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""


def _relations(spark, sf_dir):
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    k = F.col("s_suppkey")
    relation = F.when(k % 4 == 0, "Based In").when(k % 4 == 1, "sells").when(k % 4 == 2, "near").otherwise("owns")
    cite = F.when(k % 5 == 0, F.concat(F.lit("Chapter "), k)).when(k % 5 == 1, "").when(k % 5 == 2, "alleged").otherwise(F.concat(F.lit("Vol "), k))
    return s.join(n, s["s_nationkey"] == n["n_nationkey"]).select(F.col("s_name").alias("a"), F.col("n_name").alias("b"), relation.alias("relation"), cite.alias("cite"))


def _vocabulary(spark):
    return spark.createDataFrame([("based in", "located"), ("sells", "trades"), ("near", None)], "word string, relation string")


@query("e2_edges_relation", f"""WITH {_REL} SELECT 's:' || s_suppkey AS from_id, CASE WHEN s_nationkey % 5 <> 0 THEN 'n:' || s_nationkey END AS to_id, CASE relation WHEN 'Based In' THEN 'located' WHEN 'sells' THEN 'trades' END AS relation,
  CASE WHEN cite LIKE 'Chapter%' THEN CAST(s_suppkey AS INTEGER) END AS position, CASE WHEN cite NOT LIKE 'Chapter%' THEN cite END AS note,
  CASE WHEN relation = 'owns' THEN 'unknown-relation' WHEN relation = 'near' THEN 'no-relation' WHEN s_nationkey % 5 = 0 THEN 'unresolved' ELSE 'edge' END AS outcome FROM rel""")
def relation(spark, sf_dir):
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    index = s.select(F.lower("s_name").alias("alias_key"), F.concat(F.lit("s:"), "s_suppkey").alias("entity_id")).union(n.where("n_nationkey % 5 <> 0").select(F.lower("n_name"), F.concat(F.lit("n:"), "n_nationkey")))
    return e.edges_relation(_relations(spark, sf_dir), _vocabulary(spark), index)


@query("e3_edges_relation_facts", f"""WITH {_REL} SELECT a AS subject, CASE relation WHEN 'Based In' THEN 'located' ELSE 'trades' END AS predicate, b AS value,
  CASE WHEN cite LIKE 'Chapter%' THEN 'canon' WHEN cite IN ('', 'alleged') THEN 'speculation' ELSE 'likely' END AS tier FROM rel WHERE relation IN ('Based In', 'sells')""")
def relation_facts(spark, sf_dir):
    return e.edges_relation_facts(_relations(spark, sf_dir), _vocabulary(spark))


@query("e4_edges_member_of", """SELECT 'c:' || c_custkey AS from_id, 'n:' || c_nationkey AS to_id, c_mktsegment <> 'BUILDING' AS current, CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY') THEN lower(c_mktsegment) END AS role FROM customer WHERE c_custkey % 6 <> 0""")
def member_of(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    status = F.when(F.col("c_mktsegment") == "BUILDING", "former").when(F.col("c_mktsegment") == "MACHINERY", "current").otherwise(F.lower("c_mktsegment"))
    m = c.select(F.col("c_name").alias("member"), F.concat(F.lit("n:"), "c_nationkey").alias("group_id"), status.alias("status"))
    return e.edges_member_of(m, c.where("c_custkey % 6 <> 0").select(F.lower("c_name").alias("alias_key"), F.concat(F.lit("c:"), "c_custkey").alias("entity_id")))


@query("e5_edges_current_user", """WITH o AS (SELECT o_orderkey AS item_id, o_custkey AS user_id, day(o_orderdate) AS position FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey % 7 <> 0)
  SELECT user_id AS from_id, item_id AS to_id, true AS current, CAST(position AS INTEGER) AS position, item_id % 3 = 0 AS had_others FROM o""")
def current_user(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    items = o.select(F.col("o_orderkey").alias("item_id"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_custkey")).alias("user_id"), F.dayofmonth("o_orderdate").alias("position"), F.when(F.col("o_orderkey") % 3 == 0, F.array("o_custkey")).alias("previous"), (F.col("o_orderstatus") != "P").alias("found"))
    return e.edges_current_user(items)


@query("e6_edges_owns", """WITH c AS (SELECT l_orderkey AS item_id, l_linenumber AS pos, min(l_suppkey) AS s FROM lineitem GROUP BY 1, 2), r AS (SELECT *, CASE WHEN s % 5 <> 0 THEN 's:' || s END AS id FROM c WHERE s % 11 <> 0),
  w AS (SELECT *, lag(id) OVER (PARTITION BY item_id ORDER BY pos) AS from_owner FROM r) SELECT item_id, id AS from_id, from_owner, pos % 2 = 1 AS current FROM w WHERE id IS NOT NULL""")
def owns(spark, sf_dir):
    l, s = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier")
    c = l.groupBy(F.col("l_orderkey").alias("item_id"), F.col("l_linenumber").alias("pos")).agg(F.min("l_suppkey").alias("s"))
    chains = c.select("item_id", "pos", F.when(F.col("s") % 11 == 0, "Unknown").otherwise(F.concat(F.lit("Owner "), "s")).alias("owner"), (F.col("pos") % 2 == 1).alias("current"))
    index = s.where("s_suppkey % 5 <> 0").select(F.concat(F.lit("owner "), "s_suppkey").alias("alias_key"), F.concat(F.lit("s:"), "s_suppkey").alias("entity_id"))
    return e.edges_owns(chains, index)


@query("e7_edges_credits", """WITH c AS (SELECT DISTINCT lower(p_name) AS k, p_brand AS subject, p_type AS lang FROM part), n AS (SELECT k, row_number() OVER (ORDER BY k) AS n FROM (SELECT DISTINCT k FROM c WHERE k NOT LIKE 'small%'))
  SELECT CASE WHEN k LIKE 'small%' THEN 'va:' || k ELSE 'va:' || lpad(CAST(n.n + 699 AS VARCHAR), 5, '0') END AS credit_id, subject, lang FROM c LEFT JOIN n USING (k)""")
def credits(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    rows = p.select(F.upper("p_name").alias("credit"), F.col("p_brand").alias("subject"), F.col("p_type").alias("lang"))
    known = p.where("p_name like 'small%'").select(F.lower("p_name").alias("credit_key"), F.concat(F.lit("va:"), F.lower("p_name")).alias("credit_id")).distinct()
    return e.edges_credits(rows, known, 700)


@query("e7_new_credits", """WITH c AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE ' ' || p_name END AS credit, p_partkey AS ordinal FROM part), f AS (SELECT lower(trim(credit)) AS k, min(ordinal) AS o, arg_min(trim(credit), ordinal) AS name FROM c GROUP BY 1)
  SELECT k AS credit_key, 'va:' || lpad(CAST(row_number() OVER (ORDER BY o) + 41 AS VARCHAR), 5, '0') AS credit_id, name FROM f WHERE k NOT LIKE 'red%'""")
def new_credits(spark, sf_dir):
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    known = p.where("lower(p_name) like 'red%'").select(F.lower("p_name").alias("credit_key")).distinct()
    return e.new_credits(p.select(F.when(k % 2 == 0, F.upper("p_name")).otherwise(F.concat(F.lit(" "), "p_name")).alias("credit"), k.alias("ordinal")), known, 42)


@query("e8_edges_born_in", """SELECT c_custkey AS from_id, CASE WHEN c_custkey % 3 = 2 THEN NULL ELSE 'n:' || n_nationkey END AS to_id, CASE c_custkey % 3 WHEN 0 THEN n_name WHEN 1 THEN 'Sea (' || n_name || ')' ELSE 'elsewhere' END AS raw,
  CASE c_custkey % 3 WHEN 0 THEN 'exact' WHEN 1 THEN 'sub-location' END AS how FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def born_in(spark, sf_dir):
    from factloom.operators.resolution import resolve_places

    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    k = F.col("c_custkey") % 3
    rows = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("from_id"), F.when(k == 0, F.col("n_name")).when(k == 1, F.concat(F.lit("Sea ("), "n_name", F.lit(")"))).otherwise("elsewhere").alias("raw"))
    found = resolve_places(rows, "raw", n.select(F.col("n_name").alias("name"), F.concat(F.lit("n:"), "n_nationkey").alias("place_id")))
    return rows.join(found, "raw", "left").select("from_id", F.col("place_id").alias("to_id"), "raw", "how")


@query("e9_edges_set_in", """WITH a AS (SELECT DISTINCT p_name AS arc, replace(p_name, ' ', '-') AS slug FROM part), pl AS (SELECT DISTINCT replace(p_name, ' ', '-') AS slug FROM part WHERE p_name NOT LIKE 'red%' AND p_name NOT LIKE 'small%')
  SELECT arc, CASE WHEN pl.slug IS NOT NULL THEN 'p:' || pl.slug WHEN arc LIKE 'red%' AND o.slug IS NOT NULL THEN 'p:' || o.slug END AS place_id, CASE WHEN pl.slug IS NOT NULL THEN 'slug' WHEN arc LIKE 'red%' AND o.slug IS NOT NULL THEN 'override' ELSE 'none' END AS how
  FROM a LEFT JOIN pl ON a.slug = pl.slug LEFT JOIN pl o ON o.slug = replace(a.slug, 'red-', 'blue-')""")
def set_in(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_name").alias("arc"), F.translate("p_name", " ", "-").alias("slug")).distinct()
    places = p.where("arc not like 'red%' and arc not like 'small%'").select("slug", F.concat(F.lit("p:"), "slug").alias("place_id"))
    return e.edges_set_in(p, places, p.where("arc like 'red%'").select(F.col("slug").alias("arc_slug"), F.replace("slug", F.lit("red-"), F.lit("blue-")).alias("place_slug")))


@query("e10_edges_fan_out", """WITH s AS (SELECT s_nationkey AS grp, s_suppkey AS asset FROM supplier WHERE s_suppkey % 3 <> 0), n AS (SELECT grp, count(*) AS n FROM s GROUP BY 1)
  SELECT c_custkey AS from_id, asset AS to_id, CASE WHEN n = 1 THEN c_acctbal > 0 END AS current, CASE WHEN n > 1 THEN 'one of ' || n END AS note FROM customer JOIN s ON c_nationkey = s.grp JOIN n ON n.grp = s.grp""")
def fan_out(spark, sf_dir):
    assets = table(spark, sf_dir, "supplier").where("s_suppkey % 3 <> 0").select(F.col("s_nationkey").alias("grp"), F.col("s_suppkey").alias("asset"))
    return e.edges_fan_out(assets, table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("grp"), F.col("c_custkey").alias("member"), (F.col("c_acctbal") > 0).alias("current")))


@query("e11_edges_cites", """WITH p AS (SELECT o_orderkey AS post_id, unnest([CAST(o_custkey % 2000 AS INTEGER), 12, CAST(o_orderkey % 30 AS INTEGER)]) AS n, o_orderstatus AS status FROM orders)
  SELECT DISTINCT post_id, 'ch:' || n AS to_id, CASE status WHEN 'F' THEN 'supports' WHEN 'O' THEN 'open' END AS stance FROM p""")
def cites(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    positions = F.concat((F.col("o_custkey") % 2000).cast("string"), F.lit(", 0012; x12 12345 "), (F.col("o_orderkey") % 30).cast("string"))
    stance = spark.createDataFrame([("F", "supports"), ("O", "open")], "status string, stance string")
    return e.edges_cites(o.select(F.col("o_orderkey").alias("post_id"), positions.alias("positions"), F.col("o_orderstatus").alias("status")), stance)


@query("e12_lookup", "SELECT c_nationkey AS from_id, array_to_string(list(c_custkey ORDER BY c_custkey), ',') AS others, count(*) AS n FROM customer GROUP BY 1")
def lookup(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("from_id"), F.col("c_custkey").alias("to_id"))
    return e.lookup(c, "from_id", "to_id", per=None).withColumn("others", F.array_join(F.col("others").cast("array<string>"), ","))


@query("e12_lookup_slices", "SELECT c_nationkey AS from_id, array_to_string(list(c_custkey ORDER BY c_custkey), ',') AS others, count(*) AS n FROM customer GROUP BY 1")
def sliced_lookup(spark, sf_dir):
    """Slices put together again: they hold each end's others once."""
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("from_id"), F.col("c_custkey").alias("to_id"))
    per = e.lookup(c, "from_id", "to_id", per=20).groupBy("from_id").agg(F.array_sort(F.flatten(F.collect_list("others"))).alias("others"), F.sum("n").alias("n"))
    return per.select("from_id", F.array_join(F.col("others").cast("array<string>"), ",").alias("others"), "n")


@query("e13_both_directions", "SELECT s_suppkey AS id, CAST(s_nationkey AS BIGINT) AS other, 'located' AS relation FROM supplier UNION ALL SELECT s_nationkey, s_suppkey, 'located' FROM supplier")
def both(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    return e.both_directions(s.select(F.col("s_suppkey").alias("from_id"), F.col("s_nationkey").cast("long").alias("to_id"), F.lit("located").alias("relation")))


@query("e14_entity_dossier", """WITH o AS (SELECT o_custkey AS k, count(*) AS n, array_to_string(list_sort(list(CAST(o_orderkey AS VARCHAR))), ',') AS items FROM orders GROUP BY 1), d AS (SELECT o_custkey AS k, count(*) AS n, array_to_string(list_sort(list(o_orderpriority)), ',') AS items FROM orders WHERE o_orderstatus = 'P' GROUP BY 1)
  SELECT c_custkey AS entity_id, c_name AS name, coalesce(o.n, 0) AS n_orders, coalesce(d.n, 0) AS n_pending, coalesce(o.items, '') AS orders, coalesce(d.items, '') AS pending FROM customer LEFT JOIN o ON o.k = c_custkey LEFT JOIN d ON d.k = c_custkey""")
def dossier(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    shard = lambda df, item: df.select(F.col("o_custkey").alias("entity_id"), F.col(item).alias("item"))
    return e.entity_dossier({"orders": shard(o, "o_orderkey"), "pending": shard(o.where("o_orderstatus = 'P'"), "o_orderpriority")}, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity_id"), F.col("c_name").alias("name")), rows_only=False)


@query("e14_dossier_rows", """SELECT c_custkey AS entity_id, c_name AS name, 'orders' AS shard, CAST(o_orderkey AS VARCHAR) AS item FROM customer JOIN orders ON o_custkey = c_custkey
  UNION ALL SELECT c_custkey, c_name, 'pending', o_orderpriority FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'P'""")
def dossier_rows(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    shard = lambda df, item: df.select(F.col("o_custkey").alias("entity_id"), F.col(item).alias("item"))
    return e.entity_dossier({"orders": shard(o, "o_orderkey"), "pending": shard(o.where("o_orderstatus = 'P'"), "o_orderpriority")}, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity_id"), F.col("c_name").alias("name")), rows_only=True)


@query("e14_dossier_names", """WITH ed AS (SELECT o_custkey AS a, o_custkey % 90 + 1 AS b FROM orders WHERE o_orderkey % 3 = 0), n AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 5 <> 0 THEN c_name END AS name FROM customer),
  t AS (SELECT a AS k, 'kin' AS shard, CAST(b AS VARCHAR) AS other FROM ed UNION ALL SELECT b, 'kin', CAST(a AS VARCHAR) FROM ed UNION ALL SELECT o_custkey, 'status', NULL FROM orders WHERE o_orderkey % 7 = 0),
  s AS (SELECT o_custkey AS k, o_orderstatus AS item, o_orderkey FROM orders WHERE o_orderkey % 7 = 0), d AS (SELECT o_custkey AS k, day(o_orderdate) AS p, o_orderpriority AS kind, row_number() OVER (PARTITION BY o_custkey ORDER BY day(o_orderdate), o_orderkey) AS i FROM orders WHERE o_orderkey % 2 = 0)
  SELECT n.k AS entity_id, n.name, CAST(d.p AS INTEGER) AS debut, d.kind AS debut_kind, x.shard, x.item FROM n JOIN (SELECT t.k, t.shard, coalesce(m.name, t.other) AS item FROM t LEFT JOIN n m ON CAST(m.k AS VARCHAR) = t.other WHERE t.other IS NOT NULL UNION ALL SELECT k, 'status', item FROM s) x ON x.k = n.k LEFT JOIN d ON d.k = n.k AND d.i = 1""")
def dossier_names(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), F.col("o_custkey")
    kin = e.both_directions(o.where("o_orderkey % 3 = 0").select(k.alias("from_id"), (k % 90 + 1).alias("to_id"), F.lit("kin").alias("relation"))).select(F.col("id").alias("entity_id"), F.col("other").alias("other_id"))
    status = o.where("o_orderkey % 7 = 0").select(k.alias("entity_id"), F.col("o_orderstatus").alias("item"))
    debuts = o.where("o_orderkey % 2 = 0").select(k.alias("entity_id"), F.dayofmonth("o_orderdate").alias("position"), F.col("o_orderpriority").alias("kind"), F.col("o_orderkey").alias("ordinal"))
    c = F.col("c_custkey")
    return e.entity_dossier({"kin": kin, "status": status}, table(spark, sf_dir, "customer").select(c.alias("entity_id"), F.when(c % 5 != 0, F.col("c_name")).alias("name")), debuts=debuts)


@query("e15_group_dossier", "SELECT c_nationkey AS group_id, array_to_string(list_sort(list(DISTINCT CASE WHEN c_custkey % 9 = 0 THEN CAST(c_custkey AS VARCHAR) ELSE c_name END)), '|') AS members, count(*) FILTER (c_acctbal > 0) AS current, count(*) FILTER (c_acctbal <= 0) AS former FROM customer GROUP BY 1")
def groups(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    m = c.select(F.col("c_nationkey").alias("group_id"), F.col("c_custkey").alias("member_id"), (F.col("c_acctbal") > 0).alias("current"))
    return e.group_dossier(m, c.where("c_custkey % 9 <> 0").select(F.col("c_custkey").alias("member_id"), F.col("c_name").alias("name")))


@query("e16_place_dossier", """WITH a AS (SELECT s_nationkey AS place_id, count(*) AS arcs, min(s_suppkey) AS first FROM supplier WHERE s_nationkey > 4 GROUP BY 1), b AS (SELECT c_nationkey AS place_id, count(DISTINCT c_custkey) AS born FROM customer WHERE c_nationkey < 20 GROUP BY 1)
  SELECT place_id, n_name AS name, coalesce(arcs, 0) AS arcs, first, coalesce(born, 0) AS born FROM a FULL JOIN b USING (place_id) LEFT JOIN nation ON n_nationkey = place_id""")
def places(spark, sf_dir):
    s, c, n = (table(spark, sf_dir, t) for t in ("supplier", "customer", "nation"))
    return e.place_dossier(s.where("s_nationkey > 4").select(F.col("s_nationkey").alias("place_id"), F.col("s_suppkey").alias("position")), c.where("c_nationkey < 20").select(F.col("c_nationkey").alias("place_id"), F.col("c_custkey").alias("subject")), n.select(F.col("n_nationkey").alias("place_id"), F.col("n_name").alias("name")))


@query("e17_current_holder", """WITH w AS (SELECT o_custkey AS item_id, o_orderkey AS holder, CASE o_orderstatus WHEN 'F' THEN false WHEN 'O' THEN true END AS c, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END, o_orderkey) AS rn FROM orders)
  SELECT item_id, holder, coalesce(c, true) AS current FROM w WHERE rn = 1""")
def holder(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    current = F.when(F.col("o_orderstatus") == "F", False).when(F.col("o_orderstatus") == "O", True)
    return e.current_holder(o.select(F.col("o_custkey").alias("item_id"), F.col("o_orderkey").alias("holder"), current.alias("current"), F.col("o_orderkey").alias("ordinal")))


@query("e18_enrich_members", """WITH cur AS (SELECT c_custkey AS member, c_custkey % 4 AS priority FROM customer WHERE c_custkey % 5 = 0)
  SELECT c_nationkey AS group_id, c_custkey AS member, CASE WHEN c_custkey % 3 <> 0 THEN c_nationkey END AS debut, CASE WHEN c_custkey % 5 = 0 THEN CAST(c_custkey % 4 AS INTEGER) WHEN c_acctbal > 0 THEN 10 ELSE 60 END AS tier,
  CASE WHEN c_custkey % 20 = 0 THEN 0 WHEN c_custkey % 3 <> 0 AND c_mktsegment = 'BUILDING' THEN 1 ELSE 9 END AS rank FROM customer""")
def members(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    m = c.select(F.col("c_nationkey").alias("group_id"), F.col("c_custkey").alias("member"), (F.col("c_acctbal") > 0).alias("_active"))
    rec = c.where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("member"), F.col("c_nationkey").alias("debut"), F.col("c_mktsegment").alias("role"))
    cur = c.where("c_custkey % 5 = 0").select(F.col("c_custkey").alias("member"), F.explode(F.array(F.struct((F.col("c_custkey") % 4).cast("int").alias("priority"), F.lit(0).alias("ordinal")), F.struct(F.lit(7).alias("priority"), F.lit(1).alias("ordinal")))).alias("x")).select("member", "x.priority", "x.ordinal")
    return e.enrich_members(m, rec, cur, F.when(F.col("role") == "BUILDING", 1).otherwise(9), F.when(F.col("_active"), 10).otherwise(60))


@query("e19_enrich_edges", "SELECT o_custkey AS from_id, o_orderkey AS to_id, c_name AS name, c_nationkey AS debut FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 8 <> 0) ON c_custkey = o_custkey")
def enrich(spark, sf_dir):
    names = table(spark, sf_dir, "customer").where("c_custkey % 8 <> 0").select(F.col("c_custkey").alias("entity_id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("debut"))
    return e.enrich_edges(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("from_id"), F.col("o_orderkey").alias("to_id")), names, "from_id")


@query("e20_link_positions", """WITH ed AS (SELECT o_orderkey AS edge_id, o_custkey AS entity_id, CAST(day(o_orderdate) AS INTEGER) AS position, o_orderstatus AS kind FROM orders), f AS (SELECT event_id AS fact_id, user_id AS entity_id, CAST(day(ts) AS INTEGER) AS p, CASE WHEN event_type = 'click' THEN 'F' WHEN event_type = 'view' THEN 'O' ELSE 'P' END AS k FROM events),
  j AS (SELECT edge_id, fact_id, kind, CASE WHEN fact_id IS NULL THEN 3 WHEN p = position AND k = kind THEN 0 WHEN p = position THEN 1 ELSE 2 END AS g FROM ed LEFT JOIN f USING (entity_id)), r AS (SELECT *, row_number() OVER (PARTITION BY edge_id ORDER BY g, fact_id) AS rn FROM j)
  SELECT edge_id, CASE g WHEN 0 THEN 'canon' WHEN 1 THEN 'likely' ELSE CASE WHEN kind = 'F' THEN 'likely' ELSE 'speculation' END END AS tier, CASE g WHEN 0 THEN 'exact' WHEN 1 THEN 'type-mismatch' WHEN 2 THEN 'chapter-mismatch' ELSE 'none' END AS match, fact_id FROM r WHERE rn = 1""")
def link_positions(spark, sf_dir):
    ed = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("edge_id"), F.col("o_custkey").alias("entity_id"), F.dayofmonth("o_orderdate").alias("position"), F.col("o_orderstatus").alias("kind"))
    ev = table(spark, sf_dir, "events")
    f = ev.select(F.col("event_id").alias("fact_id"), F.col("user_id").alias("entity_id"), F.dayofmonth("ts").alias("position"), F.when(F.col("event_type") == "click", "F").when(F.col("event_type") == "view", "O").otherwise("P").alias("kind"), F.col("event_id").alias("ordinal"))
    return e.link_positions(ed, f, F.when(F.col("kind") == "F", "likely").otherwise("speculation"))


#: Values of one or two names, with and without brackets and spaces, some empty or null; facts of two relations.
_LINKS = """ed AS (SELECT p_partkey AS edge_id, CASE WHEN p_partkey % 50 <> 0 THEN p_size END AS entity_id, CASE WHEN p_partkey % 2 = 0 THEN 'near' ELSE 'far' END AS relation, p_brand AS target, p_partkey % 3 = 0 AS ok FROM part),
  f AS (SELECT s_suppkey AS fact_id, CAST(CASE WHEN s_suppkey % 11 <> 0 THEN s_suppkey % 60 END AS INTEGER) AS entity_id, CASE WHEN s_suppkey % 3 = 0 THEN 'far' ELSE 'near' END AS relation,
    CASE s_suppkey % 5 WHEN 0 THEN 'brand#' || (s_suppkey % 25 + 1) || ' · Brand#' || (s_suppkey % 7 + 11) WHEN 1 THEN '(Brand#' || (s_suppkey % 7 + 11) || ')' WHEN 2 THEN ' Brand#' || (s_suppkey % 25 + 1) || '  ·  ( BRAND#' || (s_suppkey % 9 + 21) || ' )' WHEN 3 THEN CASE WHEN s_suppkey % 2 = 0 THEN '' END ELSE 'Brand#' || (s_suppkey % 25 + 11) END AS value, CASE WHEN s_acctbal > 0 THEN 'canon' ELSE 'likely' END AS tier, 1000000 - s_suppkey AS ordinal FROM supplier),
  c AS (SELECT fact_id, trim(unnest(string_split_regex(value, '\\s+·\\s+'))) AS v FROM f), p AS (SELECT fact_id, lower(CASE WHEN v LIKE '(%)' THEN trim(v[2:-2]) ELSE v END) AS v FROM c WHERE v <> ''),
  j AS (SELECT edge_id, ok, f.fact_id, f.tier, f.ordinal, {hit} AS hit FROM ed LEFT JOIN {facts} f ON f.entity_id = ed.entity_id {more}),
  links AS (SELECT edge_id, CASE WHEN bool_or(hit) THEN arg_min(tier, ordinal) FILTER (hit) WHEN any_value(ok) THEN 'likely' ELSE 'speculation' END AS tier, CASE WHEN bool_or(hit) THEN 'match' WHEN count(fact_id) = 0 THEN 'no-fact' ELSE '{miss}' END AS outcome, arg_min(fact_id, ordinal) FILTER (hit) AS evidence FROM j GROUP BY edge_id)"""
_HIT = "coalesce((SELECT bool_or(p.v = lower(ed.target)) FROM p WHERE p.fact_id = f.fact_id), false)"


def _linked(spark, sf_dir):
    k = F.col("p_partkey")
    ed = table(spark, sf_dir, "part").select(k.alias("edge_id"), F.when(k % 50 != 0, F.col("p_size")).alias("entity_id"), F.when(k % 2 == 0, "near").otherwise("far").alias("relation"), F.col("p_brand").alias("target"), (k % 3 == 0).alias("ok"))
    k = F.col("s_suppkey")
    brand = lambda n, by, text="Brand#": F.concat(F.lit(text), k % n + by)
    value = F.when(k % 5 == 0, F.concat(brand(25, 1, "brand#"), F.lit(" · "), brand(7, 11))).when(k % 5 == 1, F.concat(F.lit("("), brand(7, 11), F.lit(")"))).when(k % 5 == 2, F.concat(F.lit(" "), brand(25, 1), F.lit("  ·  ( "), brand(9, 21, "BRAND#"), F.lit(" )")))
    value = value.when((k % 5 == 3) & (k % 2 == 0), "").when(k % 5 == 4, brand(25, 11))
    f = table(spark, sf_dir, "supplier").select(k.alias("fact_id"), F.when(k % 11 != 0, k % 60).cast("int").alias("entity_id"), F.when(k % 3 == 0, "far").otherwise("near").alias("relation"), value.alias("value"), F.when(F.col("s_acctbal") > 0, "canon").otherwise("likely").alias("tier"), (1000000 - k).alias("ordinal"))
    return ed, f, F.when(F.col("ok"), "likely").otherwise("speculation")


def _links(spark, sf_dir):
    ed, f, default = _linked(spark, sf_dir)
    return e.link_values(ed.drop("relation"), f, True, default), f


@query("e21_link_values", f"WITH {_LINKS.format(hit=_HIT, facts='f', more='', miss='partial')} SELECT * FROM links")
def link_values(spark, sf_dir):
    return _links(spark, sf_dir)[0]


@query("e21_link_relations", f"WITH {_LINKS.format(hit=_HIT, facts='f', more='AND f.relation = ed.relation', miss='conflict')} SELECT * FROM links")
def link_relations(spark, sf_dir):
    ed, f, default = _linked(spark, sf_dir)
    return e.link_values(ed, f, False, default)


@query("e21_link_first", f"WITH {_LINKS.format(hit=_HIT, facts='(SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY ordinal) = 1)', more='', miss='conflict')} SELECT * FROM links")
def link_first(spark, sf_dir):
    ed, f, default = _linked(spark, sf_dir)
    return e.link_values(ed, f.drop("relation"), False, default, first_only=True)


@query("e22_facts_without_edge", f"WITH {_LINKS.format(hit=_HIT, facts='f', more='', miss='partial')} SELECT fact_id, value FROM f WHERE fact_id NOT IN (SELECT evidence FROM links WHERE evidence IS NOT NULL)")
def without_edge(spark, sf_dir):
    links, f = _links(spark, sf_dir)
    return e.facts_without_edge(f, links).select("fact_id", "value")


@query("e23_check_edges", """WITH ed AS (SELECT 'family' AS shard, CASE WHEN l_linenumber = 7 THEN NULL ELSE 'p:' || l_partkey % 50 END AS from_id, CASE WHEN l_linenumber = 6 THEN 'ch:' || l_suppkey ELSE 'p:' || l_suppkey % 60 END AS to_id, l_returnflag AS src, l_orderkey * 10 + l_linenumber AS ordinal FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY 1, 2)),
  ids AS (SELECT 'p:' || p_partkey AS id FROM part WHERE p_partkey < 55), pr AS (SELECT ordinal, row_number() OVER (PARTITION BY least(from_id, to_id), greatest(from_id, to_id) ORDER BY ordinal) AS rn FROM ed WHERE from_id IS NOT NULL)
  SELECT ordinal, CASE WHEN from_id IS NULL THEN 'missing-field' ELSE 'unknown-id' END AS problem FROM ed WHERE from_id IS NULL OR NOT (from_id IN (SELECT id FROM ids) AND (to_id IN (SELECT id FROM ids) OR to_id LIKE 'ch:%')) UNION ALL SELECT ordinal, 'repeated-pair' FROM pr WHERE rn > 1""")
def check(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"), F.min("l_returnflag").alias("src"))
    n = F.col("l_linenumber")
    ed = l.select(F.lit("family").alias("shard"), F.when(n != 7, F.concat(F.lit("p:"), F.col("p") % 50)).alias("from_id"), F.when(n == 6, F.concat(F.lit("ch:"), "s")).otherwise(F.concat(F.lit("p:"), F.col("s") % 60)).alias("to_id"), "src", (F.col("l_orderkey") * 10 + n).alias("ordinal"))
    return e.check_edges(ed, table(spark, sf_dir, "part").where("p_partkey < 55").select(F.concat(F.lit("p:"), "p_partkey").alias("id")), ("family",))


@query("e24_diff_tables", """WITH a AS (SELECT o_orderkey AS k, o_orderstatus AS status, o_orderpriority AS prio, CAST(o_custkey AS VARCHAR) AS cust FROM orders WHERE o_orderkey % 10 <> 1),
  b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 6 = 0 THEN 'X' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderpriority END AS prio, CASE o_orderkey % 5 WHEN 0 THEN o_custkey || '.0' WHEN 3 THEN o_custkey || '.5' ELSE CAST(o_custkey AS VARCHAR) END AS cust FROM orders WHERE o_orderkey % 10 <> 2),
  j AS (SELECT coalesce(a.k, b.k) AS k, a.k AS ak, b.k AS bk, a.status AS s1, b.status AS s2, a.prio AS p1, b.prio AS p2, a.cust AS c1, b.cust AS c2 FROM a FULL JOIN b ON a.k = b.k), mt AS (SELECT * FROM j WHERE ak IS NOT NULL AND bk IS NOT NULL)
  SELECT k, CASE WHEN bk IS NULL THEN 'lost' ELSE 'added' END AS change, CAST(NULL AS VARCHAR) AS field, CAST(NULL AS VARCHAR) AS old, CAST(NULL AS VARCHAR) AS new FROM j WHERE ak IS NULL OR bk IS NULL
  UNION ALL SELECT k, 'drift', 'status', s1, s2 FROM mt WHERE s1 IS DISTINCT FROM s2 UNION ALL SELECT k, 'drift', 'prio', p1, p2 FROM mt WHERE p1 IS DISTINCT FROM p2 UNION ALL SELECT k, 'drift', 'cust', c1, c2 FROM mt WHERE CAST(c1 AS DOUBLE) <> CAST(c2 AS DOUBLE)""")
def diff(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("prio"), F.col("o_custkey").cast("string").alias("cust"), F.lit(0).alias("n"))
    a = o.where("k % 10 <> 1")
    a = a.unionByName(a.where("k % 7 = 0").withColumn("status", F.lit("A")).withColumn("n", F.lit(1)))  # later rows of a key don't count
    k = F.col("k")
    b = o.where("k % 10 <> 2").select("k", F.when(k % 6 == 0, "X").otherwise(F.col("status")).alias("status"), F.when(k % 4 != 0, F.col("prio")).alias("prio"), F.concat("cust", F.when(k % 5 == 0, ".0").when(k % 5 == 3, ".5").otherwise("")).alias("cust"), "n")
    return e.diff_tables(a, b, "k", ["status", "prio", "cust"], "n")


@query("e24_diff_nested", """WITH a AS (SELECT o_orderkey AS k, '{"id":' || o_custkey || ',"to":{"x":[1,2.50,"1.0"],"y":' || o_custkey % 9 || '},"n":100}' AS doc FROM orders),
  b AS (SELECT o_orderkey AS k, '{ "n":' || CASE o_orderkey % 3 WHEN 0 THEN '1e2' WHEN 1 THEN '100.0' ELSE '100' END || ', "to":{"y":' || o_custkey % 9 || '.0, "x":[' || CASE o_orderkey % 4 WHEN 0 THEN '2.5,1' WHEN 1 THEN '1.0,25e-1' ELSE '1,2.5' END || ',"1.' || CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE '0' END || '"]}, "id":' || o_custkey || CASE WHEN o_orderkey % 7 = 0 THEN '.5' WHEN o_orderkey % 7 = 1 THEN '.00' ELSE '' END || '}' AS doc FROM orders),
  v AS (SELECT k, a.doc AS old, b.doc AS new, a.doc::JSON AS x, b.doc::JSON AS y FROM a JOIN b USING (k))
  SELECT k, 'drift' AS change, 'doc' AS field, old, new FROM v WHERE NOT (CAST(x->'id' AS DOUBLE) = CAST(y->'id' AS DOUBLE) AND CAST(x->'n' AS DOUBLE) = CAST(y->'n' AS DOUBLE) AND CAST(x->'to'->'y' AS DOUBLE) = CAST(y->'to'->'y' AS DOUBLE)
    AND CAST(x->'to'->'x'->0 AS DOUBLE) = CAST(y->'to'->'x'->0 AS DOUBLE) AND CAST(x->'to'->'x'->1 AS DOUBLE) = CAST(y->'to'->'x'->1 AS DOUBLE) AND (x->'to'->'x'->>2) = (y->'to'->'x'->>2))""")
def diff_nested(spark, sf_dir):
    k, text = F.col("o_orderkey"), lambda *x: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in x])
    o = table(spark, sf_dir, "orders")
    a = o.select(k.alias("k"), text('{"id":', F.col("o_custkey"), ',"to":{"x":[1,2.50,"1.0"],"y":', F.col("o_custkey") % 9, '},"n":100}').alias("doc"))
    n, x = F.when(k % 3 == 0, "1e2").when(k % 3 == 1, "100.0").otherwise("100"), F.when(k % 4 == 0, "2.5,1").when(k % 4 == 1, "1.0,25e-1").otherwise("1,2.5")
    end = F.when(k % 7 == 0, ".5").when(k % 7 == 1, ".00").otherwise("")
    b = o.select(k.alias("k"), text('{ "n":', n, ', "to":{"y":', F.col("o_custkey") % 9, '.0, "x":[', x, ',"1.', F.when(k % 5 == 0, "").otherwise("0"), '"]}, "id":', F.col("o_custkey"), end, "}").alias("doc"))
    return e.diff_tables(a, b, "k", ["doc"])


@query("e15_item_dossier", """WITH w AS (SELECT l_partkey AS item, l_suppkey AS owner, l_returnflag = 'N' AS cur, l_orderkey * 10 + l_linenumber AS o FROM lineitem), h AS (SELECT item, arg_min(owner, o) AS holder FROM w WHERE cur GROUP BY 1)
  SELECT w.item AS item_id, owner AS owner_id, coalesce(s_name, CAST(owner AS VARCHAR)) AS owner, cur AS current, holder FROM w LEFT JOIN supplier ON s_suppkey = owner AND s_suppkey % 4 <> 0 LEFT JOIN h ON h.item = w.item""")
def items(spark, sf_dir):
    l, s = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier")
    owners = l.select(F.col("l_partkey").alias("item_id"), F.col("l_suppkey").alias("owner_id"), (F.col("l_returnflag") == "N").alias("current"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal"))
    return e.item_dossier(owners, s.where("s_suppkey % 4 <> 0").select(F.col("s_suppkey").alias("owner_id"), F.col("s_name").alias("name")))


@query("e25_ingest_entries", """WITH x AS (SELECT o_orderkey AS ordinal, CASE o_orderstatus WHEN 'F' THEN 'book' WHEN 'O' THEN 'film' ELSE 'rumour-mill' END AS t, CASE o_orderkey % 4 WHEN 0 THEN 'canon' WHEN 1 THEN 'rumour' END AS tier, o_orderkey % 5 AS r, o_custkey FROM orders)
  SELECT CASE t WHEN 'book' THEN 'b:' || ordinal WHEN 'film' THEN 'f:' || ordinal ELSE CAST(ordinal AS VARCHAR) END AS id, 'c' || o_custkey AS subject, 'orders' AS predicate, CAST(ordinal AS VARCHAR) AS value, coalesce(tier, CASE t WHEN 'book' THEN 'canon' WHEN 'film' THEN 'likely' END) AS tier,
  CASE WHEN t = 'rumour-mill' THEN 'unknown-source' WHEN r = 0 THEN 'missing-field' WHEN t = 'film' AND tier = 'canon' THEN 'tier-too-strong' END AS error FROM x""")
def ingest(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k, s = F.col("o_orderkey"), F.col("o_orderstatus")
    rows = o.select(F.when(s == "F", "book").when(s == "O", "film").otherwise("rumour-mill").alias("source_type"), F.concat(F.lit("c"), "o_custkey").alias("subject"), F.lit("orders").alias("predicate"), k.cast("string").alias("value"), F.when(k % 4 == 0, "canon").when(k % 4 == 1, "rumour").alias("tier"), F.create_map(F.lit("title"), F.when(k % 5 == 0, " ").otherwise("t")).alias("ref"), k.alias("ordinal"))
    registry = spark.createDataFrame([("book", "canon", ["title"], "b"), ("film", "likely", ["title"], "f")], "source_type string, default_tier string, required array<string>, id_prefix string")
    return e.ingest_entries(rows, registry)


@query("e26_asof_position", """WITH m AS (SELECT o_orderkey AS key, CAST(greatest(o_custkey, 500) AS BIGINT) AS p FROM orders WHERE o_orderkey % 37 = 5), ev AS (SELECT event_id AS key FROM events)
  SELECT ev.key, coalesce((SELECT arg_min(p, m.key) FROM m WHERE m.key >= ev.key), (SELECT arg_max(p, m.key) FROM m WHERE m.key < ev.key)) AS position, CASE WHEN ev.key IN (SELECT key FROM m) THEN 'exact' ELSE 'filler' END AS how FROM ev""")
def asof(spark, sf_dir):
    m = table(spark, sf_dir, "orders").where("o_orderkey % 37 = 5").select(F.col("o_orderkey").alias("key"), F.array(F.col("o_custkey"), F.lit(500).cast("long")).alias("positions"))
    return e.asof_position(table(spark, sf_dir, "events").select(F.col("event_id").alias("key")), m)


@query("e27_range_position", f"""WITH {OBS}, r AS (SELECT n_name AS name, CAST(n_nationkey * 2 + 1 AS INTEGER) AS s, CASE WHEN n_nationkey = 10 THEN 9999 ELSE CAST(n_nationkey * 2 + 2 AS INTEGER) END AS e FROM nation WHERE n_nationkey <= 10)
  SELECT ordinal, position, name FROM obs LEFT JOIN r ON position BETWEEN s AND CASE WHEN e >= 9999 THEN 29 ELSE least(e, 29) END""")
def ranges(spark, sf_dir):
    n = table(spark, sf_dir, "nation").where("n_nationkey <= 10")
    r = n.select(F.col("n_name").alias("name"), (F.col("n_nationkey") * 2 + 1).cast("int").alias("start"), F.when(F.col("n_nationkey") == 10, 9999).otherwise(F.col("n_nationkey") * 2 + 2).cast("int").alias("end"))
    return e.range_position(observations(spark, sf_dir).select("ordinal", "position"), r, 29)

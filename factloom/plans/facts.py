"""Observations to facts on the given tables: events stand for observations."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import facts
from factloom.plans.registry import query
from factloom.session import table
from factloom.sources.tables import OBS, observations

KINDS = ("click", "purchase", "error")
_FACTS = f"""WITH {OBS}, per AS (
  SELECT subject, min(position) AS first, arg_min(kind, CAST(position AS BIGINT) * 1000000000 + ordinal) AS first_kind, list_sort(list(DISTINCT position)) AS all_p,
         {", ".join(f"list_sort(list(DISTINCT position) FILTER (kind = '{k}')) AS p_{k}" for k in KINDS)}
  FROM obs GROUP BY subject
)"""


def _fact_sql(name: str, value: str, kind: str, positions: str) -> str:
    return f"SELECT subject, '{name}' AS predicate, CAST({value} AS BIGINT) AS value, {kind} AS kind, array_to_string({positions}, ',') AS positions FROM per"


FACTS_SQL = f"""{_FACTS}, facts AS (
{_fact_sql("first_position", "first", "first_kind", "[first]")} UNION ALL {_fact_sql("appearances", "len(all_p)", "NULL", "all_p")}
{" ".join(f"UNION ALL {_fact_sql(f'{k}_appearances', f'len(p_{k})', 'NULL', f'p_{k}')} WHERE len(p_{k}) > 0" for k in KINDS)})"""


@query("d1_derive_facts", f"{FACTS_SQL} SELECT * FROM facts")
def derive(spark, sf_dir):
    found = facts.derive_facts(observations(spark, sf_dir), KINDS)
    return found.withColumn("positions", F.array_join(F.col("positions").cast("array<string>"), ","))


_FIRST = f"WITH {OBS}, first AS (SELECT subject, min(position) AS position, arg_min(kind, CAST(position AS BIGINT) * 1000000000 + ordinal) AS kind FROM obs WHERE kind = 'purchase' OR kind = 'error' GROUP BY subject), rec AS (SELECT subject, min(position) AS recorded FROM obs GROUP BY subject)"


@query("d2_apply_authority", f"""{_FIRST} SELECT f.subject, CASE WHEN recorded <= f.position - 2 THEN recorded ELSE f.position END AS position,
  CASE WHEN recorded <= f.position - 2 THEN 'full' ELSE kind END AS kind, f.position AS observed, CASE WHEN recorded <= f.position - 2 THEN recorded END AS recorded,
  coalesce(recorded <= f.position - 2, false) AS overridden FROM first f LEFT JOIN rec r ON lower(r.subject) = lower(f.subject)""")
def authority(spark, sf_dir):
    obs = observations(spark, sf_dir)
    records = obs.select(F.upper("subject").alias("subject"), "position")
    return facts.apply_authority(facts.debuts(obs.where("kind IN ('purchase', 'error')")), records, gap=2)


@query("d3_first_position", f"""WITH {OBS}, r AS (SELECT 'user ' || CAST(c_custkey AS VARCHAR) AS subject, CASE WHEN c_nationkey < 5 THEN c_nationkey END AS p FROM customer),
  f AS (SELECT subject, min(position) AS p FROM obs GROUP BY subject)
  SELECT r.subject, coalesce(r.p, f.p) AS position, CASE WHEN r.p IS NOT NULL THEN 'record' WHEN f.p IS NOT NULL THEN 'fact' END AS source FROM r LEFT JOIN f USING (subject)""")
def first_position(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    records = c.select(F.concat(F.lit("user "), F.col("c_custkey").cast("string")).alias("subject"), F.when(F.col("c_nationkey") < 5, F.col("c_nationkey")).alias("position"))
    return facts.first_position(records, facts.debuts(observations(spark, sf_dir)))


@query("d4_debuts", f"WITH {OBS} SELECT subject, min(position) AS position, arg_min(kind, CAST(position AS BIGINT) * 1000000000 + ordinal) AS kind FROM obs GROUP BY subject")
def debuts(spark, sf_dir):
    return facts.debuts(observations(spark, sf_dir))


_LEDGER = """WITH o AS (SELECT o_orderkey AS id, o_orderstatus AS value, o_orderpriority AS tier, CAST(o_orderdate AS DATE) AS verified_on FROM orders WHERE o_orderkey % 3 <> 0),
 n AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'X' ELSE o_orderstatus END AS value, o_orderpriority AS tier, CAST(NULL AS DATE) AS verified_on FROM orders WHERE o_orderkey % 2 = 0)"""


@query("a5_merge_facts", f"""{_LEDGER} SELECT coalesce(n.id, o.id) AS id, CASE WHEN n.id IS NOT NULL THEN n.value ELSE o.value END AS value, CASE WHEN n.id IS NOT NULL THEN n.tier ELSE o.tier END AS tier,
  CASE WHEN n.id IS NULL OR (o.id IS NOT NULL AND o.value = n.value AND o.tier = n.tier) THEN o.verified_on ELSE n.verified_on END AS verified_on,
  CASE WHEN n.id IS NULL THEN 'preserved' WHEN o.id IS NULL THEN 'new' WHEN o.value = n.value AND o.tier = n.tier THEN 'carried' ELSE 'replaced' END AS outcome
  FROM o FULL JOIN n ON o.id = n.id""")
def merge(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("value"), F.col("o_orderpriority").alias("tier"), F.to_date("o_orderdate").alias("verified_on"))
    fresh = o.where("id % 2 = 0").withColumn("value", F.when(F.col("id") % 4 == 0, "X").otherwise(F.col("value"))).withColumn("verified_on", F.lit(None).cast("date"))
    return facts.merge_facts(o.where("id % 3 <> 0"), fresh)


@query("a6_incremental_targets", "SELECT p_partkey AS key, p_name AS name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem GROUP BY l_partkey HAVING sum(l_quantity) > 700)")
def targets(spark, sf_dir):
    catalogue = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("name"))
    existing = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("key")).agg((F.sum("l_quantity") > 700).alias("found"))
    return facts.incremental_targets(catalogue, existing)

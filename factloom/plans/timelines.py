"""Timelines on the given tables: an order's lines are a series, ship dates its releases or pins."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import timelines as t
from factloom.plans.registry import query
from factloom.session import table


@query("h1_interpolate_ranges", """WITH r AS (SELECT o_custkey AS series, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, CAST(o_orderdate AS DATE) AS released FROM orders), x AS (SELECT series, n * 6 - 5 AS first, n * 6 AS last, released - 60 AS e, coalesce(lag(released - 60) OVER (PARTITION BY series ORDER BY n) + 7, DATE '1990-01-01') AS b FROM r),
  p AS (SELECT *, unnest(range(first, last + 1)) AS position FROM x) SELECT series, position, CASE WHEN position = last THEN e ELSE b + CAST(round_even((e - b) * (position - first)::DOUBLE / (last - first), 0) AS INTEGER) END AS day, position <> first AND position <> last AS approximate FROM p""")
def ranges(spark, sf_dir):
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long")
    r = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("series"), n.alias("n"), F.to_date("o_orderdate").alias("released"))
    return t.interpolate_ranges(r.select("series", (F.col("n") * 6 - 5).alias("first"), (F.col("n") * 6).alias("last"), "released", F.lit("1990-01-01").cast("date").alias("anchor")))


_PINS = """pos AS (SELECT c_custkey AS series, unnest(range(CAST(0 AS BIGINT), CAST(20 AS BIGINT))) AS position FROM customer), pin AS (SELECT o_custkey AS series, o_orderkey % 20 AS position, min(CAST(o_orderdate AS DATE)) AS day FROM orders GROUP BY 1, 2)"""


def _pinned(spark, sf_dir):
    pos = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("series"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(19).cast("long"))).alias("position"))
    pins = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("series"), (F.col("o_orderkey") % 20).alias("position")).agg(F.min(F.to_date("o_orderdate")).alias("day"))
    return pos, pins


_FILLED = f"""WITH {_PINS}, j AS (SELECT series, position, day, max(CASE WHEN day IS NOT NULL THEN position END) OVER w1 AS ap, min(CASE WHEN day IS NOT NULL THEN position END) OVER w2 AS bp FROM pos LEFT JOIN pin USING (series, position)
    WINDOW w1 AS (PARTITION BY series ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), w2 AS (PARTITION BY series ORDER BY position ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
  k AS (SELECT j.*, a.day AS ad, b.day AS bd FROM j LEFT JOIN pin a ON a.series = j.series AND a.position = ap LEFT JOIN pin b ON b.series = j.series AND b.position = bp)
  SELECT series, position, coalesce(day, CASE WHEN ad IS NOT NULL AND bd IS NOT NULL THEN CASE WHEN bd > ad THEN ad + CAST(round_even((bd - ad) * (position - ap)::DOUBLE / (bp - ap), 0) AS INTEGER) ELSE bd - CAST(7 * (bp - position) AS INTEGER) END WHEN ad IS NOT NULL THEN ad + CAST(7 * (position - ap) AS INTEGER) ELSE bd - CAST(7 * (bp - position) AS INTEGER) END) AS day, day IS NULL AS approximate FROM k"""


@query("h2_interpolate_pins", _FILLED)
def pins(spark, sf_dir):
    return t.interpolate_pins(*_pinned(spark, sf_dir))


#: Some positions have no day, some no row: neither binds another.
@query("h3_enforce_increasing", f"""WITH RECURSIVE filled AS ({_FILLED}), s AS (SELECT series, position, CASE WHEN position % 11 <> 3 THEN day END AS day, approximate, position % 5 = 0 AS hard FROM filled WHERE day IS NOT NULL AND position % 13 <> 4), r AS (SELECT * FROM s WHERE day IS NOT NULL),
  w AS (SELECT series, position, day, approximate, false AS warned FROM r WHERE NOT EXISTS (SELECT 1 FROM r AS x WHERE x.series = r.series AND x.position = r.position + 1)
    UNION ALL SELECT r.series, r.position, CASE WHEN r.day >= w.day AND NOT r.hard THEN w.day - 7 ELSE r.day END, r.approximate OR (r.day >= w.day AND NOT r.hard), r.day >= w.day AND r.hard FROM w JOIN r ON r.series = w.series AND r.position = w.position - 1)
  SELECT series, position, CAST(day AS DATE) AS day, approximate, warned FROM w UNION ALL SELECT series, position, NULL, approximate, false FROM s WHERE day IS NULL""")
def increasing(spark, sf_dir):
    rows = t.interpolate_pins(*_pinned(spark, sf_dir)).where("day is not null and position % 13 <> 4").withColumn("day", F.when(F.col("position") % 11 != 3, F.col("day")))
    return t.enforce_increasing(rows.withColumn("hard", F.col("position") % 5 == 0))


@query("h4_release_timeline", "SELECT 'order' AS kind, CAST(o_orderkey AS VARCHAR) AS key, CAST(o_orderdate AS DATE) AS day FROM orders UNION ALL SELECT 'event', CAST(event_id AS VARCHAR), CAST(ts AS DATE) FROM events")
def timeline(spark, sf_dir):
    return t.release_timeline(order=table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderdate").alias("day")), event=table(spark, sf_dir, "events").select(F.col("event_id").alias("key"), F.col("ts").alias("day")))


@query("h1_interpolate_seasons", """WITH s AS (SELECT o_orderkey AS season, o_custkey AS first, o_custkey + o_orderkey % 9 AS last, CAST(o_orderdate AS DATE) AS b, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 83 AS INTEGER) AS e FROM orders), p AS (SELECT *, unnest(range(first, last + 1)) AS position FROM s)
  SELECT season, position, CASE WHEN position = first THEN b WHEN position = last THEN e ELSE b + CAST(round_even((e - b) * (position - first)::DOUBLE / (last - first), 0) AS INTEGER) END AS day, position > first AND position < last AS approximate FROM p""")
def seasons(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    begins = F.to_date("o_orderdate")
    return t.interpolate_seasons(o.select(k.alias("season"), F.col("o_custkey").alias("first"), (F.col("o_custkey") + k % 9).alias("last"), begins.alias("begins"), F.date_add(begins, (k % 83).cast("int")).alias("ends")))

"""Reading and writing: round trips of the given tables through the catalogue's formats, in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from factloom.plans.registry import query
from factloom.session import ensure_checkpoint_dir, table
from factloom.sources import catalogue as c
from factloom.sources.tables import OBS, observations


def _folder(spark, name):
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("a1_read_observations", f"WITH {OBS} SELECT position, subject, CASE WHEN kind = 'view' THEN 'full' ELSE kind END AS kind FROM obs WHERE kind <> 'signup' AND kind <> 'error'")
def read_observations(spark, sf_dir):
    path = _folder(spark, "log")
    chapter = F.when(F.col("kind") == "signup", "n/a").otherwise(F.col("position").cast("string"))
    name = F.when(F.col("kind") == "error", "  ").otherwise(F.concat(F.lit(" "), "subject"))
    observations(spark, sf_dir).select(chapter.alias("chapter"), name.alias("name"), F.when(F.col("kind") == "view", "").otherwise(F.upper("kind")).alias("type")).write.csv(path, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return c.read_observations(spark, path)


@query("a2_read_records", "SELECT p_name || ' ' || p_partkey AS name, p_brand AS brand, p_size AS size FROM part")
def read_records(spark, sf_dir):
    path = _folder(spark, "records")
    entry = F.concat(F.lit('"'), F.concat_ws(" ", "p_name", "p_partkey"), F.lit('":'), F.to_json(F.struct(F.col("p_brand").alias("brand"), F.col("p_size").alias("size"))))
    files = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.concat(F.lit('﻿{"_note":"x",'), F.array_join(F.collect_list(entry), ","), F.lit("}")).alias("value"))
    files.select("value", "p_brand").write.partitionBy("p_brand").text(path)
    return c.read_records(spark, path, "map", "brand string, size int")


@query("a3_write_shard", "SELECT c_nationkey AS grp, array_to_string(list(c_custkey ORDER BY c_custkey), ',') AS members FROM customer GROUP BY 1")
def write_shard(spark, sf_dir):
    path = _folder(spark, "shard")
    c.write_shard(table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("grp")).agg(F.collect_list("c_custkey").alias("members")), path, ["grp"])
    back = c.read_shard(spark, path, "grp int, members array<long>")
    return back.select("grp", F.array_join(F.col("members").cast("array<string>"), ",").alias("members"))


@query("a4_publish_slices", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment, 1 AS slices, (SELECT count(*) FROM customer) AS rows FROM customer")
def publish_slices(spark, sf_dir):
    """What was published, read again: the index met with the slices, and the manifest's rows."""
    path = _folder(spark, "slices")
    customers = table(spark, sf_dir, "customer")
    manifest = c.publish_slices(customers, "c_custkey", ["c_name"], path)
    index, slices = c.read_slices(spark, path, "c_custkey long, c_nationkey int, c_acctbal double, c_mktsegment string")
    per = slices.groupBy("c_custkey").agg(F.max("c_nationkey").alias("c_nationkey"), F.max("c_acctbal").alias("c_acctbal"), F.max("c_mktsegment").alias("c_mktsegment"), F.count_distinct("bucket").cast("int").alias("slices"))
    whole = index.join(per, "c_custkey")
    return whole.crossJoin(F.broadcast(manifest.agg(F.sum("rows").alias("rows"))))  # one row

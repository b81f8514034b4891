"""Ranges that follow the data, numbers across them, slugs and the repair of dates, against plain Python."""

import os
import random
from collections import Counter
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from factloom.operators import edges, ranges, resolution, timelines
from factloom.plans import registry

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def shares(df, column, n):
    cuts = ranges.splitters(df, column, n)
    return Counter(r["b"] for r in df.select(ranges.in_range(F.col(column), cuts, F.xxhash64("id")).alias("b")).collect())


def test_ranges_follow_the_data(spark):
    far = spark.range(1001).select("id", F.when(F.col("id") == 1000, 1 << 60).otherwise(F.col("id")).alias("v"))
    found = shares(far, "v", 32)
    assert len(found) >= 30 and max(found.values()) <= 2 * 1001 / 32
    hot = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("v"))
    found = shares(hot, "v", 32)
    assert max(found.values()) <= 2 * 3000 / 32 and len(found) >= 30
    assert ranges.splitters(far.limit(0), "v", 32) == [] and len(shares(spark.range(5).withColumn("v", F.lit(None).cast("long")), "v", 4)) == 1


@pytest.mark.parametrize("n", [3, 64])
def test_running_sums(spark, n):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([5, 5, rng.randint(0, 50), 1 << 50]), rng.randint(0, 3), i) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, v long, x long, i long")
    got = ranges.running(df, ["k"], "v", "x", "s", n).collect()
    assert len(got) == 400
    for key in ("a", "b", None):
        mine = sorted((r for r in got if r["k"] == key), key=lambda r: (r["v"], r["s"]))
        total = 0
        for v in sorted({r["v"] for r in mine}):
            group = [r for r in mine if r["v"] == v]
            sums = sorted(r["s"] for r in group)
            assert sums[-1] == total + sum(r["x"] for r in group) and sums[0] >= total
            total = sums[-1]
    numbers = resolution.numbered(df, "v", 10, "n", n).collect()
    assert sorted(r["n"] for r in numbers) == list(range(10, 410)) and [r["v"] for r in sorted(numbers, key=lambda r: r["n"])] == sorted(r[1] for r in rows)


def served(rows, taken):
    names, out = set(taken), set()
    for base, ordinal in sorted(rows, key=lambda r: r[1]):
        slug, n = base, 2
        while slug in names:
            slug, n = f"{base}-{n}", n + 1
        names.add(slug)
        out.add((slug, ordinal))
    return out


@pytest.mark.parametrize("seed", [0, 3])
def test_slugs(spark, seed):
    rng = random.Random(seed)
    pool = ["a", "a-2", "a-3", "a-2-2", "a-2-3", "a-03", "a-1", "a-12", "a-7", "b", "b-2", "-2", "c-x", "a-2-2-2", "unknown"]
    weights = [12, 3, 3, 2, 1, 1, 1, 1, 1, 3, 1, 1, 1, 1, 6]
    rows = [(rng.choices(pool, weights)[0], i * 5) for i in range(120)]
    taken = rng.sample(["a", "a-2", "a-4", "a-5", "b-2", "a-2-2", "a-2-3", "unknown-3", "z", "a-3-2"], rng.randint(0, 6))
    got = [tuple(r) for r in resolution.unique_slugs(spark.createDataFrame(rows, "base string, ordinal long"), spark.createDataFrame([(t,) for t in taken], "slug string")).collect()]
    assert len(got) == len(rows) and set(got) == served(rows, taken)


def test_a_base_with_many_rows_is_no_group(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") % 1000 == 1, F.concat(F.lit("unknown-"), F.col("id"))).otherwise("unknown").alias("base"), F.col("id").alias("ordinal"))
    taken = spark.createDataFrame([(f"unknown-{i}",) for i in range(100, 200)], "slug string")
    got = resolution.unique_slugs(rows, taken)
    assert {tuple(r) for r in got.collect()} == served([tuple(r) for r in rows.collect()], [r["slug"] for r in taken.collect()])


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the given tables aren't here")
def test_query_of_numbered_names(spark):
    orders, suppliers = (spark.read.parquet(f"{FOLDER}/{t}.parquet").collect() for t in ("orders", "supplier"))
    rows = [(f"name-{o['o_custkey'] % 400 + 2}" if o["o_orderkey"] % 3 == 0 else "name", o["o_orderkey"]) for o in orders]
    got = [tuple(r) for r in registry.QUERIES["c3_slugs_of_numbered_names"](spark, FOLDER).collect()]
    assert len(got) == len(rows) and set(got) == served(rows, [f"name-{s['s_suppkey'] * 5}" for s in suppliers])


def test_counters_rise(spark):
    registry = spark.createDataFrame([("chr", 7), ("va", 90)], "prefix string, next long")
    ids = spark.createDataFrame([("chr:00012",), ("chr:00003",), ("va:00005",), ("new:00001",), ("odd",), (None,)], "id string")
    assert {tuple(r) for r in resolution.raised_counters(registry, ids).collect()} == {("chr", 13), ("va", 90), ("new", 2)}


def repaired(rows, step=7):
    days = {p: (d, a, h) for p, d, a, h in rows}
    out = {p: (d, a, False) for p, (d, a, h) in days.items()}
    for p in sorted(days, reverse=True):
        if p + 1 not in days or days[p][0] is None or out[p + 1][0] is None or out[p][0] < out[p + 1][0]:
            continue
        out[p] = (out[p][0], out[p][1], True) if days[p][2] else (out[p + 1][0] - timedelta(days=step), True, False)
    return {(p, *v) for p, v in out.items()}


@pytest.mark.parametrize("block", [16, 1])
def test_dates_over_several_blocks(spark, block):
    rng, rows, want = random.Random(block), [], set()
    for series in range(8):
        kept = [p for p in range(1, 120) if series % 2 or rng.random() > 0.03]
        spread = [3, 30, 200, 9][series % 4]
        mine = [(p, None if rng.random() < 0.02 else date(2000, 1, 1) + timedelta(days=p * (7 if series < 6 else -2) + rng.randint(-spread, spread)), rng.random() < 0.5, rng.random() < 0.04) for p in kept]
        if series == 5:
            mine[-1] = (mine[-1][0], date(1990, 1, 1), False, False)  # one early day moves all before it
        rows += [(series, *r) for r in mine]
        want |= {(series, *r) for r in repaired(mine)}
    frame = spark.createDataFrame(rows, "series long, position long, day date, approximate boolean, hard boolean")
    assert {tuple(r) for r in timelines.enforce_increasing(frame, block=block).collect()} == want
    assert timelines.enforce_increasing(frame.limit(0)).collect() == []


def test_positions_beside_an_outlier(spark):
    rng = random.Random(3)
    keys = sorted(rng.sample(range(2000), 300)) + [1 << 55]
    mapping = spark.createDataFrame([(k, [k + 1, 3]) for k in keys], "key long, positions array<long>")
    asked = [rng.randint(-10, 2010) for _ in range(200)] + [1 << 54, 1 << 56]
    got = {(r["key"], r["position"], r["how"]) for r in edges.asof_position(spark.createDataFrame([(a,) for a in asked], "key long"), mapping, ranges=16).collect()}
    best = lambda a: next((k for k in keys if k >= a), max(k for k in keys))
    assert got == {(a, max(best(a) + 1, 3), "exact" if a in keys else "filler") for a in asked}

"""Profiles, rankings, coverage and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def profile_observations(obs: DataFrame, kinds: tuple[str, ...], low: int, high: int) -> DataFrame:
    """Columns kind (null: all), rows, positions, subjects, out_of_range and unknown_kind, by kind and in all."""
    return obs.groupingSets([["kind"], []], "kind").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("position").alias("positions"),
        F.count_distinct("subject").alias("subjects"),
        F.count_if((F.col("position") < low) | (F.col("position") > high)).alias("out_of_range"),
        F.count_if(~F.col("kind").isin(*kinds)).alias("unknown_kind"),
    )


def sequence_gaps(df: DataFrame, column: str, known: DataFrame | None = None, group: tuple[str, ...] = (), start: int | None = None) -> DataFrame:
    """Missing integers between ``start`` (or the least) and the largest of each group, less the ``known`` ones."""
    present = df.select(*group, column).distinct()
    ends = present.groupBy(*group).agg(F.min(column).alias("_low"), F.max(column).alias("_high"))
    low = F.lit(start) if start is not None else F.col("_low")
    every = ends.where(low <= F.col("_high")).select(*group, F.explode(F.sequence(low.cast("long"), F.col("_high").cast("long"))).alias(column))
    missing = every.join(present.withColumn(column, F.col(column).cast("long")), [*group, column], "left_anti")
    return missing if known is None else missing.join(known.select(F.col(column).cast("long").alias(column)), column, "left_anti").select(*group, column)


def membership_groups(members: DataFrame, group: str, member: str, status: str, current: str = "current") -> DataFrame:
    """Columns group, members and current: distinct members of each group, and those with the current status."""
    distinct = members.select(group, member, status).distinct()
    return distinct.groupBy(group).agg(F.count(F.lit(1)).alias("members"), F.count_if(F.col(status) == current).alias("current"))


def keep_ids(groups: DataFrame, previous: DataFrame, key: str, kept: list[str]) -> DataFrame:
    """The groups with the ``kept`` columns that they had in ``previous``, if they had an id there; the first row of a key counts."""
    old = previous.where("id is not null").groupBy(key).agg(F.min(F.struct("id", *[c for c in kept if c != "id"])).alias("_old"))
    return groups.join(old, key, "left").select(*groups.columns, *[F.col(f"_old.{c}").alias(c) for c in kept])


def top_k(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first k rows in an order that leaves no ties."""
    return df.orderBy(*order).limit(k)


def cross_tab_provenance(facts: DataFrame, types: str, tier: str, verified: str) -> DataFrame:
    """Columns sources (sorted distinct source types, joined), tier, facts and verified (share)."""
    key = F.array_join(F.array_sort(F.array_distinct(types)), "+")
    per = facts.groupBy(key.alias("sources"), tier)
    return per.agg(F.count(F.lit(1)).alias("facts"), F.avg(F.col(verified).cast("double")).alias("verified"))


def cross_tab_totals(df: DataFrame, row: str, col: str, values: list[str]) -> DataFrame:
    """Counts of rows by ``row`` and each of the ``values`` of ``col``, with a total over all values."""
    return df.groupBy(row).agg(*[F.count_if(F.col(col) == v).alias(v) for v in values], F.count(F.lit(1)).alias("total"))


def fill_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns field, filled and rows: non-empty values of each column, from one pass over the table."""
    filled = lambda c: F.count_if(F.coalesce(F.trim(F.col(c).cast("string")) != "", F.lit(False)))
    one = df.agg(F.count(F.lit(1)).alias("rows"), *[filled(c).alias(c) for c in columns])
    return one.unpivot("rows", columns, "field", "filled").select("field", "filled", "rows")


def headline_stats(**counts: DataFrame) -> DataFrame:
    """One row: the value of each one-cell frame, under its name."""
    out = None
    for name, frame in counts.items():
        cell = frame.select(F.col(frame.columns[0]).alias(name))
        out = cell if out is None else out.crossJoin(cell)
    return out


def sliced_lists(df: DataFrame, key: str, item: str, per: int) -> DataFrame:
    """Columns key, slice, items (sorted) and n: the items of each key, those of a key with over ``per`` in several rows.

    Items are dealt to a key's slices by a hash, so that no row, and no task, holds more than about ``per`` of a key.
    """
    counts = df.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / per).cast("int").alias("_slices"))
    rows = df.join(counts, key).withColumn("slice", F.pmod(F.xxhash64(item), F.greatest("_slices", F.lit(1))).cast("int"))
    return rows.groupBy(key, "slice").agg(F.sort_array(F.collect_list(item)).alias("items"), F.count(F.lit(1)).alias("n"))


def invert_multivalue(df: DataFrame, key: str, values: Column, name: str = "value", per: int | None = 1000) -> DataFrame:
    """Columns value, keys and n: for each value in an array column, the sorted distinct keys that hold it.

    A value of more than ``per`` keys has several rows, told by ``slice``. With None, a value's keys are one row, which is
    for values that are known to have few.
    """
    one = df.select(key, F.explode(values).alias(name)).distinct()
    if per:
        return sliced_lists(one, name, key, per).withColumnRenamed("items", "keys")
    return one.groupBy(name).agg(F.sort_array(F.collect_list(key)).alias("keys"), F.count(F.lit(1)).alias("n"))


def first_n_per_group(df: DataFrame, key: str, value: str, order: str, n: int) -> DataFrame:
    """Columns key, value and rank: the first n values of each key, the same values in other case counted once."""
    once = df.groupBy(key, F.lower(value).alias("_folded")).agg(F.min_by(value, order).alias(value), F.min(order).alias(order))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return once.withColumn("rank", rank).where(F.col("rank") <= n).select(key, value, "rank")


def min_position_map(sources: list[DataFrame], least: int = 2) -> DataFrame:
    """Columns name and position: the smallest position of each valid name over all sources (name, position)."""
    both = sources[0].select("name", "position")
    for s in sources[1:]:
        both = both.unionByName(s.select("name", "position"))
    valid = (F.length(F.trim("name")) >= least) & F.col("position").isNotNull()
    return both.where(valid).groupBy("name").agg(F.min("position").alias("position"))


def compare_counts(edges: DataFrame, facts: DataFrame, key: str = "entity") -> DataFrame:
    """Columns key, edges, facts, verdict and delta: distinct positions in edges against the sum of fact values."""
    e = edges.groupBy(key).agg(F.count_distinct("position").alias("edges"))
    f = facts.groupBy(key).agg(F.sum("value").alias("facts"))
    verdict = F.when(F.col("facts").isNull(), "no-fact").when(F.col("edges").isNull(), "no-edge").when(F.col("edges") == F.col("facts"), "agree").otherwise("disagree")
    return e.join(f, key, "full").select(key, "edges", "facts", verdict.alias("verdict"), (F.coalesce("edges", F.lit(0)) - F.coalesce("facts", F.lit(0))).alias("delta"))


def coverage(expected: DataFrame, present: DataFrame, key: str, category: str, baseline: float) -> DataFrame:
    """Columns category, expected, missing, rate and regressed, by category: keys meet trimmed and in lower case."""
    norm = F.lower(F.trim(F.col(key)))
    have = present.select(norm.alias("_key")).distinct().withColumn("_have", F.lit(1))
    per = expected.select(category, norm.alias("_key")).distinct().join(have, "_key", "left").groupBy(category).agg(F.count(F.lit(1)).alias("expected"), F.count_if(F.col("_have").isNull()).alias("missing"))
    rate = 1 - F.col("missing") / F.col("expected")
    return per.select(category, "expected", "missing", rate.alias("rate"), (rate < baseline - 0.001).alias("regressed"))


def missing_keys(expected: DataFrame, present: DataFrame, key: str, category: str) -> DataFrame:
    """Columns category, key and missing (of its category): expected keys that aren't present, trimmed and in lower case."""
    norm = F.lower(F.trim(F.col(key)))
    lost = expected.select(category, norm.alias(key)).distinct().join(present.select(norm.alias(key)).distinct(), key, "left_anti")
    return lost.join(lost.groupBy(category).agg(F.count(F.lit(1)).alias("missing")), category).select(category, key, "missing")


def ratchet(baseline: DataFrame, rates: DataFrame, key: str = "category") -> DataFrame:
    """Columns key and rate: the better of each recorded and each new rate, so that a baseline never falls."""
    both = baseline.select(key, F.col("rate").alias("_old")).join(rates.select(key, F.round("rate", 4).alias("_new")), key, "full")
    return both.select(key, F.greatest("_old", "_new").alias("rate"))


def compare_membership(a: DataFrame, b: DataFrame) -> DataFrame:
    """Columns grp and verdict of two tables (grp, name, flag): identical, names, flags or both differ."""
    both = a.select("grp", "name", F.col("flag").alias("_a"), F.lit(1).alias("_in_a")).join(b.select("grp", "name", F.col("flag").alias("_b"), F.lit(1).alias("_in_b")), ["grp", "name"], "full")
    one_sided = F.col("_in_a").isNull() | F.col("_in_b").isNull()
    per = both.groupBy("grp").agg(F.bool_or(one_sided).alias("_names"), F.bool_or(~one_sided & ~F.col("_a").eqNullSafe(F.col("_b"))).alias("_flags"), F.count_if(F.col("_in_b").isNull()).alias("only_a"), F.count_if(F.col("_in_a").isNull()).alias("only_b"))
    verdict = F.when(F.col("_names") & F.col("_flags"), "both").when(F.col("_names"), "names").when(F.col("_flags"), "flags").otherwise("identical")
    return per.select("grp", verdict.alias("verdict"), "only_a", "only_b")


def heaviest(df: DataFrame, key: str, size: str, k: int, warn: float, fail: float) -> DataFrame:
    """The k largest rows by size, ties by key, with their severity."""
    severity = F.when(F.col(size) >= fail, "error").when(F.col(size) >= warn, "warning").otherwise("ok")
    return top_k(df.select(key, size), [F.desc(size), F.col(key)], k).withColumn("severity", severity)


def summarise_findings(findings: DataFrame) -> DataFrame:
    """Columns section, errors, warnings, notes and code (2, 1 or 0), of findings (section, severity)."""
    n = lambda s: F.count_if(F.col("severity") == s)
    rank = F.max(F.when(F.col("severity") == "error", 2).when(F.col("severity") == "warning", 1).otherwise(0))
    return findings.groupBy("section").agg(n("error").alias("errors"), n("warning").alias("warnings"), n("note").alias("notes"), rank.alias("code"))

"""Facts from observations, and ledgers of facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def derive_facts(obs: DataFrame, special: tuple[str, ...] = ("flashback", "cover", "silhouette")) -> DataFrame:
    """Columns subject, predicate, value, kind and positions.

    Per subject: ``first_position`` with the kind of its first row, ``appearances`` (distinct positions), and for
    each kind in ``special`` that occurs ``<kind>_appearances``; positions are the sorted citations.
    """
    rows = obs.where(F.col("subject").isNotNull() & F.col("position").isNotNull())
    distinct = lambda c: F.sort_array(F.collect_set(c))
    per = rows.groupBy("subject").agg(
        F.min_by(F.struct("position", "kind"), F.struct("position", "ordinal")).alias("_first"),
        distinct("position").alias("_all"),
        *[distinct(F.when(F.col("kind") == k, F.col("position"))).alias(f"_{k}") for k in special],
    )
    fact = lambda name, value, kind, positions: F.struct(F.lit(name).alias("predicate"), value.cast("long").alias("value"), kind.alias("kind"), positions.alias("positions"))
    none = F.lit(None).cast("string")
    facts = [fact("first_position", F.col("_first.position"), F.col("_first.kind"), F.array("_first.position")), fact("appearances", F.size("_all"), none, F.col("_all"))]
    facts += [fact(f"{k}_appearances", F.size(f"_{k}"), none, F.col(f"_{k}")) for k in special]
    return per.select("subject", F.inline(F.array(*facts))).where("value > 0")


def apply_authority(first: DataFrame, records: DataFrame, gap: int = 5, full: str = "full") -> DataFrame:
    """Columns subject, position, kind, observed, recorded and overridden.

    ``first`` (subject, position, kind) gives way to ``records`` (subject, position) only where the record is
    earlier by ``gap`` or more; the kind is then ``full``, and both positions are cited. Names meet in lower case.
    """
    known = records.groupBy(F.lower("subject").alias("_key")).agg(F.min("position").alias("recorded"))
    both = first.withColumn("_key", F.lower("subject")).join(known, "_key", "left")
    over = F.coalesce(F.col("recorded") <= F.col("position") - gap, F.lit(False))
    return both.select("subject", F.when(over, F.col("recorded")).otherwise(F.col("position")).alias("position"), F.when(over, F.lit(full)).otherwise(F.col("kind")).alias("kind"), F.col("position").alias("observed"), F.when(over, F.col("recorded")).alias("recorded"), over.alias("overridden"))


def first_position(records: DataFrame, facts: DataFrame) -> DataFrame:
    """Columns subject, position and source: the record's position, else the fact's, else null."""
    r = records.select("subject", F.col("position").alias("_r"))
    f = facts.select("subject", F.col("position").alias("_f"))
    source = F.when(F.col("_r").isNotNull(), "record").when(F.col("_f").isNotNull(), "fact")
    return r.join(f, "subject", "left").select("subject", F.coalesce("_r", "_f").alias("position"), source.alias("source"))


def debuts(obs: DataFrame) -> DataFrame:
    """Columns subject, position and kind: the first row of the smallest position."""
    first = obs.groupBy("subject").agg(F.min_by(F.struct("position", "kind"), F.struct("position", "ordinal")).alias("_first"))
    return first.select("subject", F.col("_first.position").alias("position"), F.col("_first.kind").alias("kind"))


def merge_facts(existing: DataFrame, fresh: DataFrame, key: str = "id", compared: tuple[str, ...] = ("value", "tier"), carried: str = "verified_on") -> DataFrame:
    """Ledger ``existing`` with ``fresh`` facts put in by key, and ``outcome``: preserved, new, carried or replaced.

    Where all ``compared`` columns are unchanged, the old ``carried`` value is kept with the fresh fact.
    """
    old, new = existing.alias("o"), fresh.alias("n")
    both = old.join(new, F.col(f"o.{key}") == F.col(f"n.{key}"), "full")
    is_old, is_new = F.col(f"o.{key}").isNotNull(), F.col(f"n.{key}").isNotNull()
    same = is_old & is_new
    for c in compared:
        same = same & F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}"))
    outcome = F.when(~is_new, "preserved").when(~is_old, "new").when(same, "carried").otherwise("replaced")
    pick = lambda c: F.when(is_new, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    kept: Column = F.when(same | ~is_new, F.col(f"o.{carried}")).otherwise(F.col(f"n.{carried}"))
    return both.select(pick(key).alias(key), *[pick(c).alias(c) for c in compared], kept.alias(carried), outcome.alias("outcome"))


def incremental_targets(catalogue: DataFrame, existing: DataFrame, key: str = "key") -> DataFrame:
    """Catalogue rows whose key is absent from ``existing`` or not found there."""
    return catalogue.join(existing.where(F.col("found")).select(key), key, "left_anti")

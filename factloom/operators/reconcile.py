"""Sources against each other: conflicts, drift, freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.text import INVISIBLE, equivalent
from factloom.session import sent_if_small


def find_conflicts(facts: DataFrame, multi_valued: tuple[str, ...] = ()) -> DataFrame:
    """Columns subject, predicate, n and values: facts (subject, predicate, value, ordinal) not all equivalent to the first.

    Equivalence isn't transitive, so each value is compared with the first one only; multi-valued predicates pass.
    """
    first = facts.where(~F.col("predicate").isin(*multi_valued)).groupBy("subject", "predicate").agg(F.min_by("value", "ordinal").alias("_first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    both = facts.join(first, ["subject", "predicate"])
    per = both.groupBy("subject", "predicate").agg(F.any_value("n").alias("n"), F.sort_array(F.collect_set("value")).alias("values"), F.bool_or(~equivalent(F.col("value"), F.col("_first"))).alias("_off"))
    return per.where(F.col("_off") & (F.size("values") > 1)).drop("_off")


def record_conflicts(records: DataFrame, facts: DataFrame) -> DataFrame:
    """Columns subject, predicate, recorded and verified: record values not equivalent to the last verified fact (…, ordinal)."""
    last = facts.groupBy("subject", "predicate").agg(F.max_by("value", "ordinal").alias("verified"))
    both = records.join(last, ["subject", "predicate"])
    return both.where(~equivalent(F.col("value"), F.col("verified"))).select("subject", "predicate", F.col("value").alias("recorded"), "verified")


def classify_conflicts(conflicts: DataFrame, labels: tuple[str, str, str, str], count_gap: int, position_gap: int) -> DataFrame:
    """Columns shard, kind, class, n and entities of conflicts (shard, kind, entity, name, delta).

    ``labels`` are the classes in the order they are asked: a name with invisible characters; counts over ``count_gap``, or
    positions over ``position_gap``, apart; smaller differences of these; other values.
    """
    d = F.abs("delta")
    unseen, wide, narrow, other = labels
    kind = F.when(F.col("name").rlike(INVISIBLE), unseen).when((F.col("kind") == "count") & (d > count_gap) | (F.col("kind") == "position") & (d > position_gap), wide).when(F.col("kind").isin("count", "position"), narrow).otherwise(other)
    return conflicts.groupBy("shard", "kind", kind.alias("class")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("entity").alias("entities"))


def first_position_disagreement(facts: DataFrame, records: DataFrame, gap: int = 5) -> DataFrame:
    """Columns subject, fact, record, delta and kind: first positions (subject, position) that lie ``gap`` or more apart."""
    both = facts.select("subject", F.col("position").alias("fact")).join(records.select("subject", F.col("position").alias("record")), "subject")
    delta = F.col("record") - F.col("fact")
    return both.where(F.abs(delta) >= gap).select("subject", "fact", "record", delta.alias("delta"), F.when(delta > 0, "later").otherwise("earlier").alias("kind"))


def external_drift(ours: DataFrame, theirs: DataFrame, primary: DataFrame, prefix: int = 14) -> DataFrame:
    """Columns subject, field and outcome (unparsed, same, drift, promotable) of our values against another source's.

    Values compare as a-z and 0-9 in lower case; one that begins with 14 characters of the other is no drift. Agreeing
    values whose subject has a ``primary`` source (subject) not used yet are promotable.
    """
    form = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    a, b = form(F.col("value")), form(F.col("_theirs"))
    both = ours.join(theirs.select("subject", "field", F.col("value").alias("_theirs")), ["subject", "field"], "left").join(primary.select("subject", F.lit(True).alias("_p")), "subject", "left")
    begins = F.startswith(a, F.substring(b, 1, prefix)) & (F.length(b) >= prefix) | F.startswith(b, F.substring(a, 1, prefix)) & (F.length(a) >= prefix)
    outcome = F.when(F.col("_theirs").isNull(), "unparsed").when((a != b) & ~begins, "drift").when(F.col("_p"), "promotable").otherwise("same")
    return both.select("subject", "field", outcome.alias("outcome"))


def triage_queue(queue: DataFrame) -> DataFrame:
    """Columns claim_id and verdict of queue rows (claim_id, subject, field, value, snippet).

    Digits of the value that are cited as a chapter or volume are a coincidence; a birthday beside the subject's last
    word can be confirmed; the rest needs review.
    """
    cited = F.regexp_extract_all("snippet", F.lit(r"(?i)(?:chapter|volume) (\d+)"), F.lit(1))
    own = F.regexp_extract_all("value", F.lit(r"(\d+)"), F.lit(1))
    last = F.element_at(F.split(F.lower("subject"), " "), -1)
    verdict = F.when(F.arrays_overlap(cited, own), "coincidence").when((F.col("field") == "birthday") & F.contains(F.lower("snippet"), last), "confirmable").otherwise("review")
    return queue.select("claim_id", verdict.alias("verdict"))


def stale_items(cache: DataFrame, current: DataFrame) -> DataFrame:
    """Columns key and state: current revisions (key, revision) against cached ones: unknown, first-seen, same or stale."""
    both = current.join(cache.select("key", F.col("revision").alias("_old"), F.lit(True).alias("_in")), "key", "left")
    state = F.when(F.col("_in").isNull(), "unknown").when(F.col("_old").isNull(), "first-seen").when(F.col("_old") == F.col("revision"), "same").otherwise("stale")
    return both.select("key", state.alias("state"))


def stale_checks(checks: DataFrame, data: DataFrame) -> DataFrame:
    """Columns check, last and stale of dated checks (check, on) against dated data (on): stale if never made or before the data's last day."""
    last = checks.groupBy("check").agg(F.max("on").alias("last"))
    newest = data.agg(F.max("on").alias("_newest"))  # one row
    both = last.crossJoin(F.broadcast(newest))
    return both.select("check", "last", F.coalesce(F.col("last").isNull() | (F.col("last") < F.col("_newest")), F.lit(False)).alias("stale"))


def changed_inputs(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Columns stage and needed: stages with a file (stage, path, content) whose digest isn't the manifest's (path, digest)."""
    now = files.select("stage", "path", F.sha2(F.col("content").cast("binary"), 256).alias("_now"))
    return now.join(manifest, "path", "left").groupBy("stage").agg(F.bool_or(~F.col("_now").eqNullSafe(F.col("digest"))).alias("needed"))


def stamp_age(docs: DataFrame, key: str, text: str, today: Column, oldest: int) -> DataFrame:
    """Columns key, stamp and age: ISO dates in texts that are older than ``oldest`` days."""
    stamps = docs.select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(r"(\d{4}-\d{2}-\d{2})"), F.lit(1)))).alias("_s"))
    dated = stamps.select(key, F.col("_s").try_cast("date").alias("stamp")).where("stamp is not null")
    return dated.withColumn("age", F.date_diff(today, "stamp")).where(F.col("age") > oldest)


def claim_drift(docs: DataFrame, key: str, text: str, patterns: dict[str, str], stats: DataFrame, tolerance: float) -> DataFrame:
    """Columns key, stat, claimed, live: numbers claimed in texts (stat -> pattern) beyond a tolerance of the live ones (stat, live)."""
    found = F.array(*[F.struct(F.lit(s).alias("stat"), F.replace(F.regexp_extract(F.col(text), p, 1), F.lit(","), F.lit("")).try_cast("long").alias("claimed")) for s, p in patterns.items()])
    rows = docs.select(key, F.inline(found)).where("claimed is not null").join(sent_if_small(stats), "stat")
    return rows.where(F.abs(F.col("claimed") - F.col("live")) > F.col("live") * tolerance).select(key, "stat", "claimed", "live")

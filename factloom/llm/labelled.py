"""Labelled rows for fitting classifiers: folds by checksum, samples of bounded size, and scores of whole tables."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.session import ensure_checkpoint_dir


def checksum(key: Column) -> Column:
    """CRC-32 of a key's text; 0 for a null key."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")), F.lit(0).cast("long"))


def held_out(key: Column, folds: int, fold: int) -> Column:
    """True for rows whose key's checksum leaves ``fold``: no label of theirs is ever learned."""
    return key.isNotNull() & (F.pmod(checksum(key), F.lit(folds)) == fold)


def fitting(rows: list[tuple[int, int]], chars: int) -> list[int]:
    """Ids, in the given order, of the (id, length) whose lengths fit into ``chars`` together; one that doesn't fit is
    passed over and costs nothing. If none fits, the shortest."""
    taken, room = [], chars
    for i, n in rows:
        if n <= room:
            taken.append(i)
            room -= n
    return taken or [i for i, _ in sorted(rows, key=lambda r: r[1])[:1]]


def _chosen(docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, bound: int, chars: int) -> DataFrame | None:
    """Columns doc_id, text and label of the rows of ``labelled_sample``; None without any."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1))
    known = known.where(~held_out(F.col("doc_id"), folds, fold)).groupBy("doc_id").agg(F.max("label").alias("label"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    sizes = texts.select("doc_id", F.length("text").alias("n")).join(known, "doc_id").groupBy("doc_id").agg(F.max("n").alias("n"), F.max("label").alias("label"))
    ensure_checkpoint_dir(docs.sparkSession)
    sizes = sizes.checkpoint()  # a row for each labelled document, so that the table is read once for them
    chosen = {}
    for y in (0, 1):
        rows = sizes.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound).select("doc_id", "n").collect()
        chosen |= {i: y for i in fitting([(r["doc_id"], r["n"]) for r in rows], chars)}
    if not chosen:
        return None
    ids = docs.sparkSession.createDataFrame(list(chosen.items()), "doc_id long, label int")
    return texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, bound: int, chars: int = 40_000_000) -> tuple[list[str], list[int]]:
    """Texts and labels of at most ``bound`` labelled documents for each label, never of the held-out fold.

    They are those whose ids have the smallest hashes, so that the choice is the same for any partitioning. Of these, each
    that still fits into ``chars`` characters for its label is taken, so that what comes to the driver is bounded by rows
    and by size; where none fits, the shortest is taken. Chosen texts are whole. Only ids and lengths are sorted; the texts of the chosen ones, a broadcast of at
    most two bounds of ids, are then read. A document labelled twice counts with its larger label, a repeated one with
    its least text; null labels and null texts don't count.
    """
    rows = _chosen(docs, labels, label, folds, fold, bound, chars)
    got = sorted(rows.collect(), key=lambda r: r["doc_id"]) if rows else []
    return [r["text"] for r in got], [r["label"] for r in got]


def fitted(model: type, fit: Callable, docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, bound: int, chars: int = 40_000_000):
    """What ``fit`` makes of the texts and labels of ``labelled_sample``, an instance of the dataclass ``model``.

    It is fitted in a task, to which the chosen texts go, so that the driver holds neither them nor what fitting takes; the
    model's fields come to the driver.
    """
    rows = _chosen(docs, labels, label, folds, fold, bound, chars)
    if rows is None:
        return fit([], [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted((r for batch in batches for r in zip(*[c.to_pylist() for c in batch.columns])), key=lambda r: r[0])
        fields = vars(fit([r[1] for r in got], [r[2] for r in got]))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fields)], pa.binary())], names=["fields"])

    (row,) = rows.repartition(1).mapInArrow(run, "fields binary").collect()
    return model(**pickle.loads(row["fields"]))


def language_sample(docs: DataFrame, folds: int, fold: int, bound: int, chars: int) -> tuple[list[str], list[str]]:
    """Texts and languages of at most ``bound`` documents of each language and ``chars`` of their characters, never of the
    held-out fold: those whose ids have the smallest hashes, chosen as in ``labelled_sample``.

    Null ids, texts and languages, and texts without a letter, don't count; of rows that repeat an id, the least does. The
    rows that come to the driver are bounded for each language.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang")).where("doc_id is not null and lang is not null")
    rows = rows.where(~held_out(F.col("doc_id"), folds, fold) & F.col("text").rlike(r"\p{L}"))
    order = Window.partitionBy("lang").orderBy("hash", "doc_id", "n")
    few = rows.select("doc_id", "lang", F.xxhash64("doc_id").alias("hash"), F.length("text").alias("n")).withColumn("at", F.row_number().over(order)).where(F.col("at") <= bound)
    by: dict[str, dict[int, int]] = {}
    for r in sorted(few.collect(), key=lambda r: (r["lang"], r["at"])):
        by.setdefault(r["lang"], {}).setdefault(r["doc_id"], r["n"])
    chosen = [(lang, i) for lang, sizes in by.items() for i in fitting(list(sizes.items()), chars)]
    if not chosen:
        return [], []
    ids = docs.sparkSession.createDataFrame(chosen, "lang string, doc_id long")
    got = rows.join(F.broadcast(ids), ["lang", "doc_id"]).groupBy("lang", "doc_id").agg(F.min(F.struct(F.length("text").alias("n"), "text"))["text"].alias("text")).orderBy("lang", "doc_id").collect()
    return [r["text"] for r in got], [r["lang"] for r in got]


def scored(docs: DataFrame, run: Callable, threshold: float, keep: tuple[str, ...], into: tuple[str, str]) -> DataFrame:
    """The columns in ``keep`` with the scores that ``run`` gives over Arrow batches of (text, kept columns), and whether
    they reach ``threshold``. Kept columns go by number meanwhile, so that their names may be any; those in ``into`` are added."""
    kept = [docs.schema[c] for c in keep]
    rows = docs.select(F.coalesce("text", F.lit("")).alias("text"), *[F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(kept)])
    fields = ", ".join([*[f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(kept)], "score double"])
    out = rows.mapInArrow(run, fields)
    return out.select(*[F.col(f"c{i}").alias(f.name) for i, f in enumerate(kept)], F.col("score").alias(into[0]), (F.col("score") >= threshold).cast("int").alias(into[1]))

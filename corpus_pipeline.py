"""A corpus pipeline on Spark: toxicity, quality, near-duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; what it returns is written as
Parquet and read again as the next one's documents.
"""

from __future__ import annotations

import itertools
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import packing, quality, queries, secrets, similar, toxicity
from factloom.session import ensure_checkpoint_dir, remove, table


def _kept(docs: DataFrame, module, model, threshold: float, label: int) -> DataFrame:
    """The rows that a classifier gives ``label``; its columns have names that ``docs`` lacks."""
    taken = {c.lower() for c in docs.columns}
    into = tuple(next(name for n in itertools.count() if (name := f"{kind}_{n}") not in taken) for kind in ("score", "predicted"))
    scored = module.score(docs, model, threshold, keep=tuple(docs.columns), into=into)
    return scored.where(F.col(into[1]) == label).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go.

    Null and empty texts stay if a text without words is not toxic; repeated rows and null ids are judged each; other
    columns may have any names; an empty table gives no rows.
    """
    return _kept(docs, toxicity, queries.toxicity_model(spark, docs, sf_dir), toxicity.BAR, 0)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    Null and empty texts are judged as texts without words; repeated rows and null ids are judged each; other columns
    may have any names; an empty table gives no rows.
    """
    return _kept(docs, quality, queries.quality_model(spark, docs, sf_dir), 0.5, 1)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest id: groups of texts whose shingles of five words have
    a similarity of 0.8 or more. SimHash blocks name candidates, MinHash bands those that differ in more bits.

    Null and empty texts are one group; rows without an id belong to their text's group, and stay only where none of it
    has one; different texts under one id are told apart; of repeated rows one stays; other columns may have any names;
    an empty table gives no rows.
    """
    return similar.distinct_documents(docs, shingle=5, similarity=0.8)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are masked; n_chars, where there is such a column, follows the text.

    Null and empty texts, and those without a secret, stay as they are; repeated rows and null ids are masked each;
    other columns may have any names; an empty table gives no rows.
    """
    masked = secrets.redact(docs, secrets.trained_model(spark, docs))
    return masked.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, in sequences of at most 2048 tokens.

    A null or empty text is its end id alone; null ids stay null and repeated rows are packed each; other columns are
    not read; an empty table gives no rows.
    """
    return packing.pack(docs, capacity=2048)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_low_quality),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("packing", pack_sequences),
]

#: The classifiers, fingerprints and tokens have no SQL form; tests hold run() against plain Python instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents table; what they write goes to the shared checkpoint folder, and what the last one
    doesn't need is deleted again."""
    folder, last = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    docs = table(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES):
        at = f"{folder}/{n}-{name}"
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
        if last:
            remove(spark, last)
        last = at
    return docs

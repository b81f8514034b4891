"""The given tables in the roles of the catalogue: observations, statements, records and so on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.session import table


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns position, subject, kind and ordinal: events by day of the month, user and type."""
    e = table(spark, sf_dir, "events")
    return e.select(F.dayofmonth("ts").alias("position"), F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("subject"), F.col("event_type").alias("kind"), F.col("event_id").alias("ordinal"))


#: The same in DuckDB, as a common table expression.
OBS = "obs AS (SELECT CAST(day(ts) AS INTEGER) AS position, 'user ' || CAST(user_id AS VARCHAR) AS subject, event_type AS kind, event_id AS ordinal FROM events)"


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns statement_id, volume, question, answer and ordinal: each user turn and the assistant turn after it."""
    from factloom.operators.statements import pair_turns

    turns = pair_turns(table(spark, sf_dir, "conversations"))
    return turns.select(F.concat_ws("-", "conv_id", "turn").alias("statement_id"), F.col("conv_id").alias("volume"), "question", "answer", (F.col("conv_id") * 1000 + F.col("turn")).alias("ordinal"))


STATEMENTS = """turns AS (
  SELECT conv_id, turn, role, text, min(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_user,
         min(CASE WHEN role = 'assistant' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_answer
  FROM conversations
), statements AS (
  SELECT q.conv_id || '-' || q.turn AS statement_id, q.conv_id AS volume, q.text AS question, a.text AS answer, q.conv_id * 1000 + q.turn AS ordinal
  FROM turns q JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.next_answer AND a.role = 'assistant'
  WHERE q.role = 'user' AND (q.next_user IS NULL OR q.next_answer < q.next_user) AND length(q.text) > 4 AND length(a.text) > 4
)"""

"""Question-and-answer archives."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pair_turns(turns: DataFrame, least: int = 4) -> DataFrame:
    """Columns conv_id, turn, question and answer: each user turn with the next assistant turn before the following
    user turn; other roles are ignored, and pairs with a text of ``least`` characters or fewer are dropped."""
    spoken = turns.where(F.col("role").isin("user", "assistant"))
    order = Window.partitionBy("conv_id").orderBy("turn")
    following = spoken.select("conv_id", "turn", "role", F.col("text").alias("question"), F.lead("role").over(order).alias("_role"), F.lead("text").over(order).alias("answer"))
    pairs = following.where("role = 'user' AND _role = 'assistant'")
    return pairs.where((F.length("question") > least) & (F.length("answer") > least)).select("conv_id", "turn", "question", "answer")


def pair_markers(docs: DataFrame, key: str, text: str, question: str = "Q:", answer: str = "A:", least: int = 4) -> DataFrame:
    """Columns key, n, question and answer of marked archives: each question with the first answer after it.

    An answer ends at the next question. Questions without an answer are skipped, as are texts of ``least``
    characters or fewer.
    """
    parts = docs.select(key, F.posexplode(F.slice(F.split(F.col(text), f"\\Q{question}\\E", -1), F.lit(2), F.lit(2147483647))).alias("n", "_part"))
    halves = parts.withColumn("_at", F.instr("_part", answer)).where("_at > 0")
    both = halves.select(key, "n", F.trim(F.expr("substring(_part, 1, _at - 1)")).alias("question"), F.trim(F.expr(f"substring(_part, _at + {len(answer)})")).alias("answer"))
    return both.where((F.length("question") > least) & (F.length("answer") > least))

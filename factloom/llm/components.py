"""Connected components of an edge list, by rounds of joins on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.session import ensure_checkpoint_dir


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Ties each larger neighbour of a node to the least of the node and its neighbours."""
    both = _both(edges)
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Ties a node and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    others = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return others.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Columns node and root, the least node that each node of ``edges`` (a, b) reaches; nodes need an order.

    Alternates the large-star and small-star steps (Kiveris et al., 2014) until the edges form stars, which takes a
    number of rounds that grows with the logarithm of the largest component. Every round goes to the checkpoint
    folder, so that lineage stays short and a lost executor costs no more than the round. Each step's groups are
    aggregated before they are shuffled, and its join splits where a node has very many edges. Null ends and loops
    are dropped; no edges give no rows.
    """
    spark = edges.sparkSession
    ensure_checkpoint_dir(spark)
    edges = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    last = None
    for _ in range(rounds):
        edges = _small_star(_large_star(edges)).checkpoint()
        # the digest is of the set of edges, so equal digests mean that a round has changed nothing
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 31)))).first()
        if now == last:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        last = now
    raise RuntimeError(f"components not settled after {rounds} rounds")

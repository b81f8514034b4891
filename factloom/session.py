"""Session helpers shared by the jobs."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that are sent to every executor, at most, and bytes of them.
SMALL, SMALL_BYTES = 100_000, 32 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """The session, set so that a union claims no partitioning of its own.

    Spark 4.1 takes a union of frames that are partitioned alike for partitioned so, and then leaves out the shuffle before
    a window or a repartition by the same key. Adaptive execution merges the partitions of each side by itself, so that
    rows of one key end up apart, and results are wrong (seen in ``unique_slugs``; its tests fail without this).
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: the cluster's ``spark.checkpoint.dir``.

    Where none is set, a session on one machine gets a temporary one. On a cluster that would be a folder of the driver
    alone, so there it is an error.
    """
    prepare(spark)
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder, in whatever store it is."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def sent_if_small(df: DataFrame, rows: int = SMALL, size: int = SMALL_BYTES) -> DataFrame:
    """The frame with a broadcast hint if it has at most ``rows`` rows and, as text, ``size`` bytes; else as it is.

    That is counted first, which runs the frame: hand over tables, aggregates or checkpoints.
    """
    text = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    n, have = df.limit(rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(text), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and have <= size else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")

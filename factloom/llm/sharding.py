"""Sharding by jump consistent hashing, with DataFrame functions only.

A row's shard follows from its key and the number of shards alone. No ring table is kept, and when shards are
appended, the only rows that move are those that go into the new shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.session import ensure_checkpoint_dir

#: Multiplier of the 64-bit linear congruential generator in the published algorithm (Lamping and Veach, 2014).
LCG = 2862933555777941757
LOW32 = 0xFFFFFFFF
#: Copies of one row that a task lays out at once.
RUN = 1 << 16


def _next(hi: Column, lo: Column) -> tuple[Column, Column]:
    """``state * LCG + 1`` modulo 2^64 on two unsigned 32-bit halves; no step leaves the range of a signed long."""
    low, high = LCG & LOW32, LCG >> 32
    a, b = F.lit(low & 0xFFFF), F.lit(low >> 16)
    first, second = lo * a + 1, lo * b
    total = first + F.shiftleft(second.bitwiseAND(F.lit(0xFFFF)), 16)
    carry = F.shiftrightunsigned(total, 32) + F.shiftrightunsigned(second, 16)
    cross = hi * a + F.shiftleft((hi * b).bitwiseAND(F.lit(0xFFFF)), 16)
    upper = carry + (lo * F.lit(high)).bitwiseAND(F.lit(LOW32)) + cross.bitwiseAND(F.lit(LOW32))
    return upper.bitwiseAND(F.lit(LOW32)), total.bitwiseAND(F.lit(LOW32))


def jump_hash(key: Column, shards: int) -> Column:
    """Struct of the jumps below and at or beyond ``shards``: ``b`` is the shard, ``j`` the next jump.

    A key that lies in shard ``b`` of ``n`` goes to shard ``n`` of ``n + 1`` if ``j == n`` and stays otherwise.
    A null key counts as 0.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    hi, lo = _next(F.shiftrightunsigned(key, 32), key.bitwiseAND(F.lit(LOW32)))
    zero = F.lit(0).cast("long")
    start = F.struct(hi.alias("hi"), lo.alias("lo"), F.lit(-1).cast("long").alias("b"), zero.alias("j"))

    def step(state: Column, _: Column) -> Column:
        jump = F.floor((state["j"] + 1) * (F.lit(float(1 << 31)) / (F.shiftrightunsigned(state["hi"], 1) + 1).cast("double")))
        up, down = _next(state["hi"], state["lo"])
        moved = F.struct(up.alias("hi"), down.alias("lo"), state["j"].alias("b"), jump.cast("long").alias("j"))
        return F.when(state["j"] < shards, moved).otherwise(state)

    # each jump goes on by one shard at least, so that `shards` steps are enough
    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step)


def jump_shards(docs: DataFrame, shards: int = 24, key: str = "doc_id", text: str = "text", buckets: int = 1024) -> DataFrame:
    """All rows with their shard, their place in it, and their shard if one more is appended.

    Returns key, size (UTF-8 bytes of the text plus 8; a null text has none), text_crc32 (unsigned, a null text as
    empty), law ("key"), shard, slot (gapless from 0 in each shard) and grown_shard.

    Equal rows (key, size, checksum) are one row with their number until the end, so that copies cost no more than one.
    Slots come from two levels: each shard is cut into ``buckets`` parts by a checksum of key and text, the copies
    before a row are added up inside a part, and a part starts where those before it end. So no task holds a shard; the
    table of parts has at most ``shards * buckets`` rows, which bounds what is broadcast. Copies are laid out in runs
    of at most ``RUN``, dealt over tasks. Texts are read once; what is kept of them goes to the checkpoint folder.

    Null keys count as key 0; null and empty texts have size 8 and checksum 0. Repeated rows each get a slot of
    their own. Other columns are not read, so that their names cannot clash. An empty table gives no rows.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    text_bytes = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    jump = jump_hash(F.col(key), shards)
    rows = docs.select(
        F.col(key).alias("_key"),
        (F.length(text_bytes) + F.lit(8)).cast("long").alias("_size"),
        F.crc32(text_bytes).alias("_crc"),
        jump.alias("_jump"),
    ).select(
        "_key",
        "_size",
        "_crc",
        F.col("_jump.b").cast("int").alias("_shard"),
        F.when(F.col("_jump.j") == shards, F.lit(shards)).otherwise(F.col("_jump.b")).cast("int").alias("_grown"),
        F.pmod(F.crc32(F.concat_ws(":", F.col("_key").cast("string"), F.col("_crc").cast("string")).cast("binary")), F.lit(buckets)).cast("int").alias("_part"),
    )
    groups = rows.groupBy("_shard", "_part", "_key", "_size", "_crc", "_grown").agg(F.count(F.lit(1)).alias("_n")).checkpoint()
    parts = groups.groupBy("_shard", "_part").agg(F.sum("_n").alias("_all"))
    before = "sum(_all) over (partition by _shard order by _part rows between unbounded preceding and 1 preceding)"
    parts = parts.select("_shard", "_part", F.coalesce(F.expr(before), F.lit(0)).alias("_start"))
    inside = "sum(_n) over (partition by _shard, _part order by _key, _size, _crc rows between unbounded preceding and 1 preceding)"
    placed = groups.withColumn("_at", F.coalesce(F.expr(inside), F.lit(0))).join(F.broadcast(parts), ["_shard", "_part"]).withColumn("_at", F.col("_start") + F.col("_at"))
    many = placed.where(F.col("_n") > RUN).withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(RUN).cast("long"))))
    many = many.select("*", (F.col("_at") + F.col("_run")).alias("_from"), F.least(F.lit(RUN).cast("long"), F.col("_n") - F.col("_run")).alias("_some")).repartition("_key", "_crc", "_run")
    few = placed.where(F.col("_n") <= RUN).select("*", F.col("_at").alias("_from"), F.col("_n").alias("_some"))
    out = [
        F.col("_key").alias(key),
        F.col("_size").alias("size"),
        F.col("_crc").alias("text_crc32"),
        F.lit("key").alias("law"),
        F.col("_shard").alias("shard"),
        F.explode(F.sequence(F.col("_from"), F.col("_from") + F.col("_some") - 1)).alias("slot"),
        F.col("_grown").alias("grown_shard"),
    ]
    return few.select(*out).unionAll(many.select(*out))

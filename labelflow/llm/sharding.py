"""Sharding by jump consistent hashing (DataFrame and SQL functions only).

The generator is a 64-bit multiplicative one; Spark's checked arithmetic has no wrapping product, so the
state is held as two 32-bit halves and every partial product stays below 2^63. No ring table exists:
the shard follows from the key and the number of shards alone, and one more shard takes rows only into
itself.

Defined cases: the key is the identifier's 64-bit hash, so a null identifier has a shard like any other;
a null text counts 0 bytes and has the checksum 0; repeated rows share a shard and get a slot each; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labelflow.llm.common import stored, text_or_empty

MASK = 0xFFFFFFFF
#: fixed values: the multiplier 2862933555777941757 of the published algorithm, as its two 32-bit halves
MUL_HI, MUL_LO = 0x27BB2EE6, 0x87B0B0FD


def _and(c: Column, m: int) -> Column:
    return c.bitwiseAND(F.lit(m))


def _step(hi: Column, lo: Column) -> tuple[Column, Column]:
    """(hi, lo) * multiplier + 1 modulo 2^64."""
    t = F.shiftright(lo, 16) * F.lit(MUL_LO)
    s = _and(lo, 0xFFFF) * F.lit(MUL_LO) + _and(t, 0xFFFF) * F.lit(1 << 16) + F.lit(1)
    carry = F.shiftright(s, 32) + F.shiftright(t, 16)
    cross = _and(lo * F.lit(MUL_HI), MASK)
    top = _and(_and(hi, 0xFFFF) * F.lit(MUL_LO) + _and(F.shiftright(hi, 16) * F.lit(MUL_LO), 0xFFFF) * F.lit(1 << 16), MASK)
    return _and(carry + cross + top, MASK), _and(s, MASK)


def jump_state(key: Column, shards: int) -> Column:
    """struct(hi, lo, b, j): b is the shard among `shards`, j the next number of shards that moves the key."""
    start = F.struct(_and(F.shiftrightunsigned(key, 32), MASK).alias("hi"), _and(key, MASK).alias("lo"),
                     F.lit(-1).cast("bigint").alias("b"), F.lit(0).cast("bigint").alias("j"))

    def go(s, _):
        hi, lo = _step(s["hi"], s["lo"])
        jump = F.floor((s["j"] + 1).cast("double") * (F.lit(float(1 << 31)) / (F.shiftright(hi, 1) + 1).cast("double")))
        moved = F.struct(hi.alias("hi"), lo.alias("lo"), s["j"].alias("b"), jump.alias("j"))
        return F.when(s["j"] < shards, moved).otherwise(s)

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, go)


def jump_shard(key: Column, shards: int) -> Column:
    return jump_state(key, shards)["b"].cast("int")


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Slots are dense per shard without a window over a whole shard: rows are numbered within
    (shard, block), blocks are the tasks that wrote the placed table, and each block's offset is the sum of
    the shard's earlier block counts (one row per shard and block)."""
    text = text_or_empty()
    s = jump_state(F.xxhash64(F.col("doc_id")), shards)
    placed = docs.select(F.col("doc_id"), (F.octet_length(text).cast("bigint") + 8).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
                         s.alias("s"))
    placed = placed.select("doc_id", "size", "text_crc32", F.col("s.b").cast("int").alias("shard"),
                           # the next jump lands on the appended shard, or beyond it
                           F.when(F.col("s.j") == shards, F.lit(shards)).otherwise(F.col("s.b")).cast("int").alias("grown_shard"),
                           F.spark_partition_id().alias("_block"), F.monotonically_increasing_id().alias("_at"))
    placed = stored(placed, "sharding")
    counts = placed.groupBy("shard", "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy("shard").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("shard", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    within = placed.withColumn("_r", F.row_number().over(W.partitionBy("shard", "_block").orderBy("_at")))
    return (within.join(offsets, ["shard", "_block"])
            .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
                    (F.col("_offset") + F.col("_r") - 1).cast("bigint").alias("slot"), "grown_shard"))

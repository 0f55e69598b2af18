"""Sharding by jump consistent hashing (Lamping and Veach, 2014), in SQL functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalume.llm.common import numbered

# The multiplier 2862933555777941757 of the generator, as 16-bit limbs from the low end.
LIMBS = [2862933555777941757 >> (16 * i) & 0xFFFF for i in range(4)]
LOW32 = 0xFFFFFFFF


def _step(s: Column, shards: int) -> Column:
    """One jump. The 64-bit state is two 32-bit halves, so that no product overflows."""
    lo, hi = s["lo"], s["hi"]
    low = lo * LIMBS[0] + F.shiftleft((lo * LIMBS[1]).bitwiseAND(F.lit(0xFFFF)), 16) + 1
    high = (
        F.shiftright(low, 32)
        + F.shiftright(lo * LIMBS[1], 16)
        + lo * LIMBS[2]
        + F.shiftleft((lo * LIMBS[3]).bitwiseAND(F.lit(0xFFFF)), 16)
        + hi * LIMBS[0]
        + F.shiftleft((hi * LIMBS[1]).bitwiseAND(F.lit(0xFFFF)), 16)
    ).bitwiseAND(F.lit(LOW32))
    low = low.bitwiseAND(F.lit(LOW32))
    jump = F.floor((s["j"] + 1) * (F.lit(2147483648.0) / (F.shiftright(high, 1) + 1).cast("double")))
    moved = F.struct(s["j"].alias("b"), jump.cast("long").alias("j"), low.alias("lo"), high.alias("hi"))
    return F.when(s["j"] < shards, moved).otherwise(s)


def jump_shard(key: Column, shards: int) -> Column:
    """The shard (int, 0 to shards - 1) of a 64-bit key; a null key counts as 0.

    Adding a shard moves a key either nowhere or into the new shard. A key jumps about
    ln(shards) times; the fold allows for many more, and the rare rest goes on to the full
    ``shards`` steps, which always suffice.
    """
    if shards < 1:
        raise ValueError("shards must be 1 or more")
    k = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    start = F.struct(
        F.lit(-1).cast("long").alias("b"),
        F.lit(0).cast("long").alias("j"),
        k.bitwiseAND(F.lit(LOW32)).alias("lo"),
        F.shiftrightunsigned(k, 32).alias("hi"),
    )
    few = min(shards, 16 + 8 * math.ceil(math.log(shards + 1)))
    fold = lambda s, n: F.aggregate(F.sequence(F.lit(1), F.lit(n)), s, lambda acc, _: _step(acc, shards))
    end = fold(start, few)
    if few < shards:
        end = F.when(end["j"] < shards, fold(end, shards - few)).otherwise(end)
    return end["b"].cast("int")


def shard(docs: DataFrame, shards: int, key: str = "doc_id", out: str = "shard") -> DataFrame:
    """``docs`` with the shard of each row. Rows of one key stay together; there is no shuffle.

    Null keys share the shard of key 0. An existing column named ``out`` is replaced. An empty
    table gives an empty table.
    """
    return docs.withColumn(out, jump_shard(docs[key], shards))


def shard_manifest(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: where it goes, and its gapless position (slot) in its shard.

    Columns: doc_id, size (UTF-8 bytes of the text, none for null, plus 1), text_crc32 (null for
    a null text), law ('key'), shard, slot, grown_shard (with one more shard).

    Slots follow (bucket, doc_id, crc, size), where the bucket is one of 4096 computed from key
    and text. A shard is thus numbered by many tasks, and repeated rows are counted before they
    are dealt out. Repeated rows get slots of their own. Only four narrow columns are shuffled.
    """
    size = (F.coalesce(F.octet_length(docs[text]), F.lit(0)) + 1).cast("long")
    narrow = docs.select(docs[key].cast("long").alias("doc_id"), size.alias("size"), F.crc32(docs[text].cast("binary")).alias("text_crc32"))
    narrow = narrow.select(
        "*",
        jump_shard(F.col("doc_id"), shards).alias("shard"),
        jump_shard(F.col("doc_id"), shards + 1).alias("grown_shard"),
        F.pmod(F.coalesce(F.pmod(F.col("doc_id"), F.lit(1000003)) * 31, F.lit(0)) + F.coalesce("text_crc32", F.lit(0)), F.lit(4096)).alias("bucket"),
    )
    placed = numbered(narrow, ["shard"], ["bucket"], ["doc_id", "text_crc32", "size"], "first")
    each = placed.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_rows") - 1)))
    return each.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("first") + F.col("i")).alias("slot"), "grown_shard")

"""Sharding by jump consistent hashing, in column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilescope.llm.common import before, keep, md5_key

#: The multiplier of the published jump hash's 64-bit linear congruential generator, as its two 32-bit halves.
MULTIPLIER = 2862933555777941757
_HIGH, _LOW = MULTIPLIER >> 32, MULTIPLIER & 0xFFFFFFFF
_MASK = 0xFFFFFFFF
EXPAND = 4096


def _next(high: Column, low: Column) -> tuple[Column, Column]:
    """Both halves of key * MULTIPLIER + 1 modulo 2**64; every product stays below 2**50."""
    x = low * (_LOW & 0xFFFF) + 1
    y = low * (_LOW >> 16)
    sum_low = x + F.shiftleft(y.bitwiseAND(0xFFFF), 16)
    cross = low * (_HIGH & 0xFFFF) + F.shiftleft((low * (_HIGH >> 16)).bitwiseAND(0xFFFF), 16)
    cross2 = high * (_LOW & 0xFFFF) + F.shiftleft((high * (_LOW >> 16)).bitwiseAND(0xFFFF), 16)
    sum_high = F.shiftright(sum_low, 32) + F.shiftright(y, 16) + cross + cross2
    return sum_high.bitwiseAND(_MASK), sum_low.bitwiseAND(_MASK)


def jump(key_hash: Column, n: int) -> Column:
    """Struct (shard, grown): where a key lies with ``n`` shards and with ``n + 1``.

    ``key_hash`` is a hexadecimal digest; its first 64 bits seed the generator. A step jumps from
    shard b to a later one; the last shard below n is the answer. The sequence does not depend on n,
    so with one shard more a key stays or moves to the new shard. At most n steps can be needed, and
    steps past the end keep the state; about ln n of them compute anything.
    """
    start = F.struct(F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"),
                     F.conv(F.substring(key_hash, 1, 8), 16, 10).cast("long").alias("hi"),
                     F.conv(F.substring(key_hash, 9, 8), 16, 10).cast("long").alias("lo"))

    def step(s, _):
        high, low = _next(s["hi"], s["lo"])
        far = ((s["j"] + 1).cast("double") * (F.lit(2147483648.0) / (F.shiftright(high, 1) + 1).cast("double"))).cast("long")
        return F.when(s["j"] >= n, s).otherwise(F.struct(s["j"].alias("b"), far.alias("j"), high.alias("hi"), low.alias("lo")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(n)), start, step, lambda s: F.struct(
        s["b"].cast("int").alias("shard"), F.when(s["j"] == n, n).otherwise(s["b"]).cast("int").alias("grown")))


def shard_documents(docs: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard), one row per document, by the law ``key``.

    The shard depends on the id and ``n_shards`` only (a null id counts as a key of its own, texts do
    not matter); ``size`` is the text's UTF-8 bytes plus 16, a null text has 16 and a null checksum.
    Slots count from 0 in each shard in md5 order of (id, size, checksum), without gaps; rows equal in
    all three are interchangeable and take neighbouring slots. Other columns are not read.

    Plan: one scan of the texts; equal rows are counted map-side before the first shuffle, offsets of
    hash buckets replace a window per shard, and repeated rows are expanded in pieces of 4,096.
    """
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"),
                       (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"))
    counted = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n"))
    placed = keep(counted.select("*", md5_key(F.col("doc_id"), F.col("size"), F.col("text_crc32")).alias("h"),
                                 jump(md5_key(F.col("doc_id")), n_shards).alias("at")).select("*", "at.*").drop("at"), "shards")
    ordered = before(placed, ["shard"], "h", ["n"])
    pieces = ordered.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(EXPAND).cast("long"))).alias("_from")).hint("rebalance")
    slots = F.sequence(F.col("_from"), F.least(F.col("n"), F.col("_from") + EXPAND) - 1)
    return (pieces.select("*", F.explode(slots).alias("_i"))
            .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
                    (F.col("before_n") + F.col("_i")).alias("slot"), F.col("grown").alias("grown_shard")))

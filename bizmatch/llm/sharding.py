"""Sharding by jump consistent hashing, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import input_bytes, materialize

#: The multiplier of the linear congruential generator of jump consistent hashing; its increment is 1.
LCG = 2862933555777941757
#: Steps tried before the long loop, which few keys need.
SHORT = 12


def _low32(x: Column, by: int) -> Column:
    """x * by modulo 2**32, for 0 <= x, by < 2**32; no step leaves the range of a long."""
    return (x * F.lit(by & 0xFFFF) + F.shiftleft((x * F.lit(by >> 16)).bitwiseAND(0xFFFF), 16)).bitwiseAND(0xFFFFFFFF)


def _advance(h: Column, l: Column) -> tuple[Column, Column]:
    """The generator's next state, as halves of 32 bits, from 16-bit limbs."""
    by = LCG & 0xFFFFFFFF
    q = l * F.lit(by >> 16)
    r = l * F.lit(by & 0xFFFF) + F.shiftleft(q.bitwiseAND(0xFFFF), 16) + 1
    high = F.shiftright(r, 32) + F.shiftright(q, 16) + _low32(l, LCG >> 32) + _low32(h, by)
    return high.bitwiseAND(0xFFFFFFFF), r.bitwiseAND(0xFFFFFFFF)


def _jump(s: Column, counts: list[int]) -> Column:
    """One jump: s holds the generator's halves h and l, the bucket j jumped to, and for each count its last bucket."""
    h, l = _advance(s["h"], s["l"])
    j = F.floor((s["j"] + 1) * (F.lit(2147483648.0) / (F.shiftright(s["h"], 1) + 1))).cast("long")
    last = [F.when(s["j"] < n, s["j"]).otherwise(s[f"s{k}"]).alias(f"s{k}") for k, n in enumerate(counts)]
    return F.when(s["j"] < max(counts), F.struct(h.alias("h"), l.alias("l"), j.alias("j"), *last)).otherwise(s)


def jump_hash(key: Column, counts: list[int]) -> Column:
    """A struct s0, s1, ... of the bucket of a long key for each bucket count, by one run of jump consistent hashing.

    The jumps of a key for n and n + 1 buckets are the same up to n, so one loop serves all counts. A null key
    counts as 0. The generator's 64-bit products are made from 16-bit limbs, so that ANSI mode never overflows.
    """
    if not counts or min(counts) < 1:
        raise ValueError("bucket counts have to be positive")
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    h, l = _advance(F.shiftrightunsigned(key, 32), key.bitwiseAND(0xFFFFFFFF))
    first = F.struct(
        h.alias("h"), l.alias("l"), F.lit(0).cast("long").alias("j"),
        *[F.lit(0).cast("long").alias(f"s{k}") for k in range(len(counts))],
    )
    run = lambda start, n: F.aggregate(F.sequence(F.lit(1), F.lit(n)), start, lambda s, _: _jump(s, counts))
    short = run(first, min(SHORT, max(counts) + 1))
    if max(counts) < SHORT:
        return short
    # aggregate cannot stop early: the long loop runs only for keys that still jump
    return F.aggregate(F.array(short), first, lambda _, s: F.when(s["j"] < max(counts), run(s, max(counts) + 1 - SHORT)).otherwise(s))


def assign_shards(docs: DataFrame, n_shards: int = 40, key: str = "doc_id", text: str = "text", overhead: int = 16, rows_per_block: int = 200_000) -> DataFrame:
    """Put every row into one of n_shards shards by its key, with a gapless slot in the shard.

    Returns (key, size, text_crc32, law, shard, slot, grown_shard): size is the text's UTF-8 bytes plus
    `overhead` (a null text has none, and a null crc), law is 'key', grown_shard the shard under one more shard.
    Slots run from 0 in every shard. A null key counts as key 0; repeated rows each get a slot of their own;
    an empty table gives no rows; other columns are not read. The text stays in the scan: only the short rows
    are written and dealt, over blocks of a shard, whose sizes give the slots their offsets, so that neither a
    shard nor a repeated key has to fit one task.
    """
    jumped = jump_hash(F.col(key), [n_shards, n_shards + 1])
    blocks = max(16, min(65_536, int(input_bytes(docs) // 512 // (n_shards * rows_per_block)) + 1))
    rows = docs.select(
        F.col(key),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + overhead).alias("size"),
        F.crc32(F.col(text).cast("binary")).alias("text_crc32"),
        jumped.alias("j"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = rows.select(
        key, "size", "text_crc32", F.col("j.s0").cast("int").alias("shard"), F.col("j.s1").cast("int").alias("grown_shard"),
        F.pmod(F.xxhash64(key, "row"), F.lit(blocks)).cast("int").alias("block"), "row",
    )
    rows = materialize(rows, "shards")
    sizes = rows.groupBy("shard", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("shard", "block").orderBy(key, "text_crc32", "size", "row")
    placed = rows.withColumn("at", F.row_number().over(inside)).join(offsets, ["shard", "block"])
    return placed.select(key, "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("before") + F.col("at") - 1).cast("long").alias("slot"), "grown_shard")

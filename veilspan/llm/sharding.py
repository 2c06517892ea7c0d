"""Shards by jump consistent hashing (Lamping and Veach), in DataFrame functions only.

A key walks through the shard counts at which it would move; the last stop below the wanted count is its
shard. No ring table exists, and one more shard takes over only the keys whose walk stops on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fixed values of the published algorithm: the multiplier of its generator.
MULTIPLIER = 2862933555777941757

#: A walk has about ln(shards) stops; a walk longer than this has probability below 1e-60 for a million shards.
MAX_STOPS = 160

#: Rows that one bucket of the slot numbering aims at.
BUCKET_ROWS = 50_000

_LOW = (1 << 32) - 1


def _next_key(key: Column) -> Column:
    """key * MULTIPLIER + 1 modulo 2**64 without an overflowing multiplication: 32-bit halves, 16-bit limbs."""
    c0, c1 = MULTIPLIER & _LOW, MULTIPLIER >> 32
    low32 = F.lit(_LOW)
    lo, hi = key.bitwiseAND(low32), F.shiftrightunsigned(key, 32)
    t0, t1 = lo.bitwiseAND(F.lit(0xFFFF)) * c0, F.shiftright(lo, 16) * c0
    first = t0 + F.shiftleft(t1.bitwiseAND(F.lit(0xFFFF)), 16) + 1
    cross = (hi.bitwiseAND(F.lit(0xFFFF)) * c0).bitwiseAND(low32) + F.shiftleft((F.shiftright(hi, 16) * c0).bitwiseAND(F.lit(0xFFFF)), 16)
    high = (F.shiftright(first, 32) + F.shiftright(t1, 16) + (lo * c1).bitwiseAND(low32) + cross).bitwiseAND(low32)
    return F.shiftleft(high, 32).bitwiseOR(first.bitwiseAND(low32))


def jump_shards(key: Column, *counts: int) -> list[Column]:
    """For each shard count, the shard of a 64-bit ``key``; one walk serves all counts."""
    top = max(counts)
    zero = F.lit(0).cast("long")
    start = F.struct(key.cast("long").alias("k"), zero.alias("j"), *[F.lit(-1).cast("long").alias(f"b{n}") for n in sorted(set(counts))])

    def step(a, _):
        k = _next_key(a["k"])
        unit = F.lit(float(1 << 31)) / (F.shiftrightunsigned(k, 33) + 1).cast("double")
        j = F.least(F.floor((a["j"] + 1).cast("double") * unit), F.lit(1 << 40).cast("long"))
        stops = [F.when(a["j"] < n, a["j"]).otherwise(a[f"b{n}"]).alias(f"b{n}") for n in sorted(set(counts))]
        return F.when(a["j"] >= top, a).otherwise(F.struct(k.alias("k"), j.alias("j"), *stops))

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(min(top, MAX_STOPS))), start, step)
    return [walked[f"b{n}"].cast("int") for n in counts]


def shard_rows(
    docs: DataFrame,
    n_shards: int,
    key: Column | None = None,
    grow_to: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    slot_buckets: int | None = None,
) -> DataFrame:
    """Assign every row to a shard and a slot.

    ``key`` is a 64-bit key (default: the id; null ids share the key 0). Result: id, size (UTF-8 bytes of the
    text plus 16; null text: 16), text_crc32 (null text: of the empty text), shard, slot (0, 1, ... without
    gaps in each shard) and, with ``grow_to``, the shard under that count. Repeated rows get a slot each;
    rows that agree in id, size and checksum are interchangeable. An empty table gives no rows.

    Slots are numbered in two levels, so that no task holds a shard: rows fall into hash buckets of a shard
    of about BUCKET_ROWS rows, the buckets' counts give each bucket its first slot, and rows are numbered
    inside their bucket. The text is reduced to its size and checksum before anything moves.
    """
    body = F.coalesce(F.col(text_col), F.lit(""))
    walk_key = F.coalesce(key if key is not None else F.col(id_col).cast("long"), F.lit(0).cast("long"))
    shards = jump_shards(walk_key, n_shards, *([grow_to] if grow_to else []))
    rows = docs.select(
        F.col(id_col).alias(id_col),
        (F.octet_length(body) + 16).cast("long").alias("size"),
        F.crc32(body.cast("binary")).cast("long").alias("text_crc32"),
        walk_key.alias("_key"),
        F.struct(*[s.alias(f"s{i}") for i, s in enumerate(shards)]).alias("_s"),
    )
    if slot_buckets is None:
        slot_buckets = max(1, -(-docs.count() // (n_shards * BUCKET_ROWS)))
    rows = rows.select(
        id_col, "size", "text_crc32", F.col("_s.s0").alias("shard"), *([F.col("_s.s1").alias("grown_shard")] if grow_to else []),
        F.pmod(F.xxhash64("_key", "text_crc32", "size"), F.lit(slot_buckets)).cast("int").alias("_bucket"),
    )
    counts = rows.groupBy("shard", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy("shard").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    first = counts.select(F.col("shard").alias("_fs"), F.col("_bucket").alias("_fb"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inside = W.partitionBy("shard", "_bucket").orderBy(F.col(id_col), "text_crc32", "size")
    numbered = rows.withColumn("_k", F.row_number().over(inside))
    out = numbered.join(first, (F.col("shard") == F.col("_fs")) & (F.col("_bucket") == F.col("_fb")))
    return out.select(id_col, "size", "text_crc32", "shard", (F.col("_first") + F.col("_k") - 1).cast("long").alias("slot"), *(["grown_shard"] if grow_to else []))

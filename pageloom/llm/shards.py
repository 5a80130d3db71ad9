"""Rendezvous hashing of stable record keys over weighted shards.

Every (key, shard) pair has a hash u in (0, 1) and the score ``-weight / ln(u)``; a record goes to the
shard that scores highest for its key.  Nothing but the key and the shards decides, so a shard that is
added takes records only into itself, and one that goes gives up only its own, in proportion to the
weights.  All of it is one projection; only numbering the records of a shard moves rows.

Cases: null key - counts as the empty key; equal keys - same shard; null or empty text - size 8, crc32
0; empty table - empty result; other columns of the input - ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# slots are numbered in this many parts of each shard at once
PARTS = 64


def unit_hash(key: Column, salt: str) -> Column:
    """A number in (0, 1) from the first 52 bits of md5(key ':' salt), which other engines have too."""
    digits = F.substring(F.md5(F.concat(key, F.lit(f":{salt}")).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(2**52)


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The shard of a key: 0 to len(weights) - 1.  Of equal scores the lower shard wins."""
    if not weights or min(weights) <= 0:
        raise ValueError("every shard needs a positive weight")
    scores = [
        F.struct((F.lit(-float(w)) / F.log(unit_hash(key, str(i)))).alias("score"), F.lit(-i).alias("shard"))
        for i, w in enumerate(weights)
    ]
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    return (-best["shard"]).cast("int")


def assign_shards(
    docs: DataFrame, weights: list[float], grown: list[float] | None = None, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Records with size, shard, gapless slot in the shard, and the shard under the grown list."""
    name = F.coalesce(F.col(key).cast("string"), F.lit(""))
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    placed = docs.select(
        F.col(key),
        (F.octet_length(body) + 8).cast("bigint").alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous(name, weights).alias("shard"),
        (rendezvous(name, grown) if grown else F.lit(None).cast("int")).alias("grown_shard"),
        F.floor(unit_hash(name, "slot") * PARTS).cast("int").alias("_part"),
    )
    # a shard's rows are numbered part by part, each in its own task, from where the parts before end
    part = Window.partitionBy("shard", "_part")
    counts = placed.groupBy("shard", "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    numbered = placed.withColumn("_at", F.row_number().over(part.orderBy(key, "text_crc32", "size")) - 1)
    return numbered.join(offsets, ["shard", "_part"]).select(
        key, "size", "text_crc32", "law", "shard", (F.col("_from") + F.col("_at")).alias("slot"), "grown_shard"
    )

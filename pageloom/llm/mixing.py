"""Mixing sources to target weights by pivotal dependent rounding.

A source's target over its size is the number of copies that each of its documents deserves.  The whole
part is given; the rest is a probability, held as a mass of words in whole units of 2**-20 word.  Two
documents at a time meet: their masses go, as far as they fit, into one or the other, at random and so
that neither gains on average, until one of them is empty or full, which decides it; the other goes on.
No mass is lost, so a source's words miss its target by less than its last document's size.

Documents meet in chunks of about ``CHUNK`` that a hash of the document chooses, the undecided ones of
``CHUNK`` chunks meet one level up, and so on to a single one, which its own probability decides.
Neither the partitions nor their order matter: the same documents give the same mix again.

Cases: null or empty text - size 0, copies by its own probability, no words taken; null key or source -
values like any other, the null source comes last; equal rows - one unit with a count, in parts of
``CHUNK`` rows; very long texts - counted whole, one unit; a source without words - target 0; empty
table - empty result; other columns - ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.llm.common import mixed, shuffle_parts, stored

WEIGHTS = (5, 2, 1)
# a source, and so a document, is used this many times at most
MOST = 3
# documents that meet in one task's array
CHUNK = 1024
# units of a word's mass
UNIT = 1 << 20
# a source's row is repeated for so many parts of its documents, so that no join meets one hot key
SALTS = 32


def n_words(text: str = "text") -> Column:
    """The number of runs of characters outside ``[\\x20\\x09-\\x0D]``."""
    body = F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(body == "", 0).otherwise(F.size(F.split(body, r"[\x20\x09-\x0D]+"))).cast("bigint")


def units(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Distinct documents with their size and how many rows each stands for, in parts of ``CHUNK`` rows."""
    rows = docs.select(
        F.col(key).alias("key"),
        F.col(source).alias("source"),
        n_words(text).alias("size"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"),
    )
    counted = rows.groupBy("key", "source", "size", "text_hash").agg(F.count("*").alias("n"))
    parts = F.transform(
        F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / CHUNK)),
        lambda i: F.struct(i.alias("part"), F.least(F.lit(CHUNK), F.col("n") - i * CHUNK).alias("rows")),
    )
    cut = counted.select("key", "source", "size", "text_hash", F.inline(parts))
    draw = F.xxhash64(F.coalesce(F.col("key").cast("string"), F.lit("")), "text_hash", "size", "part")
    return cut.withColumn("draw", draw)


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """``sizes`` (source, source_size, ...) with the source's place, weight and target.

    Sources above ``most`` times their size stop there and the others share the rest by weight, again and
    again until none is above; a round is one aggregate of all sources.
    """
    spark = sizes.sparkSession
    # places by code point: rows go to ranges, ranges are counted, each is numbered from where it starts
    ranged = sizes.repartitionByRange(shuffle_parts(spark), F.col("source").isNull(), F.col("source"))
    ranged = stored(ranged.withColumn("_range", F.spark_partition_id()), "sources")
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    within = Window.partitionBy("_range").orderBy(F.col("source").isNull(), F.col("source"))
    placed = ranged.withColumn("_at", F.row_number().over(within) - 1).join(starts, "_range")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    placed = placed.select(*sizes.columns, (F.col("_from") + F.col("_at")).alias("place"))
    placed = stored(placed.withColumn("weight", F.get(cycle, (F.col("place") % len(weights)).cast("int"))), "placed")
    bound = F.col("source_size") * F.lit(most).cast("double")
    total = placed.agg(F.sum("source_size")).first()[0] or 0
    # the level is what one unit of weight gets; it only rises, so a source that stopped stays stopped
    open_, level, n_stopped = F.lit(True), 0.0, -1
    while True:
        held = placed.agg(
            F.sum(F.when(open_, F.col("weight"))), F.sum(F.when(~open_, bound)), F.count(F.when(~open_, 1))
        ).first()
        if not held[0] or held[2] == n_stopped:
            break
        n_stopped, level = held[2], (total - (held[1] or 0.0)) / held[0]
        open_ = F.col("weight") * F.lit(level) <= bound
    return placed.withColumn("target", F.when(open_, F.col("weight") * F.lit(level)).otherwise(bound))


def _meet(draw: np.ndarray, size: np.ndarray, mass: np.ndarray) -> tuple[np.ndarray, int]:
    """Units in order meet pairwise, round by round: (mass of each in the end, the undecided one or -1)."""
    mass = mass.copy()
    undecided = np.flatnonzero((mass > 0) & (mass < size))
    turn = 0
    while len(undecided) > 1:
        turn += 1
        odd = undecided[len(undecided) & ~1 :]
        a, b = undecided[0 : len(undecided) & ~1 : 2], undecided[1::2]
        both = mass[a] + mass[b]
        a_up, b_up = np.minimum(size[a], both), np.minimum(size[b], both)
        gain, loss = a_up - mass[a], mass[a] - (both - b_up)
        shuffled = mixed(mixed(draw[a].view(np.uint64) + np.uint64(turn)) ^ draw[b].view(np.uint64))
        rises = (shuffled >> np.uint64(11)) * 2.0**-53 < loss / (gain + loss)
        mass[a] = np.where(rises, a_up, both - b_up)
        mass[b] = both - mass[a]
        left = np.concatenate([np.stack([a, b], 1).ravel(), odd])
        undecided = left[(mass[left] > 0) & (mass[left] < size[left])]
    return mass, int(undecided[0]) if len(undecided) else -1


def _round_chunk(chunk: pa.Table) -> pa.Table:
    chunk = chunk.sort_by([("draw", "ascending"), ("key", "ascending"), ("size", "ascending"), ("part", "ascending")])
    draw, size, mass = (chunk[c].to_numpy() for c in ("draw", "limit", "mass"))
    mass, left = _meet(draw, size, mass)
    decided = np.ones(len(mass), bool)
    if left >= 0:
        decided[left] = False
    put = {"mass": pa.array(mass), "decided": pa.array(decided)}
    for name, values in put.items():
        chunk = chunk.set_column(chunk.schema.get_field_index(name), name, values)
    return chunk


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    most: float = MOST,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """A row per document: key, source, size, text_hash, source_size, target, copies, taken."""
    spark = docs.sparkSession
    kept = stored(units(docs, key, text, source), "units")
    sizes = kept.groupBy("source").agg(
        F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.count("*").alias("n_units")
    )
    wanted = targets(sizes, weights, most)
    most_units = wanted.agg(F.max("n_units")).first()[0] or 0
    chunks = F.greatest(F.ceil(F.col("n_units") / CHUNK), F.lit(1))
    salts = wanted.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed("source", "_source")
    rows = kept.withColumn("_salt", F.pmod(F.shiftrightunsigned("draw", 8), F.lit(SALTS)).cast("int"))
    rows = rows.join(salts, rows["source"].eqNullSafe(salts["_source"]) & (rows["_salt"] == salts["_salt"]))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.select(
        "key", "source", "size", "text_hash", "part", "rows", "draw", "place", "source_size", "target",
        F.floor(rate).alias("base"),
        ((rate - F.floor(rate)) * F.col("rows")).alias("_more"),
        F.pmod(F.xxhash64("draw"), chunks).alias("chunk"),
    )
    # of equal rows, all but one get a whole number of further copies; the last one's share is undecided
    rest = F.col("_more") - F.floor("_more")
    no_words = (F.shiftrightunsigned(F.xxhash64("draw", F.lit(1)), 11) * F.lit(2.0**-53)) < rest
    limit = F.greatest(F.col("size"), F.lit(1)) * F.lit(UNIT)
    mass = F.when(F.col("size") == 0, F.when(no_words, limit).otherwise(0)).otherwise(F.round(rest * limit))
    level = rows.select(
        *[c for c in rows.columns if c != "_more"],
        F.floor("_more").alias("whole"),
        limit.cast("bigint").alias("limit"),
        mass.cast("bigint").alias("mass"),
        F.lit(False).alias("decided"),
    )
    done = []
    while True:
        met = level.groupBy("place", "chunk").applyInArrow(_round_chunk, level.schema)
        met = stored(met, "met")
        done.append(met.where("decided"))
        if most_units <= CHUNK:
            break
        most_units = -(-most_units // CHUNK)
        level = met.where(~F.col("decided")).withColumn("chunk", F.floor(F.col("chunk") / CHUNK))
    last = (F.shiftrightunsigned(F.xxhash64("draw", F.lit(2)), 11) * F.lit(2.0**-53)) < F.col("mass") / F.col("limit")
    done.append(met.where(~F.col("decided")).withColumn("mass", F.when(last, F.col("limit")).otherwise(0)))
    settled = done[0]
    for more in done[1:]:
        settled = settled.unionByName(more)
    further = F.col("whole") + (F.col("mass") == F.col("limit")).cast("bigint")
    each = settled.select(
        "key", "source", "size", "text_hash", "source_size", "target", "base", further.alias("_further"),
        F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("rows"))).alias("_i"),
    )
    copies = F.col("base") + (F.col("_i") <= F.col("_further")).cast("bigint")
    return each.select(
        F.col("key").alias(key), F.col("source").alias(source), "size", "text_hash", "source_size", "target",
        copies.alias("copies"), (copies * F.col("size")).alias("taken"),
    )


def take(docs: DataFrame, plan: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself: every document of ``docs`` as often as ``plan`` (from ``mix``) says.

    Documents of equal key, source and text count as one, with the copies of all of them.
    """
    total = plan.groupBy(F.col(key).alias("_key"), F.col(source).alias("_source"), F.col("text_hash").alias("_hash")).agg(
        F.sum("copies").cast("int").alias("_copies")
    )
    total = total.where("_copies > 0")
    own = docs.withColumn("_own", F.xxhash64(F.coalesce(F.col(text), F.lit("")))).dropDuplicates([key, source, "_own"])
    same = own[key].eqNullSafe(total["_key"]) & own[source].eqNullSafe(total["_source"]) & (own["_own"] == total["_hash"])
    found = own.join(total, same).withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return found.select(*docs.columns)

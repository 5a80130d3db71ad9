"""Stored page copies: freshness, upsert, and what still has to be fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_fresh(now_ms: int | Column, stored_ms: Column, ttl_ms: int) -> Column:
    """Strictly younger than the time to live; with 0 nothing is ever fresh."""
    now = F.lit(now_ms) if isinstance(now_ms, int) else now_ms
    return F.coalesce(now - stored_ms < ttl_ms, F.lit(False))


def latest(snapshots: DataFrame, key: str = "url", at: str = "stored_at") -> DataFrame:
    """The newest copy of every URL; one without a time is older than any other.

    Of equally old copies the one with the greatest columns counts.
    """
    others = [c for c in snapshots.columns if c != key]
    newest = snapshots.groupBy(key).agg(F.max_by(F.struct(*others), _age_order(snapshots, others, at)).alias("_row"))
    return newest.select(key, *[F.col(f"_row.{c}").alias(c) for c in others]).select(*snapshots.columns)


def _age_order(snapshots: DataFrame, others: list[str], at: str) -> Column:
    """Time first (none is before all), then a digest of the row, which settles ties alike everywhere."""
    return F.struct(
        F.coalesce(F.unix_micros(at), F.lit(-(1 << 62))).alias("at"), F.xxhash64(*[c for c in others if c != at]).alias("row")
    )


def upsert(
    base: DataFrame, incoming: DataFrame, key: str = "url", at: str = "stored_at"
) -> DataFrame:
    """``base`` with ``incoming`` applied: the newest copy per URL wins, incoming wins ties.

    ``base`` has one row per URL.  Which side wins is settled on URL and age alone;
    page bodies of ``base`` are read once and, when the batch is small enough to be
    broadcast, not moved at all.
    """
    newest = latest(incoming, key, at)
    rivals = base.select(key, at).join(newest.select(key), key, "left_semi")
    seen = rivals.groupBy(key).agg(F.max(at).alias("_seen"))
    won = (
        newest.join(seen, key, "left")
        .where(F.col("_seen").isNull() | F.coalesce(F.col(at) >= F.col("_seen"), F.lit(False)))
        .select(*base.columns)
    )
    return base.join(won.select(key), key, "left_anti").unionByName(won)


def split_wanted(
    wanted: DataFrame, snapshots: DataFrame, now_ms: int | Column, ttl_ms: int
) -> tuple[DataFrame, DataFrame]:
    """(served from a fresh copy, still to fetch); ``wanted`` columns are kept.

    URLs compare as plain strings.  Only URL and age of the copies are read.
    """
    fresh = snapshots.where(is_fresh(now_ms, F.unix_millis("stored_at"), ttl_ms)).select("url").distinct()
    return wanted.join(fresh, "url", "left_semi"), wanted.join(fresh, "url", "left_anti")


def serve(wanted: DataFrame, snapshots: DataFrame, now_ms: int | Column, ttl_ms: int) -> DataFrame:
    """Wanted URLs with the page their fresh copy holds, marked as from the cache."""
    fresh = snapshots.where(is_fresh(now_ms, F.unix_millis("stored_at"), ttl_ms))
    return wanted.join(
        fresh.select(
            "url", F.col("body").alias("html"), "final_url", F.col("stored_at").alias("fetched_at")
        ),
        "url",
    ).withColumn("from_cache", F.lit(True))

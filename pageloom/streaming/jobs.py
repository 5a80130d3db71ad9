"""Incremental forms: extraction, snapshot upkeep and cache hits on streams."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pageloom.operators.hits import request_hits
from pageloom.operators.scan import HOT_ROWS
from pageloom.session import checkpoint
from pageloom.site import Site
from pageloom.sources.store import SnapshotStore

STATE_DDL = "url string, last_fetch bigint"


def stream_pages(spark: SparkSession, path: str, ddl: str, files_per_trigger: int = 1000) -> DataFrame:
    """New page files as they appear."""
    return spark.readStream.schema(ddl).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def start_extraction(
    site: Site,
    resource: str,
    path: str,
    checkpoint_path: str,
    keep: Iterable[str] = ("url",),
    **trigger: Any,
) -> StreamingQuery:
    """Extract a resource from every arriving page; the plan is the batch plan."""
    rows = site.over_pages(resource, keep)
    writer = rows.writeStream.outputMode("append").format("parquet")
    return writer.option("checkpointLocation", checkpoint_path).trigger(**trigger).start(path)


def start_snapshots(
    copies: DataFrame, path: str, checkpoint_path: str, merge_every: int = 8, **trigger: Any
) -> StreamingQuery:
    """Keep a :class:`SnapshotStore` up to date: each batch is a generation, merged as the store says."""

    def absorb(batch: DataFrame, number: int) -> None:
        SnapshotStore(batch.sparkSession, path, merge_every).append(batch, number)

    writer = copies.writeStream.foreachBatch(absorb).option("checkpointLocation", checkpoint_path)
    return writer.trigger(**trigger).start()


def start_hits(
    requests: DataFrame,
    ttl_ms: int,
    path: str,
    checkpoint_path: str,
    keep_ms: int = 86_400_000,
    hot_rows: int = HOT_ROWS,
    merge_every: int = 8,
    buckets: int = 64,
    **trigger: Any,
) -> StreamingQuery:
    """Cache hits of a request stream, batch by batch, with hot URLs spread over the cluster.

    Every request is in the output, however late: one that comes after its batch's time
    is judged against the last fetch known by then; one without a time is never a hit and
    leaves no fetch behind.  A request inside the period of a known fetch is a hit; the
    others start afresh and go through the batch operator.

    Writes ``path/hits/batch=<n>`` and, as state, ``path/state/delta/<n>`` with the URLs that
    this batch fetched.  Every ``merge_every`` batches (a number to keep for a path's
    life) the deltas go into ``path/state/base/<n>``, in ``buckets`` folders by a hash of the
    URL; there, fetches more than ``keep_ms`` older than the newest and past their period
    are forgotten.  So a batch writes its own size, reads the folders its URLs are in and
    fewer than ``merge_every`` deltas.  A repeated batch reads the same earlier state and
    overwrites its own output.
    """

    def bucket(url: str) -> Column:
        return F.pmod(F.xxhash64(url), F.lit(buckets)).cast("int")

    def state_before(spark: SparkSession, number: int, only: list[int] | None = None) -> DataFrame:
        merged = number // merge_every * merge_every - 1
        parts = [spark.createDataFrame([], STATE_DDL)]
        if merged >= 0:
            base = spark.read.schema(f"{STATE_DDL}, bucket int").parquet(f"{path}/state/base/{merged}")
            parts.append((base if only is None else base.where(F.col("bucket").isin(only))).drop("bucket"))
        deltas = [f"{path}/state/delta/{n}" for n in range(merged + 1, number)]
        if deltas:
            parts.append(spark.read.schema(STATE_DDL).parquet(*deltas))
        state = parts[0]
        for part in parts[1:]:
            state = state.unionByName(part)
        return state

    def newest_fetch(state: DataFrame) -> DataFrame:
        return state.groupBy("url").agg(F.max("last_fetch").alias("last_fetch"))

    def absorb(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = checkpoint(batch.select("url", "request_id", "ts", F.unix_millis("ts").alias("ms")))
        touched = [r[0] for r in rows.select(bucket("url")).distinct().collect()]
        asked = rows.select("url").distinct()
        state = newest_fetch(state_before(spark, number, touched).join(asked, "url", "left_semi"))
        known = rows.join(state, "url", "left")
        covered = F.coalesce(F.col("ms") < F.col("last_fetch") + ttl_ms, F.lit(False))
        early = known.where(covered).drop("last_fetch").withColumn("hit", F.lit(True))
        fresh = known.where(~covered).drop("last_fetch")
        marked = request_hits(fresh, ttl_ms, at="ms", hot_rows=hot_rows)
        columns = ["url", "request_id", "ts", "hit"]
        written = f"{path}/hits/batch={number}"
        early.select(*columns).unionByName(marked.select(*columns)).write.mode("overwrite").parquet(written)

        # the batch's own misses, read back from what was just written
        fetched = spark.read.parquet(written).where(~F.col("hit") & F.col("ts").isNotNull())
        changed = newest_fetch(fetched.select("url", F.unix_millis("ts").alias("last_fetch")))
        changed.write.mode("overwrite").parquet(f"{path}/state/delta/{number}")
        if (number + 1) % merge_every == 0:
            merge(spark, number)

    def merge(spark: SparkSession, number: int) -> None:
        before = state_before(spark, number).unionByName(spark.read.schema(STATE_DDL).parquet(f"{path}/state/delta/{number}"))
        newest = before.agg(F.max("last_fetch")).first()[0]
        whole = newest_fetch(before)
        if newest is not None:
            whole = whole.where(F.col("last_fetch") + ttl_ms > newest - keep_ms)
        dealt = whole.withColumn("bucket", bucket("url")).repartition(buckets, "bucket")
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/state/base/{number}")

    writer = requests.writeStream.foreachBatch(absorb).option("checkpointLocation", checkpoint_path)
    return writer.trigger(**trigger).start()

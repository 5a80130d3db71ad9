"""Which requests a cache with a time to live would have answered.

A request is a hit while it comes less than ``ttl`` after the last fetch of its
URL; a miss fetches and starts a new period.  Whether a request is a miss depends
on the previous miss, so this is a fold over each URL's requests in time order.
A request without a time is never a hit, and its fetch starts no period.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pageloom.operators.scan import HOT_ROWS, ordered_chunks, split_hot
from pageloom.session import checkpoint

# stands for no time while rows are folded; before all times
NO_TIME = -(1 << 63)


def fold_hits(times: np.ndarray, last: float | None, ttl: int) -> tuple[np.ndarray, float | None]:
    """Hits for ascending ``times`` given the last fetch; also the new last fetch.

    Jumps from miss to miss, so it costs the number of misses.
    """
    hits = np.ones(len(times), dtype=bool)
    i = 0 if last is None else int(np.searchsorted(times, last + ttl, side="left"))
    while i < len(times):
        hits[i] = False
        last = int(times[i])
        i = max(i + 1, int(np.searchsorted(times, last + ttl, side="left")))
    return hits, last


def request_hits(
    requests: DataFrame,
    ttl: int,
    key: str = "url",
    at: str = "ts",
    tie: str = "request_id",
    hot_rows: int = HOT_ROWS,
    chunks: int | None = None,
) -> DataFrame:
    """Add ``hit``; ``at`` is a whole number in the unit of ``ttl``, ``tie`` orders equal times.

    Ordinary URLs are folded in one pass over sorted partitions, holding only the
    last fetch between Arrow batches.  URLs with more than ``hot_rows`` requests are
    resolved in parallel by following "next possible miss" pointers with doubling.
    """
    kind = dict(requests.dtypes)[at]
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{at} must be a whole number, not {kind}")
    if ttl <= 0:
        return requests.withColumn("hit", F.lit(False))
    cold, hot = split_hot(requests, [key], hot_rows)
    result = _fold(cold, ttl, key, at, tie)
    if hot is None:
        return result
    return result.unionByName(_pointers(hot, ttl, key, at, tie, chunks))


def _fold(requests: DataFrame, ttl: int, key: str, at: str, tie: str) -> DataFrame:
    n_columns = len(requests.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, last = None, None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            hits = np.zeros(batch.num_rows, dtype=bool)
            keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
            times = batch.column(n_columns).to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            bounds = [0, *edges.tolist(), batch.num_rows]
            for start, stop in zip(bounds, bounds[1:]):
                if keys[start] != current:
                    current, last = keys[start], None
                timed = start + int(np.searchsorted(times[start:stop], NO_TIME, side="right"))
                hits[timed:stop], last = fold_hits(times[timed:stop], last, ttl)
            columns = [batch.column(i) for i in range(n_columns)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(hits)], names=[*batch.schema.names[:n_columns], "hit"])

    # Columns go through as Arrow arrays, so whole numbers stay exact beside nulls.
    timed = requests.withColumn("_time", F.coalesce(F.col(at).cast("bigint"), F.lit(NO_TIME)))
    # By a hash of the key, not the key: a plain repartition is dropped where the plan
    # below is already partitioned by the key, and the adaptive planner may then read
    # that shuffle locally, since a Python operator does not ask for a distribution.
    own_shuffle = timed.repartition(F.xxhash64(key))
    sorted_rows = own_shuffle.sortWithinPartitions(key, "_time", tie)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema)
    return sorted_rows.mapInArrow(run, f"{fields}, hit boolean")


def _next_at_or_after(points: DataFrame, ttl: int, chunks: int | None) -> DataFrame:
    """``k, t, nxt``: for each point the first point of its key at or after ``t + ttl``."""
    data = points.select("k", F.col("t").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("bigint").alias("t"))
    asks = points.select("k", (F.col("t") + ttl).alias("at"), F.lit(0).alias("kind"), "t")
    chunked = ordered_chunks(data.unionByName(asks), ["k"], ["at", "kind"], chunks)
    found = F.when(F.col("kind") == 1, F.col("at"))
    # backwards with growing frames: frames that shrink are recomputed for every row
    backwards = W.partitionBy("k", "_chunk").orderBy(F.desc("at"), F.desc("kind"))
    ahead = backwards.rowsBetween(W.unboundedPreceding, 0)
    later = W.partitionBy("k").orderBy(F.desc("_chunk")).rowsBetween(W.unboundedPreceding, -1)
    firsts = chunked.groupBy("k", "_chunk").agg(F.min(found).alias("_first"))
    beyond = firsts.select("k", "_chunk", F.min("_first").over(later).alias("_beyond"))
    local = chunked.withColumn("_near", F.last(found, ignorenulls=True).over(ahead))
    return (
        local.where("kind = 0")
        .join(beyond, ["k", "_chunk"])
        .select("k", "t", F.coalesce("_near", "_beyond").alias("nxt"))
        .where("nxt is not null")
    )


def _pointers(
    requests: DataFrame, ttl: int, key: str, at: str, tie: str, chunks: int | None
) -> DataFrame:
    points = requests.where(F.col(at).isNotNull()).groupBy(F.col(key).alias("k"), F.col(at).cast("bigint").alias("t")).agg(
        F.min(tie).alias("first_tie")
    )
    points = checkpoint(points)
    misses = checkpoint(points.groupBy("k").agg(F.min("t").alias("t")))
    jump = checkpoint(_next_at_or_after(points.select("k", "t"), ttl, chunks))
    # after round n all misses at chain positions below 2**n are known
    while not jump.isEmpty():
        landed = misses.join(jump, ["k", "t"]).select("k", F.col("nxt").alias("t"))
        misses = checkpoint(misses.unionByName(landed).distinct())
        onward = jump.select("k", F.col("t").alias("nxt"), F.col("nxt").alias("far"))
        jump = checkpoint(jump.join(onward, ["k", "nxt"]).select("k", "t", F.col("far").alias("nxt")))
    fetches = misses.join(points, ["k", "t"]).select(
        F.col("k").alias(key), F.col("t").alias(at), F.col("first_tie").alias(tie), F.lit(False).alias("_hit")
    )
    marked = requests.join(fetches, [key, at, tie], "left")
    return marked.withColumn("hit", F.coalesce("_hit", F.col(at).isNotNull())).drop("_hit").select(*requests.columns, "hit")

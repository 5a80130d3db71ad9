"""Polite send times: every origin sends at most one request per interval."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pageloom.operators.scan import HOT_ROWS, ordered_chunks, split_hot


def interval_ms(requests_per_second: float, crawl_delay: Column) -> Column:
    """The larger of the rate limit's interval and the origin's crawl delay."""
    base = 1000.0 / max(requests_per_second, 0.001)
    return F.greatest(F.lit(base), F.coalesce(crawl_delay, F.lit(0.0)) * 1000.0)


def send_schedule(
    requests: DataFrame,
    keys: Sequence[str] = ("origin",),
    arrive: str = "arrive_ms",
    tie: Sequence[str] = ("request_id",),
    interval: str = "interval_ms",
    hot_rows: int = HOT_ROWS,
    chunks: int | None = None,
) -> DataFrame:
    """Add ``send_ms``: the arrival, or one interval after the origin's previous send.

    With row number r in arrival order, send = r*I + max over rows so far of
    (arrive - r*I).  Ordinary origins take one window.  An origin with more than
    ``hot_rows`` requests is cut into ordered chunks instead; row counts and running
    maxima then cross chunks through one summary row each.
    """
    cold, hot = split_hot(requests, keys, hot_rows)
    result = _one_window(cold, keys, arrive, tie, interval)
    if hot is None:
        return result
    return result.unionByName(_chunked(hot, keys, arrive, tie, interval, chunks))


def _slack(arrive: str, interval: str) -> Column:
    return F.col(arrive) - F.col("_rn") * F.col(interval)


def _one_window(df: DataFrame, keys, arrive: str, tie, interval: str) -> DataFrame:
    ordered = W.partitionBy(*keys).orderBy(arrive, *tie)
    running = ordered.rowsBetween(W.unboundedPreceding, 0)
    return (
        df.withColumn("_rn", F.row_number().over(ordered))
        .withColumn("_best", F.max(_slack(arrive, interval)).over(running))
        .withColumn("send_ms", F.col("_rn") * F.col(interval) + F.col("_best"))
        .drop("_rn", "_best")
    )


def _chunked(df: DataFrame, keys, arrive: str, tie, interval: str, chunks: int | None) -> DataFrame:
    keys = list(keys)
    chunked = ordered_chunks(df, keys, [arrive, *tie], chunks)
    before = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    local = W.partitionBy(*keys, "_chunk").orderBy(arrive, *tie)

    counts = chunked.groupBy(*keys, "_chunk").agg(F.count("*").alias("_n"))
    offsets = counts.select(*keys, "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    numbered = (
        chunked.join(offsets, [*keys, "_chunk"])
        .withColumn("_rn", F.col("_offset") + F.row_number().over(local))
        .withColumn("_slack", _slack(arrive, interval))
    )
    peaks = numbered.groupBy(*keys, "_chunk").agg(F.max("_slack").alias("_peak"))
    earlier = peaks.select(*keys, "_chunk", F.max("_peak").over(before).alias("_earlier"))
    running = F.max("_slack").over(local.rowsBetween(W.unboundedPreceding, 0))
    return (
        numbered.withColumn("_running", running)
        .join(earlier, [*keys, "_chunk"])
        .withColumn(
            "send_ms",
            # greatest() skips nulls: the first chunk has no earlier peak
            F.col("_rn") * F.col(interval) + F.greatest("_running", "_earlier"),
        )
        .select(*df.columns, "send_ms")
    )

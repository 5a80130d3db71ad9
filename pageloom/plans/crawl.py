"""The crawl plan: what to do with every wanted URL, in one DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.functions import urls
from pageloom.functions.names import token_of
from pageloom.operators import robots as rb
from pageloom.operators.hits import request_hits
from pageloom.operators.scan import HOT_ROWS
from pageloom.operators.schedule import interval_ms, send_schedule
from pageloom.session import checkpoint
from pageloom.spec import Politeness

CACHED, BLOCKED, INVALID, SEND = "cached", "blocked", "invalid", "send"


def crawl_plan(
    wanted: DataFrame,
    snapshots: DataFrame,
    robots: DataFrame,
    politeness: Politeness,
    now_ms: int,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """``request_id, url, arrive_ms, origin, action, send_ms`` for every wanted URL.

    One clock: a request arrives ``arrive_ms`` (0 or more, whole) after ``now_ms``.  In
    order of arrival, each request of a URL is ``cached`` while the last fetch, first
    the stored copy, is younger than the time to live.  Else it is ``invalid`` when the
    URL has no web form, ``blocked`` when robots rules forbid it, and otherwise sent, at
    ``send_ms``, which starts a new period.  Only real fetches take a slot of their
    origin.  A null URL is invalid.
    """
    token = token_of(politeness.user_agent)
    ttl = politeness.cache_ttl_ms
    stored = snapshots.groupBy("url").agg((F.max(F.unix_millis("stored_at")) - now_ms).alias("_stored"))
    # partial results travel, not the requests, so a URL asked for very often is cheap
    per_url = wanted.where("url is not null").groupBy("url").agg(F.lit(True).alias("_known")).join(stored, "url", "left")
    if politeness.respect_robots:
        per_url = rb.admit(per_url, rb.rulesets(rb.parse_robots(robots), token))
    else:
        per_url = per_url.select(
            "*",
            urls.origin(urls.normal(F.col("url"))).alias("origin"),
            urls.normal(F.col("url")).isNotNull().alias("allowed"),
            F.lit(None).cast("double").alias("crawl_delay"),
        )
    # an exchange of its own lets the skew join split a URL asked for very often
    parts = int(wanted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    facts = per_url.repartition(parts, F.xxhash64("url"))
    known = checkpoint(
        wanted.join(facts, "url", "left").select(
            *wanted.columns, "origin", "_stored", F.coalesce("allowed", F.lit(False)).alias("_allowed"),
            interval_ms(politeness.requests_per_second, F.col("crawl_delay")).alias("interval_ms"),
            F.monotonically_increasing_id().alias("_row"),
        )
    )
    # fetches happen only where they are allowed: there, fold over copies and requests
    allowed = known.where("_allowed")
    copies = allowed.where("_stored is not null").groupBy("url").agg(F.least(F.min("_stored"), F.lit(0)).alias("arrive_ms"))
    # ids may be null or repeated, so rows have a number; equal times go in order of id, copies first
    ordinal = F.lpad(F.hex(F.col("request_id").cast("bigint").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    tie = F.concat(F.coalesce(ordinal, F.lit("")), F.lit("-"), F.lpad(F.hex("_row"), 16, "0"))
    # everything a request needs later goes through the fold with it
    columns = [*wanted.columns, "origin", "interval_ms"]
    log = allowed.select(*columns, tie.alias("_tie"), F.lit(False).alias("_copy")).unionByName(
        copies.select("url", "arrive_ms", F.lit("").alias("_tie"), F.lit(True).alias("_copy")), allowMissingColumns=True
    )
    marked = request_hits(log, ttl, at="arrive_ms", tie="_tie", hot_rows=hot_rows).where("not _copy")
    fetched = marked.withColumn("action", F.when(F.col("hit"), F.lit(CACHED)).otherwise(F.lit(SEND)))
    served = F.coalesce(F.col("arrive_ms") - F.col("_stored") < ttl, F.lit(False))
    barred = known.where("not _allowed").withColumn(
        "action",
        F.when(served, F.lit(CACHED)).when(F.col("origin").isNull(), F.lit(INVALID)).otherwise(F.lit(BLOCKED)),
    )
    columns = [*wanted.columns, "origin", "action", "interval_ms"]
    # read three times below (group sizes, sends, the rest): decide once
    decided = checkpoint(fetched.select(*columns).unionByName(barred.select(*columns)))
    columns = [*wanted.columns, "origin", "action", "send_ms"]
    scheduled = send_schedule(decided.where(F.col("action") == SEND), hot_rows=hot_rows).select(*columns)
    others = decided.where(F.col("action") != SEND).withColumn("send_ms", F.lit(None).cast("double"))
    return scheduled.unionByName(others.select(*columns))

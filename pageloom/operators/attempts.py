"""Outcomes of fetch attempts, from a log of all of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Outcomes, and the wait before the first retry.
OK, HTTP_ERROR, ROBOTS = "ok", "http-error", "robots-disallowed"
TIMEOUT, NETWORK_ERROR = "timeout", "network-error"
BACKOFF_MS = 250
# Room for a response code next to an attempt number.
SLOTS = 10_000


def is_retryable(status: Column) -> Column:
    """No response, or a server error."""
    return status.isNull() | (status >= 500)


def http_status(outcome: Column) -> Column:
    """What a caller is told: 200, 403 for robots, 502 for every other failure."""
    return F.when(outcome == OK, F.lit(200)).when(outcome == ROBOTS, F.lit(403)).otherwise(F.lit(502))


def resolve_attempts(
    attempts: DataFrame, max_retries: int, keys: Sequence[str] = ("url",)
) -> DataFrame:
    """``keys, outcome, status, attempts, wait_ms, http_status``, one row per key.

    The first final response decides; without one, the last attempt allowed does.
    Attempt and response travel as one number, so this is a single hash aggregate
    with partial results on the map side, and no window.
    """
    allowed = attempts.where(F.col("attempt") <= max_retries)
    status = F.col("status")
    response = F.when(status.isNotNull(), status).when(F.col("error") == TIMEOUT, F.lit(1)).otherwise(F.lit(2))
    packed = F.col("attempt").cast("bigint") * SLOTS + response
    decided = allowed.groupBy(*keys).agg(
        F.coalesce(F.min(F.when(~is_retryable(status), packed)), F.max(packed)).alias("_last")
    )
    used = (F.col("_last") / SLOTS).cast("int")
    code = (F.col("_last") % SLOTS).cast("int")
    outcome = (
        F.when(code == 1, F.lit(TIMEOUT))
        .when(code == 2, F.lit(NETWORK_ERROR))
        .when(code.between(200, 299), F.lit(OK))
        .otherwise(F.lit(HTTP_ERROR))
    )
    return decided.select(
        *keys,
        outcome.alias("outcome"),
        F.when(code > 2, code).alias("status"),
        (used + 1).alias("attempts"),
        # 250 + 500 + 1000 ... before each attempt after the first
        (BACKOFF_MS * (F.pow(F.lit(2.0), used) - 1)).cast("bigint").alias("wait_ms"),
        http_status(outcome).alias("http_status"),
    )

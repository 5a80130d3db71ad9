"""Ordered work on groups of any size.

A window over one very large group runs in one task.  These helpers single out
such groups and cut them into ordered chunks, so that the heavy part is spread
over the cluster and only one summary row per chunk is combined in order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.session import checkpoint

# Groups up to this size are left to one window task, which sorts and spills.
HOT_ROWS = 5_000_000


def split_hot(df: DataFrame, keys: Sequence[str], limit: int) -> tuple[DataFrame, DataFrame | None]:
    """(ordinary rows, rows of groups above ``limit`` or None).

    Counting is map-side combined; at most rows/limit groups can be hot.
    """
    hot_keys = checkpoint(df.groupBy(*keys).count().where(F.col("count") > limit).select(*keys))
    if hot_keys.isEmpty():
        return df, None
    return df.join(hot_keys, list(keys), "left_anti"), df.join(hot_keys, list(keys), "left_semi")


def ordered_chunks(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], chunks: int | None = None
) -> DataFrame:
    """Add ``_chunk``: consecutive ranges of (keys, order), of about equal size.

    Checkpointed, so that the chunk of a row stays the same in every later use.
    """
    if chunks is None:
        chunks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(chunks, *keys, *order)
    return checkpoint(ranged.withColumn("_chunk", F.spark_partition_id()))

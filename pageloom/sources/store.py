"""A snapshot store: page bodies in files that are written once, and a narrow index of what is in them.

Every batch is a generation.  Its bodies are written as they come, without an exchange; of each,
the index keeps URL, time, digest, and the file and row it is in.  Which copy of a URL counts is
settled on the index alone, and bodies are read only from files that hold one that does: files of
nothing else as they are, the others joined with the rows that count.

    path/bodies/<folder>         url, final_url, body, stored_at, digest
    path/index/delta/<n>         url, at, digest, folder, file, row, total: one row per copy of a generation
    path/index/base/<n>          the rows that counted when generation n was merged, in folders by URL
    path/log                     generation, base: one row for each finished generation

Every ``merge_every`` generations the deltas go into a new base, and the copies that count move out of
files where more than half of the rows no longer do.  So a batch costs its own size, and a read the index
plus what counts.  Copies that lost stay where they are; nothing is removed.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BODY_DDL = "url string, final_url string, body string, stored_at timestamp, digest bigint"
INDEX_DDL = "url string, at bigint, digest bigint, folder string, file string, row bigint, total bigint"
LOG_DDL = "generation bigint, base bigint"
# before all times
NO_TIME = -(1 << 62)


class SnapshotStore:
    """The newest copy of every URL; one without a time is older than any other.

    Of equally old copies the one with the greater digest counts.  A generation that is written
    again replaces itself, as long as none came after it.
    """

    def __init__(self, spark: SparkSession, path: str, merge_every: int = 8, buckets: int = 64) -> None:
        self.spark, self.path, self.merge_every, self.buckets = spark, path, merge_every, buckets

    # -- writing -----------------------------------------------------------------
    def append(self, copies: DataFrame, generation: int | None = None) -> None:
        """Take in copies (``url, final_url, body, stored_at``) as a generation, by default the next."""
        if generation is None:
            generation = self._last()[0] + 1
        base = self._last(before=generation)[1]
        self._put(copies, str(generation)).write.mode("overwrite").parquet(f"{self.path}/index/delta/{generation}")
        if (generation + 1) % self.merge_every == 0:
            self._merge(self._index(generation, base), generation)
            base = generation
        done = self.spark.createDataFrame([(generation, base)], LOG_DDL)
        done.coalesce(1).write.mode("append").parquet(f"{self.path}/log")

    def _put(self, copies: DataFrame, folder: str) -> DataFrame:
        """Write bodies to a folder; the index of what is in it, read from all columns but the bodies."""
        digest = F.xxhash64("final_url", "body").alias("digest")
        kept = copies.select("url", "final_url", "body", "stored_at", digest)
        kept.write.mode("overwrite").parquet(f"{self.path}/bodies/{folder}")
        rows = self.spark.read.schema(BODY_DDL).parquet(f"{self.path}/bodies/{folder}").select(
            "url",
            F.coalesce(F.unix_micros("stored_at"), F.lit(NO_TIME)).alias("at"),
            "digest",
            F.lit(folder).alias("folder"),
            F.col("_metadata.file_name").alias("file"),
            F.col("_metadata.row_index").alias("row"),
        )
        totals = rows.groupBy("file").agg(F.count("*").alias("total"))
        return rows.join(totals, "file").select("url", "at", "digest", "folder", "file", "row", "total")

    def _merge(self, index: DataFrame, generation: int) -> None:
        winners = self.winners(index)
        live = winners.groupBy("file").agg(F.count("*").alias("_live"), F.first("total").alias("_total"))
        sparse = live.where("_live * 2 < _total").select("file")
        moved = self._bodies(winners.join(sparse, "file", "left_semi").select(*index.columns))
        fresh = self._put(moved, f"{generation}-merged")
        base = winners.join(sparse, "file", "left_anti").select(*index.columns).unionByName(fresh)
        bucket = F.pmod(F.xxhash64("url"), F.lit(self.buckets)).cast("int")
        dealt = base.withColumn("bucket", bucket).repartition(self.buckets, "bucket")
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/index/base/{generation}")

    # -- reading -----------------------------------------------------------------
    def _last(self, before: int | None = None) -> tuple[int, int]:
        """(last finished generation, its base); -1 for none."""
        try:
            log = self.spark.read.schema(LOG_DDL).parquet(f"{self.path}/log")
        except AnalysisException as err:
            if err.getCondition() != "PATH_NOT_FOUND":
                raise
            return -1, -1
        if before is not None:
            log = log.where(F.col("generation") < before)
        last = log.agg(F.max(F.struct("generation", "base")).alias("last")).first()["last"]
        return (-1, -1) if last is None else (last.generation, last.base)

    def _index(self, generation: int, base: int, wanted: DataFrame | None = None) -> DataFrame:
        parts = [self.spark.createDataFrame([], INDEX_DDL)]
        if base >= 0:
            merged = self.spark.read.schema(f"{INDEX_DDL}, bucket int").parquet(f"{self.path}/index/base/{base}")
            if wanted is not None:
                # at most ``buckets`` numbers: the folders these URLs can be in
                bucket = F.pmod(F.xxhash64("url"), F.lit(self.buckets)).cast("int")
                merged = merged.where(F.col("bucket").isin([r[0] for r in wanted.select(bucket).distinct().collect()]))
            parts.append(merged.drop("bucket"))
        deltas = [f"{self.path}/index/delta/{n}" for n in range(base + 1, generation + 1)]
        if deltas:
            parts.append(self.spark.read.schema(INDEX_DDL).parquet(*deltas))
        rows = reduce(DataFrame.unionByName, parts)
        return rows if wanted is None else rows.join(wanted.select("url").distinct(), "url", "left_semi")

    def index(self, wanted: DataFrame | None = None) -> DataFrame:
        """All copies that may count, of all URLs or those of ``wanted``."""
        return self._index(*self._last(), wanted)

    @staticmethod
    def winners(index: DataFrame) -> DataFrame:
        """The index row of the copy that counts, of each URL."""
        order = [c for c in index.columns if c not in ("url", "total")]
        best = index.groupBy("url").agg(F.max(F.struct(*order, "total")).alias("_best"))
        return best.select("url", "_best.*")

    def ages(self, wanted: DataFrame | None = None) -> DataFrame:
        """``url, stored_at`` of what counts, from the index alone."""
        return self.winners(self.index(wanted)).select("url", _time(F.col("at")).alias("stored_at"))

    def read(
        self, columns: Sequence[str] = ("url", "final_url", "body", "stored_at"), wanted: DataFrame | None = None
    ) -> DataFrame:
        """The copies that count, of all URLs or those of ``wanted``."""
        if set(columns) <= {"url", "stored_at"}:
            return self.ages(wanted).select(*columns)
        return self._bodies(self.winners(self.index(wanted))).select(*columns)

    def _bodies(self, winners: DataFrame) -> DataFrame:
        columns = ["url", "final_url", "body", "stored_at"]
        # names of the files that are going to be read, which the scan's own listing holds as well
        held = winners.groupBy("folder", "file").agg(F.count("*").alias("live"), F.first("total").alias("total")).collect()
        whole = [f"{self.path}/bodies/{r.folder}/{r.file}" for r in held if r.live == r.total]
        mixed = [f"{self.path}/bodies/{r.folder}/{r.file}" for r in held if r.live < r.total]
        found = self.spark.createDataFrame([], BODY_DDL).select(*columns)
        if whole:
            found = found.unionByName(self.spark.read.schema(BODY_DDL).parquet(*whole).select(*columns))
        if mixed:
            rows = self.spark.read.schema(BODY_DDL).parquet(*mixed).select(
                *columns, F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row")
            )
            counted = winners.where(F.col("total") > 0).select("file", "row")
            found = found.unionByName(rows.join(counted, ["file", "row"], "left_semi").select(*columns))
        return found


def _time(at):
    return F.when(at != NO_TIME, F.timestamp_micros(at))

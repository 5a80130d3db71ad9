"""Page tables: Parquet, saved HTML files, stored copies."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# splits of small files that one task reads
SPLITS = 16


def spread(pages: DataFrame, key: str = "url") -> DataFrame:
    """Give every core work when the scan has too few splits, else leave the table alone.

    A large table arrives in far more splits than there are cores, and then nothing
    is shuffled; a few small files would otherwise be parsed by a few tasks.
    """
    cores = pages.sparkSession.sparkContext.defaultParallelism
    if pages.isStreaming or pages.rdd.getNumPartitions() >= cores:
        return pages
    return pages.repartition(cores, key)


def read_pages(spark: SparkSession, path: str, balance: bool = True) -> DataFrame:
    """A Parquet pages table with ``final_url`` filled in."""
    pages = spark.read.parquet(path)
    final = F.coalesce("final_url", "url") if "final_url" in pages.columns else F.col("url")
    pages = pages.withColumn("final_url", final)
    return spread(pages) if balance else pages


def write_html_files(pages: DataFrame, path: str) -> list[str]:
    """Save the html of every row as a file of its own, ended by a line break; returns the folders that hold them.

    Spark's local file system starts a process for each file's rights, several times a file.  So below a
    ``file`` path, which all executors share, tasks write the files themselves, each attempt into a folder of
    its own; only folders of attempts that ended are returned.  Elsewhere Spark's writer does it.
    """
    where = urlsplit(path)
    root = where.path

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder, at = f"{root}/part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}", 0
        for batch in batches:
            os.makedirs(folder, exist_ok=True)
            for html in batch.column("html"):
                with open(f"{folder}/{at:08d}.html", "wb") as file:
                    file.write((html.as_py() or b"") + b"\n")
                at += 1
        if at:
            yield pa.RecordBatch.from_arrays([pa.array([folder])], names=["folder"])

    if where.scheme == "file":
        made = pages.select(F.col("html").cast("binary").alias("html")).mapInArrow(run, "folder string")
        if folders := [f"file:{r.folder}" for r in made.collect()]:
            return folders
    pages.select("html").write.option("maxRecordsPerFile", 1).text(path)
    return [path]


def read_html_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Every file is one page; its URL is its location."""
    files = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("url"),
        F.col("_metadata.file_path").alias("final_url"),
        F.col("value").alias("html"),
        F.col("_metadata.file_modification_time").alias("fetched_at"),
    )
    # a split counts each file as some MB, so that it holds few pages: a task takes several
    few, splits = 4 * spark.sparkContext.defaultParallelism, files.rdd.getNumPartitions()
    return files.coalesce(max(few, -(-splits // SPLITS))) if splits > few else files

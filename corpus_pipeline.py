"""The corpus pipeline: clean, judge, deduplicate, decontaminate and tokenise the documents table.

Every stage works on all rows its predecessor kept, written as Parquet and read again.  All stages but
the last return the columns of ``documents``; the last returns ids of tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pageloom.llm import decontam, groupjoin, quality, toxicity
from pageloom.llm.common import crc_mod, stored, table
from pageloom.llm.queries import byte_bpe


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under 0.5 by the classifier trained on posterior labels."""
    scorer = toxicity.fit(docs, table(spark, sf_dir, "labels"), crc_mod("doc_id", 5) != 0)
    return toxicity.keep_clean(docs, scorer)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the threshold table."""
    return quality.keep_good(docs)


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates."""
    return groupjoin.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item.

    They are stored here, so that the job runs with few texts at a time in a Python process.
    """
    return stored(decontam.drop_leaks(docs, table(spark, sf_dir, "benchmark")), "unleaked", short=True)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, their number, and digests of the ids and of what they decode to.

    The ids are stored before they are decoded, so that a task never keeps two Python processes; these
    get few texts at a time.
    """
    codec = byte_bpe(spark)
    encoded = stored(codec.encode(docs.select("doc_id", "lang", "source", "text")), "ids", short=True)
    return codec.digests(encoded, keep_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", keep_good),
    ("n-gram Jaccard join", keep_one),
    ("benchmark decontamination", drop_leaks),
    ("byte-level BPE", tokenise),
]

# trained classifiers and tokenisers are beyond SQL: tests hold the stages against brute force instead
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

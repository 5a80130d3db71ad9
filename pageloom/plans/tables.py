"""Inputs the registered queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.sources.pages import read_pages, spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A sample table; its zone-less timestamps are read as instants in UTC."""
    path = f"{sf_dir}/{name}.parquet"
    found = spark.read.parquet(path).schema
    zoned = [
        T.StructField(f.name, T.TimestampType() if isinstance(f.dataType, T.TimestampNTZType) else f.dataType)
        for f in found
    ]
    return spark.read.schema(T.StructType(zoned)).parquet(path)


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_pages(spark, f"{sf_dir}/pages.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, spread over the cores where one small file would feed one task."""
    return spread(table(spark, sf_dir, "documents"), "doc_id")


def longs(df: DataFrame) -> DataFrame:
    """Integer columns as bigint, so that types match SQL's."""
    return df.select(
        *[F.col(n).cast("bigint").alias(n) if t in ("int", "smallint") else F.col(n) for n, t in df.dtypes]
    )


# SQL for one value of page HTML: decode the four entities the pages use.  Where a
# title was cut, one may lack its semicolon; it still stands for its character.
def decoded(sql: str) -> str:
    pairs = [("&quot;?", '"'), ("&middot;?", "·"), ("&copy;?", "©"), ("&amp;?", "&")]
    for entity, char in pairs:
        sql = f"regexp_replace({sql}, '{entity}', '{char}', 'g')"
    return sql


def collapsed(sql: str) -> str:
    return f"trim(regexp_replace({sql}, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))"

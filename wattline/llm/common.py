"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wattline.session import scratch_path

#: White space between words: space, tab, line feed, vertical tab, form feed, carriage return.
GAPS = " \t\n\x0b\x0c\r"
GAP_PATTERN = "[\\x20\\x09-\\x0D]+"


def words_of(text: Column) -> Column:
    """The words of a text in order; none for a null or blank text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP_PATTERN), lambda w: w != "")


def stored(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, so that later steps neither recompute it nor lose it with an executor."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def number_from_hash(hexed: Column) -> Column:
    """The first 15 hexadecimal digits of a digest as a long: 60 even bits, the same in SQL."""
    return F.conv(F.substring(hexed, 1, 15), 16, 10).cast("long")


#: Buckets of a filter by hash: it has at most so many rows, whatever it is made from.
FILTER_BUCKETS = 1 << 20


def likely_among(df: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """Rows of ``df`` whose hash bucket occurs among those of ``wanted``; drops most others before a shuffle, and never a wanted row.

    The buckets are broadcast: at most ``FILTER_BUCKETS`` numbers. With very many wanted rows all buckets occur and all rows pass.
    """
    bucket = F.pmod(F.xxhash64(column), F.lit(FILTER_BUCKETS))
    buckets = stored(wanted.select(bucket.alias("_bucket")).distinct(), "hash-buckets")
    return df.withColumn("_bucket", bucket).join(F.broadcast(buckets), "_bucket", "left_semi").drop("_bucket")

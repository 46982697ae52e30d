"""Incremental reads and repeatable appends between stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from wattline.functions.geometry import point_text
from wattline.functions.hashing import name_uuid


def jdbc_table(spark: SparkSession, url: str, table: str, **options) -> DataFrame:
    """A database table; filters and columns are pushed to it, and it is read in parallel when a key range is given."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def incremental(source: DataFrame, target: DataFrame, ts_col: str, keys: list[str]) -> DataFrame:
    """Source rows at or after the target's newest time.

    The bound is inclusive, so rows already copied come again; they are removed by key.
    """
    mark = target.agg(F.max(ts_col)).first()[0]
    fresh = source if mark is None else source.where(F.col(ts_col) >= F.lit(mark))
    edge = target if mark is None else target.where(F.col(ts_col) >= F.lit(mark))
    return fresh.join(edge.select(*keys), keys, "left_anti")


def with_point(df: DataFrame, lat: str = "lat", lon: str = "lon", out: str = "geom_wkt") -> DataFrame:
    return df.withColumn(out, point_text(F.col(lat), F.col(lon)))


def full_refresh(df: DataFrame, *, path: str | None = None, url: str | None = None, table: str | None = None, batch: int = 1000) -> None:
    """Replace the target: a database table (truncated, not dropped) or a Parquet folder."""
    if url is not None:
        df.write.format("jdbc").mode("overwrite").options(url=url, dbtable=table, truncate="true", batchsize=batch).save()
    else:
        df.write.mode("overwrite").parquet(path)


def append_new(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """Source rows whose key is new, one per key; running it twice adds nothing."""
    return source.dropDuplicates([key]).join(target.select(key), key, "left_anti")


def with_uuid_key(df: DataFrame, namespace: str, name_col: str, out: str = "row_id") -> DataFrame:
    return df.withColumn(out, name_uuid(namespace, F.col(name_col)))

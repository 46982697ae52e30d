"""Table changes without in-place updates: every function returns the new version of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wattline.functions.calendar import ts
from wattline.functions.keys import null_safe_join


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Newest row per key.

    A maximum over (order, other columns) structs combines before the shuffle, so a key with any number of versions
    sends one row per task; a ROW_NUMBER window would sort them all in one place.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    newest = df.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_v"))
    return newest.select(*[F.col(c) if c in keys else F.col(f"_v.{c}").alias(c) for c in df.columns])


def upsert(target: DataFrame, source: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """MERGE: ``cols`` of matched rows come from the source, unmatched source rows are added, the rest stays."""
    new = source.select(*keys, F.struct(*[c for c in target.columns if c not in keys]).alias("_n"), F.lit(True).alias("_s"))
    old = target.withColumn("_t", F.lit(True))
    joined = old.join(new, keys, "full_outer")
    out = []
    for c in target.columns:
        if c in keys:
            out.append(F.col(c))
        elif c in cols:
            out.append(F.when(F.col("_s"), F.col(f"_n.{c}")).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.when(F.col("_t"), F.col(c)).otherwise(F.col(f"_n.{c}")).alias(c))
    return joined.select(*out)


def insert_new(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    fresh = source.dropDuplicates([key]).join(target.select(key), key, "left_anti")
    return target.unionByName(fresh.select(*target.columns))


def update_from_agg(target: DataFrame, agg: DataFrame, key: str, col: str) -> DataFrame:
    """Set ``col`` from the aggregate; rows without a match keep their value."""
    new = agg.select(key, F.col(col).alias("_new"))
    return target.join(new, key, "left").withColumn(col, F.coalesce("_new", col)).drop("_new").select(*target.columns)


def backfill(df: DataFrame, col: str, value: Column) -> DataFrame:
    return df.withColumn(col, F.coalesce(F.col(col), value))


def replace_slice(df: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Drop every row of the slices that ``new`` brings, then add ``new``; null names a slice like any other value."""
    slices = new.select(*keys).distinct()
    return null_safe_join(df, slices, keys, "left_anti").select(*df.columns).unionByName(new.select(*df.columns))


def archive(df: DataFrame, reason: str, as_of: str) -> DataFrame:
    return df.withColumns({"archived_at": ts(as_of), "archive_reason": F.lit(reason)})


def swap_tables(spark, live: str, candidate: str, backup: str) -> None:
    """Promote a non-empty candidate: live becomes backup, candidate becomes live."""
    if spark.table(candidate).isEmpty():
        raise ValueError(f"{candidate} is empty; {live} stays")
    spark.sql(f"DROP TABLE IF EXISTS {backup}")
    if spark.catalog.tableExists(live):
        spark.sql(f"ALTER TABLE {live} RENAME TO {backup}")
    spark.sql(f"ALTER TABLE {candidate} RENAME TO {live}")


def job_log(jobs: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Finished syncs of the last days with duration and success share of their table."""
    recent = jobs.where(F.col("started_at") >= ts(as_of) - F.expr(f"interval {days} days"))
    return recent.withColumn("duration_s", F.timestamp_diff("SECOND", F.col("started_at"), F.col("ended_at")))


def changed_keys_refresh(old_result: DataFrame, changes: DataFrame, facts: DataFrame, key: str, rebuild) -> DataFrame:
    """Refresh an aggregate for the keys that changed only; ``rebuild`` maps facts to the result."""
    touched = changes.select(key).distinct()
    fresh = rebuild(facts.join(touched, key, "left_semi"))
    kept = old_result.join(touched, key, "left_anti")
    return kept.select(*fresh.columns).unionByName(fresh)

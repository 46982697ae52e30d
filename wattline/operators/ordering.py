"""Row positions and running sums over sorted data, with no single-task window.

A window without PARTITION BY, or with a hot key, sorts everything in one task.  Here the rows are range-partitioned
by (keys, order), materialised once, numbered inside each range, and shifted by the totals of the ranges before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from wattline.functions.keys import null_safe_join
from wattline.session import cut


def positioned(
    df: DataFrame,
    order: list[Column],
    keys: list[str] | None = None,
    running: dict[str, str] | None = None,
    position: str = "position",
    chunks: int | None = None,
) -> DataFrame:
    """Add a 1-based ``position`` per key group and running sums ``{output: value column}``.

    ``order`` has to end with a unique column: the range partitioner then splits ties and hot keys evenly.
    """
    keys = list(keys or [])
    running = running or {}
    size = [chunks] if chunks else []  # without a number the engine joins small ranges at run time
    by_range = [F.col(k).asc() for k in keys] + order
    # The chunk numbers are read twice below, so they have to be fixed before.
    placed = cut(df.repartitionByRange(*size, *by_range).withColumn("_chunk", F.spark_partition_id()))

    group = keys or [F.lit(0)]
    totals = placed.groupBy(*keys, "_chunk").agg(
        F.count(F.lit(1)).alias("_rows"), *[F.sum(c).alias(f"_sum_{o}") for o, c in running.items()]
    )
    # one row per chunk and key in it: bounded by the number of chunks per key
    before = Window.partitionBy(*group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys,
        "_chunk",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_off"),
        *[F.coalesce(F.sum(f"_sum_{o}").over(before), F.lit(0)).alias(f"_off_{o}") for o in running],
    )
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = placed.withColumns(
        {
            "_pos": F.row_number().over(inside),
            **{f"_run_{o}": F.sum(c).over(upto) for o, c in running.items()},
        }
    )
    joined = null_safe_join(numbered, offsets, [*keys, "_chunk"])
    return joined.select(
        *df.columns,
        (F.col("_off") + F.col("_pos")).cast("bigint").alias(position),
        *[(F.col(f"_off_{o}") + F.col(f"_run_{o}")).alias(o) for o in running],
    )


def tiled(df: DataFrame, order: list[Column], tiles: int, out: str) -> DataFrame:
    """NTILE over the whole table: the first (n mod tiles) tiles get one row more."""
    ranked = positioned(df, order, position="_p")
    n = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    base = F.floor(F.col("_n") / tiles)
    extra = F.col("_n") % tiles
    head = extra * (base + 1)
    small = F.floor((F.col("_p") - head - 1) / F.greatest(base, F.lit(1))) + extra + 1
    big = F.floor((F.col("_p") - 1) / (base + 1)) + 1
    return (
        ranked.withColumn("_n", n)
        .withColumn(out, F.when(F.col("_p") <= head, big).otherwise(small).cast("bigint"))
        .drop("_p", "_n")
    )

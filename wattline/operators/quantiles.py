"""Exact percentiles that never hold a whole group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wattline.functions.keys import null_safe_join
from wattline.operators.ordering import positioned


def exact_percentiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Continuous (interpolated) percentiles per group, one output column per entry of ``probs``.

    Equal values of a group are counted before the shuffle. The (value, count) pairs are range-partitioned with running counts, so a
    group of any size and any distribution is cut into ranges, and the wanted ranks are picked from them. A null key is a group.
    """
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL")
    pairs = rows.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    run = positioned(pairs, [F.col("_v").asc()], keys=keys, running={"_upto": "_c"}, position="_nth")
    # One row per group; the running counts of its pairs meet it by the group's keys.
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    placed = null_safe_join(run, sizes, keys)
    picked = {}
    for name, p in probs.items():
        spot = (F.col("_n") - 1) * F.lit(float(p))
        low, high = F.floor(spot), F.ceil(spot)
        share = spot - low

        def holds(rank):
            return (rank >= F.col("_upto") - F.col("_c")) & (rank < F.col("_upto"))

        weight = F.when(holds(low), 1.0 - share).otherwise(0.0) + F.when(holds(high), share).otherwise(0.0)
        touched = holds(low) | holds(high)
        picked[name] = F.sum(F.when(touched, F.col("_v") * weight)).alias(name)
    return placed.groupBy(*keys).agg(*picked.values())

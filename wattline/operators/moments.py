"""Means and deviations of groups from those of their parts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def moments(value: str) -> list[Column]:
    """Count, mean and sum of squared deviations of a column, which ``merged_moments`` adds up over groups."""
    v = F.col(value)
    return [F.count(v).alias("_n"), F.avg(v).alias("_mean"), (F.var_pop(v) * F.count(v)).alias("_squares")]


def merged_moments() -> tuple[Column, Column]:
    """(mean, sample deviation) of a group from the moments of its parts."""
    n = F.sum("_n")
    total = F.sum(F.col("_n") * F.col("_mean"))
    mean = total / F.nullif(n, F.lit(0))
    squares = F.sum("_squares") + F.sum(F.col("_n") * F.col("_mean") * F.col("_mean")) - total * mean
    return mean, F.sqrt(F.greatest(squares, F.lit(0.0)) / F.nullif(n - 1, F.lit(0)))

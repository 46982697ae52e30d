"""Joins on keys that can be null."""

from __future__ import annotations

from pyspark.sql import DataFrame


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, null being equal to null; the keys of the left side stay."""
    named = right.withColumnsRenamed({k: f"_on_{k}" for k in keys})
    condition = None
    for k in keys:
        same = left[k].eqNullSafe(named[f"_on_{k}"])
        condition = same if condition is None else condition & same
    if condition is None:
        return left.crossJoin(named)  # no keys: the right side is one row
    joined = left.join(named, condition, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"_on_{k}" for k in keys])

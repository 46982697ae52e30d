"""Time anchors and deterministic top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wattline.functions.calendar import ts


def latest(df: DataFrame, col: str) -> Column:
    """Largest value of a column as a scalar subquery; its scan reads that one column only."""
    return df.agg(F.max(col).alias("m")).scalar()


def anchor(df: DataFrame, col: str, as_of: str | None) -> Column:
    return latest(df, col) if as_of is None else ts(as_of)


def recent(df: DataFrame, col: str, interval: str, as_of: str | None = None) -> DataFrame:
    """Rows strictly newer than anchor - interval; the anchor defaults to the data's own maximum."""
    return df.where(F.col(col) > anchor(df, col, as_of) - F.expr(f"interval {interval}"))


def topk(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """ORDER BY ... LIMIT; callers end the order with a key so that ties are settled."""
    return df.orderBy(*order).limit(n)


def share(counts: DataFrame, count_col: str = "n") -> Column:
    """Percentage of the grand total, the total read as a scalar over the aggregated rows."""
    total = counts.agg(F.sum(count_col).alias("t")).scalar()
    return F.round(F.col(count_col).cast("double") * 100 / total, 2)

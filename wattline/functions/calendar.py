"""Time columns on timezone-free timestamps."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

NTZ = "timestamp_ntz"


def ts(text: str) -> Column:
    return F.lit(text).cast(NTZ)


def trunc(unit: str, col: Column) -> Column:
    return F.date_trunc(unit, col).cast(NTZ)


def slot(col: Column, minutes: int = 15) -> Column:
    """Start of the fixed-size slot that holds ``col`` (slots divide the hour)."""
    step = F.floor(F.minute(col) / F.lit(minutes)) * F.lit(minutes)
    return (trunc("HOUR", col) + F.make_interval(mins=step.cast("int"))).cast(NTZ)


def day_of_week(col: Column) -> Column:
    """Sunday = 0 ... Saturday = 6."""
    return F.dayofweek(col) - F.lit(1)


def is_weekend(col: Column) -> Column:
    return F.dayofweek(col).isin(1, 7)


def minutes_between(start: Column, end: Column) -> Column:
    """Whole minutes from start to end."""
    return F.timestamp_diff("MINUTE", start, end)


def boundary_diff(unit: str, start: Column, end: Column) -> Column:
    """Number of unit boundaries crossed, not of whole units elapsed."""
    return F.timestamp_diff(unit, F.date_trunc(unit, start), F.date_trunc(unit, end))


def seconds(col: Column) -> Column:
    """Seconds since 1970 of a timezone-free timestamp."""
    return F.timestamp_diff("SECOND", ts("1970-01-01 00:00:00"), col)

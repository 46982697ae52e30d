"""Threshold rules and named predicates."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def banded(col: Column, steps: list[tuple[str, float, str]], otherwise: str | None) -> Column:
    """First matching (operator, limit, label) wins; a NULL value falls through to ``otherwise``."""
    compare = {
        ">=": lambda a, b: a >= b, ">": lambda a, b: a > b,
        "<": lambda a, b: a < b, "<=": lambda a, b: a <= b,
    }
    out = None
    for op, limit, label in steps:
        test = compare[op](col, F.lit(limit))
        out = F.when(test, label) if out is None else out.when(test, label)
    return out.otherwise(F.lit(otherwise))


# Voltage limits in volts.
SEVERE_SAG_V = 108.0
SAG_V = 114.0
SWELL_V = 126.0
NOMINAL_V = 120.0


def sag_type(voltage: Column) -> Column:
    return (
        F.when(voltage < SEVERE_SAG_V, "SEVERE_SAG")
        .when(voltage < SAG_V, "MODERATE_SAG")
        .when(voltage > SWELL_V, "SWELL")
    )


def voltage_drop(voltage: Column) -> Column:
    return F.when(voltage < SAG_V, F.lit(NOMINAL_V) - voltage).otherwise(F.lit(0.0))


def voltage_event_id(meter: Column, at: Column, voltage: Column) -> Column:
    stamp = F.concat(F.lit("VSE-"), F.date_format(at, "yyyyMMddHHmmss"), F.lit("-"), meter)
    return F.when(sag_type(voltage).isNotNull(), stamp)


def is_outage(usage: Column, voltage: Column) -> Column:
    return F.coalesce((usage == 0) & (voltage < 100), F.lit(False))


def health_category(score: Column) -> Column:
    return banded(score, [(">=", 80, "GOOD"), (">=", 60, "FAIR"), (">=", 40, "POOR")], "CRITICAL")


def load_status(pct: Column) -> Column:
    return banded(pct, [(">", 90, "CRITICAL"), (">", 75, "WARNING")], "NORMAL")


def load_category(pct: Column) -> Column:
    return banded(pct, [("<", 50, "NORMAL"), ("<", 80, "ELEVATED"), ("<", 100, "HIGH")], "CRITICAL")


def loading_band(pct: Column) -> Column:
    return banded(
        pct,
        [("<", 50, "LOW (<50%)"), ("<", 80, "MODERATE (50-80%)"), ("<", 100, "HIGH (80-100%)")],
        "OVERLOADED (>100%)",
    )


def stress_category(pct: Column) -> Column:
    """Thermal stress from the load factor."""
    return banded(pct, [(">=", 120, "CRITICAL"), (">=", 100, "HIGH"), (">=", 80, "MODERATE")], "LOW")


def age_bucket(age: Column) -> Column:
    return banded(
        age,
        [("<", 10, "< 10 years"), ("<", 20, "10-19 years"), ("<", 30, "20-29 years"), ("<", 40, "30-39 years")],
        "40+ years",
    )


def location_area(lat: Column, lon: Column) -> Column:
    return (
        F.when(lat < 29.4, "Coastal Texas")
        .when((lat < 29.8) & (lon > -95.3), "Houston Metro")
        .when(lat >= 29.8, "Montgomery County")
        .otherwise("Harris County")
    )


def load_serving_class(pct: Column) -> Column:
    return banded(pct, [("<", 50, "Residential"), ("<", 75, "Commercial")], "Industrial")


def replacement_priority(health: Column, age: Column) -> Column:
    return (
        F.when((health < 30) & (age > 35), "URGENT")
        .when((health < 50) | (age > 40), "HIGH")
        .when((health < 70) & (age > 30), "MEDIUM")
        .otherwise("LOW")
    )


def outage_severity(customers: Column) -> Column:
    return banded(customers, [(">=", 100, "CRITICAL"), (">=", 10, "HIGH"), (">=", 2, "MEDIUM")], "LOW")


def ops_severity(cause: Column, customers: Column) -> Column:
    n = F.coalesce(customers, F.lit(0))
    return (
        F.when((cause == "WEATHER") & (n > 1), "CRITICAL").when(n > 30, "HIGH").when(n > 5, "MEDIUM").otherwise("LOW")
    )


def scenario_tag(cause: Column) -> Column:
    return (
        F.when(cause == "WEATHER", "beryl_historical")
        .when(cause == "VEGETATION", "historical_vegetation")
        .when(cause.isin("TRANSFORMER_OVERLOAD", "OVERLOAD"), "historical_overload")
        .otherwise("historical_other")
    )


# Nominal kV named inside a voltage-class text.
NOMINAL_KV = {"345": 345.0, "230": 230.0, "138": 138.0, "69": 69.0}


def nominal_kv(label: Column) -> Column:
    out = None
    for text, kv in NOMINAL_KV.items():
        out = F.when(label.contains(text), kv) if out is None else out.when(label.contains(text), kv)
    return out.otherwise(F.lit(12.47))


# Customer classes by coarse bucket.
CLASS_BUCKETS = {
    "RES": ["LOW_INCOME", "LOWER_MIDDLE", "MIDDLE_INCOME", "UPPER_MIDDLE", "HIGH_INCOME"],
    "COM": ["COM_SMALL", "COM_LARGE"],
    "IND": ["IND_LIGHT", "IND_HEAVY"],
    "GOV": ["GOV_LOCAL", "GOV_STATE"],
}


def class_bucket(customer_class: Column) -> Column:
    out = None
    for bucket, members in CLASS_BUCKETS.items():
        test = customer_class.isin(members)
        out = F.when(test, bucket) if out is None else out.when(test, bucket)
    return out.otherwise("RES")


def usage_segment(avg_daily: Column, peak_hour: Column) -> Column:
    return (
        F.when((avg_daily > 50) & peak_hour.between(17, 21), "High-Evening")
        .when((avg_daily > 50) & peak_hour.between(9, 17), "High-Daytime")
        .when(avg_daily <= 20, "Low-Usage")
        .otherwise("Medium-Mixed")
    )


def strict_greatest(*cols: Column) -> Column:
    """GREATEST that is NULL as soon as one argument is NULL."""
    missing = cols[0].isNull()
    for c in cols[1:]:
        missing = missing | c.isNull()
    return F.when(~missing, F.greatest(*cols))


def strict_least(*cols: Column) -> Column:
    missing = cols[0].isNull()
    for c in cols[1:]:
        missing = missing | c.isNull()
    return F.when(~missing, F.least(*cols))


def _month_pair(at: Column, year: int) -> Column:
    return (F.year(at) == year) & F.month(at).isin(7, 8)


# Reusable predicates over the canonical column names.
FILTERS = {
    "SUMMER_2024": lambda: _month_pair(F.col("reading_ts"), 2024),
    "SUMMER_2025": lambda: _month_pair(F.col("reading_ts"), 2025),
    "PEAK_HOURS": lambda: F.hour("reading_ts").between(14, 19),
    "OFF_PEAK": lambda: (F.hour("reading_ts") < 6) | (F.hour("reading_ts") >= 22),
    "VALID_READINGS_ONLY": lambda: F.col("quality") == "VALID",
    "LOW_VOLTAGE_INCIDENTS": lambda: F.col("voltage_v") < SAG_V,
    "VOLTAGE_SAG_EVENTS": lambda: sag_type(F.col("voltage_v")).isNotNull(),
    "ACTIVE_CUSTOMERS": lambda: F.col("account_status") == "ACTIVE",
    "OVERLOADED": lambda: F.col("load_utilization_pct") > 100,
    "HIGH_RISK": lambda: F.col("health_score") < 50,
    "AGING": lambda: F.col("age_years") > 30,
    "LARGE_TRANSFORMERS": lambda: F.col("rated_kva") > 500,
    "OVERLOADED_HOURS": lambda: F.col("load_factor_pct") > 100,
    "HIGH_STRESS": lambda: stress_category(F.col("load_factor_pct")).isin("HIGH", "CRITICAL"),
    "CRITICAL_STRESS": lambda: stress_category(F.col("load_factor_pct")) == "CRITICAL",
}

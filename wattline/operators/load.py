"""Hourly transformer load: build, stress, overload and time features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from wattline.functions import rules
from wattline.functions.calendar import day_of_week, is_weekend, trunc
from wattline.operators.anchors import anchor, share, topk

# Fixed values of the load build.
SLOTS_PER_HOUR = 4.0
DERATE = 0.95
MAX_RISE_C = 35.0
DEFAULT_TEMP_F = 85.0


def ambient_c(temperature_f: Column) -> Column:
    return (F.coalesce(temperature_f, F.lit(DEFAULT_TEMP_F)) - 32.0) * 5.0 / 9.0


def transformer_hourly_load(readings: DataFrame, meters: DataFrame, transformers: DataFrame, weather: DataFrame) -> DataFrame:
    """Hourly kW per transformer; readings are combined per meter-hour before the first join."""
    per_meter = readings.groupBy("meter_id", trunc("HOUR", F.col("reading_ts")).alias("load_hour")).agg(
        F.sum(F.col("usage_kwh") * SLOTS_PER_HOUR).alias("kw")
    )
    hourly = (
        per_meter.join(meters.where("transformer_id IS NOT NULL").select("meter_id", "transformer_id"), "meter_id")
        .groupBy("transformer_id", "load_hour")
        .agg(F.round(F.sum("kw"), 4).alias("load_kw"))
    )
    usable = F.nullif(F.col("rated_kva") * DERATE, F.lit(0.0))
    return (
        hourly.join(transformers.select("transformer_id", "rated_kva"), "transformer_id", "left")
        .join(weather.select(F.col("hour").alias("load_hour"), "temperature_f"), "load_hour", "left")
        .select(
            "transformer_id",
            "load_hour",
            "load_kw",
            "rated_kva",
            (F.col("load_kw") / usable * 100.0).alias("load_factor_pct"),
            (ambient_c(F.col("temperature_f")) + F.col("load_kw") / usable * MAX_RISE_C).alias("temperature_c"),
        )
    )


def transformer_daily(hourly: DataFrame) -> DataFrame:
    return hourly.groupBy("transformer_id", F.to_date("load_hour").alias("day")).agg(
        F.avg("load_kw").alias("avg_load_kw"), F.max("load_kw").alias("peak_load_kw"), F.avg("load_factor_pct").alias("avg_load_pct")
    )


def with_stress(hourly: DataFrame) -> DataFrame:
    lf = F.col("load_factor_pct")
    return hourly.withColumns(
        {"thermal_stress_category": rules.stress_category(lf), "is_overloaded": F.coalesce(lf > 100, F.lit(False))}
    )


def loading_distribution(hourly: DataFrame) -> DataFrame:
    counts = hourly.groupBy(rules.loading_band(F.col("load_factor_pct")).alias("loading_band")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return counts.select("loading_band", F.col("n").alias("hours"), share(counts).alias("pct"))


def _ones(cond: Column) -> Column:
    return F.sum(F.when(cond, 1).otherwise(0))


def overload_ranking(hourly: DataFrame, minimum: int = 10, n: int = 20) -> DataFrame:
    over = F.col("load_factor_pct") > 100
    per = (
        hourly.groupBy("transformer_id")
        .agg(
            F.count(F.lit(1)).alias("total_hours"),
            _ones(over).alias("overload_hours"),
            F.max("load_factor_pct").alias("peak_load_pct"),
        )
        .where(F.col("overload_hours") > minimum)
        .withColumn("overload_pct", F.round(F.col("overload_hours").cast("double") * 100 / F.col("total_hours"), 2))
    )
    return topk(per, [F.col("overload_hours").desc(), F.col("transformer_id").asc()], n)


def stress_distribution(hourly: DataFrame) -> DataFrame:
    return (
        with_stress(hourly)
        .groupBy("thermal_stress_category")
        .agg(F.count(F.lit(1)).alias("hour_count"), F.countDistinct("transformer_id").alias("transformers_affected"))
    )


def thermal_stress(hourly: DataFrame, n: int = 20) -> DataFrame:
    per = (
        with_stress(hourly)
        .groupBy("transformer_id")
        .agg(
            _ones(F.col("thermal_stress_category") == "CRITICAL").alias("critical_hours"),
            _ones(F.col("thermal_stress_category") == "HIGH").alias("high_hours"),
            F.avg("load_factor_pct").alias("avg_load_pct"),
        )
        .where("critical_hours > 0")
    )
    return topk(per, [F.col("critical_hours").desc(), F.col("transformer_id").asc()], n)


def thermal_stress_hourly(hourly: DataFrame, weather: DataFrame) -> DataFrame:
    """Oil and hot-spot estimates from ambient and load; score = load factor scaled so that 150 % is 100."""
    lf = F.col("load_factor_pct") / 100.0
    joined = hourly.join(weather.select(F.col("hour").alias("load_hour"), "temperature_f"), "load_hour", "left")
    oil = ambient_c(F.col("temperature_f")) + lf * MAX_RISE_C
    return joined.select(
        "transformer_id",
        F.col("load_hour").alias("stress_hour"),
        "load_kw",
        "load_factor_pct",
        F.coalesce(F.col("temperature_f"), F.lit(DEFAULT_TEMP_F)).alias("ambient_temp_f"),
        (oil * 9.0 / 5.0 + 32.0).alias("top_oil_temp_f"),
        ((oil + lf * lf * 15.0) * 9.0 / 5.0 + 32.0).alias("hot_spot_temp_f"),
        F.greatest(F.lit(0.0), F.least(F.lit(100.0), lf * 100.0 / 1.5)).alias("thermal_stress_score"),
        rules.stress_category(F.col("load_factor_pct")).alias("stress_category"),
        F.hour("load_hour").between(14, 19).alias("is_peak_hour"),
        F.hour("load_hour").alias("hour_of_day"),
        day_of_week(F.col("load_hour")).alias("day_of_week"),
    )


def shared_reliability(hourly: DataFrame) -> DataFrame:
    stressed = F.col("thermal_stress_category").isin("CRITICAL", "HIGH")
    return (
        with_stress(hourly)
        .groupBy(
            trunc("MONTH", F.col("load_hour")).alias("metric_month"),
            F.when(stressed, "HIGH_STRESS").otherwise("NORMAL_STRESS").alias("stress_category"),
        )
        .agg(
            F.countDistinct("transformer_id").alias("transformer_count"),
            F.avg("load_factor_pct").alias("avg_load_factor"),
            (F.avg(F.when(F.col("is_overloaded"), 1.0).otherwise(0.0)) * 100).alias("overload_rate_pct"),
        )
    )


def rolling_avg(readings: DataFrame, meters: DataFrame, rows: int = 7) -> DataFrame:
    """Trailing mean of daily kWh.  The window runs over one row per transformer-day, so a group is at most one row
    per calendar day however many readings a transformer has."""
    per_meter = readings.groupBy("meter_id", F.to_date("reading_ts").alias("reading_date")).agg(
        F.sum("usage_kwh").alias("kwh")
    )
    daily = (
        per_meter.join(meters.select("meter_id", "transformer_id"), "meter_id")
        .groupBy("transformer_id", "reading_date")
        .agg(F.sum("kwh").alias("daily_kwh"))
    )
    frame = Window.partitionBy("transformer_id").orderBy("reading_date").rowsBetween(1 - rows, Window.currentRow)
    return daily.withColumn("rolling_avg", F.avg("daily_kwh").over(frame))


def hourly_usage(readings: DataFrame) -> DataFrame:
    """One row per meter-hour."""
    return readings.groupBy("meter_id", trunc("HOUR", F.col("reading_ts")).alias("hour")).agg(
        F.sum("usage_kwh").alias("usage_kwh")
    )


def load_forecast_features(hourly: DataFrame, weather: DataFrame | None = None, holidays: list[str] | None = None) -> DataFrame:
    """Lags and trailing statistics per meter-hour.

    Input has one row per (meter, hour), so a window group is bounded by the hours covered.  Frames are by hour
    number, not by row count: gaps in the series give NULL lags instead of wrong ones.
    """
    stamp = F.timestamp_diff("HOUR", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("hour"))
    w = Window.partitionBy("meter_id").orderBy("_h")
    day = w.rangeBetween(-24, -1)
    week = w.rangeBetween(-168, -1)

    def lag(h: int) -> Column:
        return F.max("usage_kwh").over(w.rangeBetween(-h, -h))

    out = hourly.withColumn("_h", stamp).select(
        "meter_id",
        "hour",
        F.col("usage_kwh").alias("actual_usage_kwh"),
        lag(1).alias("usage_lag_1h"),
        lag(24).alias("usage_lag_24h"),
        lag(168).alias("usage_lag_168h"),
        F.avg("usage_kwh").over(day).alias("usage_avg_24h"),
        F.max("usage_kwh").over(day).alias("usage_max_24h"),
        F.stddev_samp("usage_kwh").over(day).alias("usage_stddev_24h"),
        F.avg("usage_kwh").over(week).alias("usage_avg_7d"),
        day_of_week(F.col("hour")).alias("day_of_week"),
        is_weekend(F.col("hour")).alias("is_weekend"),
        F.to_date("hour").cast("string").isin(holidays or ["2024-01-01"]).alias("is_holiday"),
        F.month("hour").alias("month"),
    )
    if weather is not None:
        out = out.join(weather.select("hour", "temperature_f", "humidity_pct"), "hour", "left")
    return out


def consecutive_hours(hourly: DataFrame, flag: Column) -> DataFrame:
    """Running length of the current run of consecutive flagged hours (0 where the flag is off).

    Input has one row per (transformer, hour); a run breaks at an unflagged hour and at a missing hour.
    """
    w = Window.partitionBy("transformer_id").orderBy("load_hour")
    step = F.timestamp_diff("HOUR", F.lag("load_hour").over(w), F.col("load_hour"))
    fresh = F.col("_flag") & (F.coalesce(~F.lag("_flag").over(w), F.lit(True)) | (step != 1))
    marked = hourly.withColumn("_flag", F.coalesce(flag, F.lit(False)))
    islands = marked.withColumn("_start", F.when(fresh, 1).otherwise(0)).withColumn("_run", F.sum("_start").over(w))
    inside = Window.partitionBy("transformer_id", "_run").orderBy("load_hour")
    counted = F.sum(F.when(F.col("_flag"), 1).otherwise(0)).over(inside)
    return islands.select(
        "transformer_id",
        "load_hour",
        "load_factor_pct",
        F.when(F.col("_flag"), counted).otherwise(F.lit(0)).cast("bigint").alias("consecutive_hours"),
    )


def transformer_features(transformers: DataFrame, hourly: DataFrame, as_of: str | None = None) -> DataFrame:
    """7- and 30-day load features per transformer; every transformer keeps a row."""
    at = anchor(hourly, "load_hour", as_of)
    week = F.col("load_hour") >= F.col("_at") - F.expr("interval 7 days")
    over = F.col("load_factor_pct") > 100
    lf = F.col("load_factor_pct")
    rows = hourly.withColumn("_at", at).where(F.col("load_hour") >= F.col("_at") - F.expr("interval 30 days"))
    stats = rows.groupBy("transformer_id").agg(
        F.avg(F.when(week, lf)).alias("avg_load_factor_7d"),
        F.max(F.when(week, lf)).alias("max_load_factor_7d"),
        F.stddev_samp(F.when(week, lf)).alias("load_factor_stddev_7d"),
        _ones(week & over).alias("overload_hours_7d"),
        F.avg(lf).alias("avg_load_factor_30d"),
        F.max(lf).alias("max_load_factor_30d"),
        _ones(over).alias("overload_hours_30d"),
        _ones(rules.stress_category(lf) == "HIGH").alias("thermal_stress_hours_high"),
        _ones(rules.stress_category(lf) == "CRITICAL").alias("thermal_stress_hours_critical"),
    )
    counts = ["overload_hours_7d", "overload_hours_30d", "thermal_stress_hours_high", "thermal_stress_hours_critical"]
    return (
        transformers.select("transformer_id", "age_years", "health_score")
        .join(stats, "transformer_id", "left")
        .withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in counts})
    )

"""Interval readings: events, adjusted usage, health and consumption aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wattline.functions import rules
from wattline.functions.calendar import day_of_week, trunc, ts
from wattline.functions.hashing import uniform_int
from wattline.operators.anchors import recent, share, topk
from wattline.operators.moments import merged_moments, moments
from wattline.operators.quantiles import exact_percentiles

SLOTS_PER_DAY = 96


def _count_if(cond):
    return F.sum(F.when(cond, 1).otherwise(0))


def voltage_events(readings: DataFrame) -> DataFrame:
    v = F.col("voltage_v")
    return readings.withColumns(
        {
            "sag_type": rules.sag_type(v),
            "voltage_drop": rules.voltage_drop(v),
            "voltage_event_id": rules.voltage_event_id(F.col("meter_id"), F.col("reading_ts"), v),
        }
    )


def outage_adjusted(readings: DataFrame) -> DataFrame:
    out = rules.is_outage(F.col("usage_kwh"), F.col("voltage_v"))
    return readings.withColumns(
        {"is_outage": out, "usage_kwh_adjusted": F.when(out, F.lit(0.0)).otherwise(F.col("usage_kwh"))}
    )


def readings_final(readings: DataFrame) -> DataFrame:
    return outage_adjusted(voltage_events(readings))


def circuit_health(readings: DataFrame, meters: DataFrame, interval: str = "1 hour", as_of: str | None = None) -> DataFrame:
    """Per-circuit state over the trailing interval of the data."""
    rows = recent(readings, "reading_ts", interval, as_of).select("meter_id", "reading_ts", "usage_kwh", "voltage_v")
    v = F.col("avg_voltage")
    return (
        rows.join(meters.select("meter_id", "circuit_id"), "meter_id")
        .groupBy("circuit_id")
        .agg(
            F.countDistinct("meter_id").alias("active_meters"),
            F.avg("voltage_v").alias("avg_voltage"),
            F.avg("usage_kwh").alias("avg_usage_kwh"),
            _count_if(F.col("voltage_v") < rules.SAG_V).alias("low_voltage_count"),
            _count_if(F.col("usage_kwh") == 0).alias("zero_usage_count"),
            F.max("reading_ts").alias("last_reading"),
        )
        .withColumn(
            "circuit_status",
            F.when(v < rules.SAG_V, "CRITICAL").when(v < 118, "WARNING").otherwise("NORMAL"),
        )
    )


def meter_daily_avg(readings: DataFrame) -> DataFrame:
    return (
        readings.where(F.col("quality") == "VALID")
        .groupBy("meter_id")
        .agg(F.round(F.avg("usage_kwh") * SLOTS_PER_DAY, 4).alias("avg_daily_kwh"))
    )


def monthly_usage(readings: DataFrame) -> DataFrame:
    """Per meter-month totals with the same month of the year before."""
    month = F.trunc("reading_ts", "MM")
    base = (
        outage_adjusted(readings)
        .groupBy("meter_id", month.alias("usage_month"))
        .agg(
            F.sum("usage_kwh").alias("total_kwh"),
            F.max("usage_kwh").alias("peak_kwh"),
            F.min("usage_kwh").alias("min_kwh"),
            F.count(F.lit(1)).alias("reading_count"),
            F.avg("voltage_v").alias("avg_voltage"),
            _count_if(F.col("voltage_v") < rules.SAG_V).alias("low_voltage_readings"),
            _count_if(F.col("is_outage")).alias("outage_intervals"),
        )
        .withColumn("avg_daily_kwh", F.col("total_kwh") / F.dayofmonth(F.last_day("usage_month")))
    )
    prior = base.select(
        "meter_id",
        F.add_months("usage_month", 12).alias("usage_month"),
        F.col("total_kwh").alias("prior_year_kwh"),
    )
    change = (F.col("total_kwh") - F.col("prior_year_kwh")) / F.nullif(F.col("prior_year_kwh"), F.lit(0.0)) * 100
    return base.join(prior, ["meter_id", "usage_month"], "left").withColumn("yoy_change_pct", F.round(change, 2))


def monthly_trend(final: DataFrame) -> DataFrame:
    return final.groupBy(trunc("MONTH", F.col("reading_ts")).alias("month")).agg(
        F.sum("usage_kwh_adjusted").alias("total_kwh"),
        F.countDistinct("meter_id").alias("active_meters"),
        F.avg("usage_kwh_adjusted").alias("avg_interval_kwh"),
    )


def daily_usage(readings: DataFrame, lo: str | None = None, hi: str | None = None) -> DataFrame:
    """Per-day totals; the half-open bound is on the raw column so it reaches the scan."""
    rows = readings
    if lo is not None:
        rows = rows.where(F.col("reading_ts") >= ts(lo))
    if hi is not None:
        rows = rows.where(F.col("reading_ts") < ts(hi))
    return rows.groupBy(trunc("DAY", F.col("reading_ts")).alias("day")).agg(
        F.count(F.lit(1)).alias("reading_count"),
        F.countDistinct("meter_id").alias("active_meters"),
        F.sum("usage_kwh").alias("total_kwh"),
        F.avg("voltage_v").alias("avg_voltage"),
        _count_if(F.col("voltage_v") < rules.SAG_V).alias("low_voltage_events"),
    )


def peak_hours(readings: DataFrame, n: int = 20) -> DataFrame:
    hours = readings.groupBy(trunc("HOUR", F.col("reading_ts")).alias("hour")).agg(
        F.sum("usage_kwh").alias("total_kwh"),
        F.countDistinct("meter_id").alias("active_meters"),
        _count_if(rules.sag_type(F.col("voltage_v")).like("%SAG")).alias("sag_events"),
    )
    return topk(hours, [F.col("total_kwh").desc_nulls_last(), F.col("hour").asc()], n)


def hour_profile(readings: DataFrame) -> DataFrame:
    """Average, maximum and exact 95th percentile by hour of day."""
    rows = readings.select(F.hour("reading_ts").alias("hour_of_day"), "usage_kwh")
    basic = rows.groupBy("hour_of_day").agg(
        F.avg("usage_kwh").alias("avg_kwh"), F.max("usage_kwh").alias("max_kwh"), F.count(F.lit(1)).alias("reading_count")
    )
    return basic.join(exact_percentiles(rows, ["hour_of_day"], "usage_kwh", {"p95_kwh": 0.95}), "hour_of_day")


def dow_profile(readings: DataFrame) -> DataFrame:
    return readings.groupBy(
        day_of_week(F.col("reading_ts")).alias("day_of_week"), F.date_format("reading_ts", "E").alias("day_name")
    ).agg(F.max("usage_kwh").alias("max_kwh"), F.avg("usage_kwh").alias("avg_kwh"))


def yoy_compare(readings: DataFrame, months: list[int], years: list[int]) -> DataFrame:
    year = F.year("reading_ts")
    return (
        readings.where(F.month("reading_ts").isin(months) & year.isin(years))
        .groupBy(year.alias("year"))
        .agg(
            F.count(F.lit(1)).alias("reading_count"),
            F.sum("usage_kwh").alias("total_kwh"),
            F.avg("usage_kwh").alias("avg_kwh"),
        )
    )


def voltage_issue_meters(readings: DataFrame, pct: float = 5.0, n: int = 50) -> DataFrame:
    """Meters with more than ``pct`` percent low readings; the 108-114 band includes both ends here."""
    v = F.col("voltage_v")
    per_meter = (
        readings.groupBy("meter_id")
        .agg(
            F.count(F.lit(1)).alias("total_readings"),
            _count_if(v < 108).alias("severe_sags"),
            _count_if(v.between(108, 114)).alias("moderate_sags"),
            _count_if(v > 126).alias("swells"),
            _count_if(v < 114).alias("_low"),
        )
        .withColumn("sag_pct", F.round(F.col("_low").cast("double") * 100 / F.col("total_readings"), 2))
        .where(F.col("_low").cast("double") * 100 / F.col("total_readings") > pct)
        .drop("_low")
    )
    return topk(per_meter, [F.col("sag_pct").desc_nulls_last(), F.col("meter_id").asc()], n)


def sag_by_type(final: DataFrame) -> DataFrame:
    return (
        final.where(F.col("sag_type").isNotNull())
        .groupBy("sag_type")
        .agg(
            F.count(F.lit(1)).alias("event_count"),
            F.avg("voltage_v").alias("avg_voltage"),
            F.avg("voltage_drop").alias("avg_drop"),
            F.max("voltage_drop").alias("max_drop"),
        )
    )


def sags_per_meter(final: DataFrame, n: int = 20) -> DataFrame:
    per = (
        final.where(F.col("sag_type").isin("SEVERE_SAG", "MODERATE_SAG"))
        .groupBy("meter_id")
        .agg(F.count(F.lit(1)).alias("sag_count"), F.avg("voltage_drop").alias("avg_drop"))
    )
    return topk(per, [F.col("sag_count").desc(), F.col("meter_id").asc()], n)


def voltage_bands(readings: DataFrame) -> DataFrame:
    v = F.col("voltage_v")
    band = F.when(v < 114, "LOW").when(v <= 126, "NORMAL").otherwise("HIGH")
    counts = readings.groupBy(band.alias("voltage_band")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select("voltage_band", F.col("n").alias("reading_count"), share(counts).alias("pct"))


def low_voltage_days(readings: DataFrame, n: int = 10) -> DataFrame:
    days = readings.groupBy(F.to_date("reading_ts").alias("day")).agg(
        _count_if(F.col("voltage_v") < 114).alias("low_voltage_count"), F.count(F.lit(1)).alias("total_readings")
    )
    days = days.withColumn(
        "low_voltage_pct", F.round(F.col("low_voltage_count").cast("double") * 100 / F.col("total_readings"), 2)
    )
    return topk(days, [F.col("low_voltage_count").desc(), F.col("day").asc()], n)


def segment_consumption(final: DataFrame, customers: DataFrame) -> DataFrame:
    """Per segment.  Usage is first combined per meter, so the join moves one row per meter."""
    per_meter = final.groupBy("meter_id").agg(
        F.sum("usage_kwh_adjusted").alias("kwh"),
        F.count(F.lit(1)).alias("n"),
        F.sum("voltage_v").alias("v"),
        F.count("voltage_v").alias("vn"),
    )
    return (
        per_meter.join(customers.select("meter_id", "customer_id", "segment"), "meter_id")
        .groupBy("segment")
        .agg(
            F.countDistinct("customer_id").alias("customer_count"),
            F.countDistinct("meter_id").alias("meter_count"),
            F.sum("n").alias("reading_count"),
            F.sum("kwh").alias("total_kwh"),
            (F.sum("kwh") / F.sum("n")).alias("avg_kwh"),
            (F.sum("v") / F.sum("vn")).alias("avg_voltage"),
        )
    )


def usage_tiers(readings: DataFrame, customers: DataFrame) -> DataFrame:
    per_meter = readings.groupBy("meter_id").agg(F.sum("usage_kwh").alias("kwh"), F.count("usage_kwh").alias("n"))
    tiers = [(">", 50, "High Usage"), (">", 20, "Medium Usage")]
    return (
        per_meter.join(customers.select("meter_id", "customer_id"), "meter_id")
        .groupBy("customer_id")
        .agg((F.sum("kwh") / F.sum("n")).alias("avg_kwh"))
        .withColumn("usage_tier", rules.banded(F.col("avg_kwh"), tiers, "Low Usage"))
    )


def top_consumers(final: DataFrame, customers: DataFrame, n: int = 10) -> DataFrame:
    per_meter = final.groupBy("meter_id").agg(F.sum("usage_kwh_adjusted").alias("kwh"))
    per = (
        per_meter.join(customers.select("meter_id", "full_name", "city", "segment"), "meter_id")
        .groupBy("full_name", "city", "segment")
        .agg(F.sum("kwh").alias("total_kwh"))
    )
    return topk(per, [F.col("total_kwh").desc_nulls_last(), F.col("full_name").asc()], n)


def top_meters(final: DataFrame, n: int = 20) -> DataFrame:
    per = final.groupBy("meter_id").agg(F.sum("usage_kwh_adjusted").alias("total_kwh"))
    return topk(per, [F.col("total_kwh").desc_nulls_last(), F.col("meter_id").asc()], n)


def usage_segments(readings: DataFrame, customers: DataFrame) -> DataFrame:
    """Average daily kWh and modal hour per customer; the mode is taken over at most 24 counts."""
    hours = readings.groupBy("meter_id", F.hour("reading_ts").alias("h")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("usage_kwh").alias("kwh")
    )
    per_customer = (
        hours.join(customers.select("meter_id", "customer_id"), "meter_id")
        .groupBy("customer_id", "h")
        .agg(F.sum("n").alias("n"), F.sum("kwh").alias("kwh"))
        .groupBy("customer_id")
        .agg(
            (F.sum("kwh") / F.sum("n") * SLOTS_PER_DAY).alias("avg_daily_kwh"),
            F.max(F.struct(F.col("n"), (-F.col("h")).alias("neg_h"))).alias("top"),
        )
    )
    return per_customer.select(
        "customer_id",
        "avg_daily_kwh",
        (-F.col("top.neg_h")).alias("peak_hour"),
        rules.usage_segment(F.col("avg_daily_kwh"), -F.col("top.neg_h")).alias("usage_segment"),
    )


def system_hourly(readings: DataFrame) -> DataFrame:
    return readings.groupBy(trunc("HOUR", F.col("reading_ts")).alias("hour")).agg(
        F.sum("usage_kwh").alias("total_kwh"),
        F.avg("usage_kwh").alias("avg_kwh"),
        F.count(F.lit(1)).alias("reading_count"),
        F.countDistinct("meter_id").alias("active_meters"),
    )


def substation_hourly(readings: DataFrame, meters: DataFrame, substation_id: str) -> DataFrame:
    wanted = meters.where(F.col("substation_id") == substation_id).select("meter_id")
    return (
        readings.join(wanted, "meter_id", "left_semi")
        .groupBy(trunc("HOUR", F.col("reading_ts")).alias("hour"))
        .agg(F.sum("usage_kwh").alias("total_kwh"), F.count(F.lit(1)).alias("reading_count"))
    )


#: Sketch sizes: a meter count has a relative standard error of 1.04 / sqrt(2^HLL_K); a KLL rank is off by less than RANK_ERROR of the rows.
HLL_K = 12
KLL_K = 800
RANK_ERROR = 0.01


def daily_sketches(readings: DataFrame) -> DataFrame:
    """(day, meters, usage): one row a day with a mergeable sketch of its meters and one of its usage values, to be stored as it closes."""
    return readings.groupBy(F.to_date("reading_ts").alias("day")).agg(
        F.hll_sketch_agg("meter_id", HLL_K).alias("meters"), F.kll_sketch_agg_double(F.col("usage_kwh").cast("double"), F.lit(KLL_K)).alias("usage")
    )


def merged_sketches(daily: DataFrame, unit: str = "MONTH") -> DataFrame:
    """The sketches of longer periods from stored daily ones; no reading is read again."""
    return daily.groupBy(trunc(unit, F.col("day")).alias(unit.lower())).agg(F.hll_union_agg("meters").alias("meters"), F.kll_merge_agg_double("usage").alias("usage"))


def approx_monthly(daily: DataFrame) -> DataFrame:
    """Meters, median and 95th percentile a month from daily sketches, within the errors stated above."""
    month = merged_sketches(daily)

    def at(p):
        return F.kll_sketch_get_quantile_double("usage", F.lit(p))

    return month.select(
        "month", F.kll_sketch_get_n_double("usage").alias("n"), F.hll_sketch_estimate("meters").alias("approx_meters"), at(0.5).alias("approx_median"), at(0.95).alias("approx_p95")
    )


def approx_errors(approx: DataFrame, readings: DataFrame) -> DataFrame:
    """A month's true number of readings and meters, and whether its approximations keep their bounds: four standard errors, RANK_ERROR."""
    near = readings.select(trunc("MONTH", F.col("reading_ts")).alias("month"), "meter_id", "usage_kwh").join(approx, "month")

    def share(c):
        """Shares of readings below a value, and up to it: the wanted rank lies between, or close."""
        return F.avg((F.col("usage_kwh") < F.col(c)).cast("double")), F.avg((F.col("usage_kwh") <= F.col(c)).cast("double"))

    kept = {}
    for c, p in (("approx_median", 0.5), ("approx_p95", 0.95)):
        below, upto = share(c)
        kept[f"{c[7:]}_within"] = (below <= p + RANK_ERROR) & (upto >= p - RANK_ERROR)
    meters = F.countDistinct("meter_id")
    return near.groupBy("month").agg(
        F.count(F.lit(1)).alias("reading_count"), (F.max("n") == F.count("usage_kwh")).alias("all_counted"), meters.alias("meters"),
        (F.abs(F.max("approx_meters") - meters) <= 4 * 1.04 / 2 ** (HLL_K / 2) * meters + 1).alias("meters_within"), *[v.alias(k) for k, v in kept.items()],
    )


def completeness(readings: DataFrame) -> DataFrame:
    return readings.agg(
        F.count(F.lit(1)).alias("total"),
        _count_if(F.col("quality") == "VALID").alias("valid"),
        F.round(
            _count_if(F.col("quality") == "VALID").cast("double") * 100 / F.nullif(F.count(F.lit(1)), F.lit(0)), 2
        ).alias("completeness_pct"),
    )


def dispersion(readings: DataFrame, key: str = "meter_id") -> DataFrame:
    mean = F.avg("usage_kwh")
    return readings.groupBy(key).agg(
        F.stddev_samp("usage_kwh").alias("stddev_kwh"),
        (F.stddev_samp("usage_kwh") / F.nullif(mean, F.lit(0.0))).alias("cv"),
        ((F.max("usage_kwh") - F.min("usage_kwh")) / F.nullif(mean, F.lit(0.0))).alias("relative_range"),
    )


def shared_ami_stats(readings: DataFrame, power_factor_digits: int = 2) -> DataFrame:
    """Anonymous day x hour x zone statistics; the zone is a stable hash of the meter."""
    letters = F.array(F.lit("A"), F.lit("B"), F.lit("C"))
    zone = F.concat(F.lit("ZONE_"), F.element_at(letters, uniform_int(1, 3, F.col("meter_id")).cast("int")))
    rows = readings.select(
        F.to_date("reading_ts").alias("reading_date"),
        F.hour("reading_ts").alias("hour_of_day"),
        zone.alias("zone"),
        "meter_id", "usage_kwh", "voltage_v", "power_factor",
    )
    keys = ["reading_date", "hour_of_day", "zone"]
    basic = rows.groupBy(*keys).agg(
        F.countDistinct("meter_id").alias("meter_count"),
        F.avg("usage_kwh").alias("avg_usage_kwh"),
        F.stddev_samp("usage_kwh").alias("stddev_usage_kwh"),
        F.avg("voltage_v").alias("avg_voltage"),
        F.round(F.avg("power_factor"), power_factor_digits).alias("avg_power_factor"),
    )
    return basic.join(exact_percentiles(rows, keys, "usage_kwh", {"median_usage_kwh": 0.5}), keys)


def zscore_anomaly(readings: DataFrame, meters: DataFrame, z: float = 3.0, n: int = 100, days: int = 1) -> DataFrame:
    """Recent readings far from the mean of their transformer.

    Readings are combined per meter before they meet the meters; the recent ones meet a table with one row per meter.
    """
    keyed = meters.select("meter_id", "transformer_id")
    per_meter = readings.groupBy("meter_id").agg(*moments("usage_kwh"))
    mean, deviation = merged_moments()
    stats = per_meter.join(keyed, "meter_id").groupBy("transformer_id").agg(mean.alias("mean_kwh"), deviation.alias("stddev_kwh"))
    last = recent(readings, "reading_ts", f"{days} days").join(keyed.join(stats, "transformer_id"), "meter_id")
    score = (F.col("usage_kwh") - F.col("mean_kwh")) / F.nullif(F.col("stddev_kwh"), F.lit(0.0))
    hits = last.select("meter_id", "transformer_id", "reading_ts", "usage_kwh", "mean_kwh", score.alias("z_score")).where(F.abs("z_score") > z)
    return topk(hits, [F.col("z_score").desc_nulls_last(), F.col("meter_id").asc(), F.col("reading_ts").asc()], n)


def energy_burden(customers: DataFrame, monthly: DataFrame, tariff: float, income: dict[str, float]) -> DataFrame:
    """Average monthly kWh, cost and share of a segment income; tariff and incomes are parameters."""
    pairs = [x for name, amount in income.items() for x in (F.lit(name), F.lit(float(amount)))]
    per_meter = monthly.groupBy("meter_id").agg(F.avg("total_kwh").alias("monthly_kwh"))
    return customers.join(per_meter, "meter_id", "left").select(
        "customer_id",
        "segment",
        "monthly_kwh",
        (F.col("monthly_kwh") * F.lit(tariff)).alias("monthly_cost"),
        (
            F.col("monthly_kwh") * F.lit(tariff) / F.nullif(F.element_at(F.create_map(*pairs), F.col("segment")) / 12, F.lit(0.0)) * 100
        ).alias("burden_pct"),
    )


def rollup_levels(readings: DataFrame, meters: DataFrame) -> DataFrame:
    """Grand total, county and county-segment levels in one pass."""
    per_meter = readings.groupBy("meter_id").agg(F.sum("usage_kwh").alias("kwh"), F.count(F.lit(1)).alias("n"))
    return (
        per_meter.join(meters.select("meter_id", "county", "segment"), "meter_id")
        .rollup("county", "segment")
        .agg(
            F.grouping_id().alias("level"),
            F.sum("kwh").alias("total_kwh"),
            F.sum("n").alias("reading_count"),
        )
    )

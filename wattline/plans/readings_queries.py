"""Named queries over interval readings."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattline.operators import readings as R
from wattline.operators.quantiles import exact_percentiles
from wattline.plans.registry import register
from wattline.session import scratch_path
from wattline.functions import rules


def _round(df, digits: int, *cols: str):
    return df.withColumns({c: F.round(c, digits) for c in cols})


@register("voltage_events", """
SELECT meter_id, reading_ts, voltage_v, sag_type, round(voltage_drop,8) AS voltage_drop, voltage_event_id FROM final""")
def voltage_events(g):
    return _round(
        R.voltage_events(g.readings).select(
            "meter_id", "reading_ts", "voltage_v", "sag_type", "voltage_drop", "voltage_event_id"
        ), 8, "voltage_drop")


@register("outage_adjusted", "SELECT meter_id, reading_ts, usage_kwh, is_outage, usage_kwh_adjusted FROM final")
def outage_adjusted(g):
    return R.outage_adjusted(g.readings).select("meter_id", "reading_ts", "usage_kwh", "is_outage", "usage_kwh_adjusted")


HEALTH = """
SELECT m.circuit_id, count(DISTINCT r.meter_id) AS active_meters, round(avg(voltage_v),8) AS avg_voltage,
 round(avg(usage_kwh),8) AS avg_usage_kwh, count_if(voltage_v<114) AS low_voltage_count, count_if(usage_kwh=0) AS zero_usage_count,
 max(reading_ts) AS last_reading,
 CASE WHEN avg(voltage_v)<114 THEN 'CRITICAL' WHEN avg(voltage_v)<118 THEN 'WARNING' ELSE 'NORMAL' END AS circuit_status
FROM readings r JOIN meters m ON m.meter_id=r.meter_id
WHERE reading_ts > (SELECT max(reading_ts) FROM readings) - INTERVAL 1 {unit} GROUP BY 1"""


@register("circuit_health", HEALTH.format(unit="HOUR"))
def circuit_health(g):
    return _round(R.circuit_health(g.readings, g.meters), 8, "avg_voltage", "avg_usage_kwh")


@register("circuit_health_daily", HEALTH.format(unit="DAY"))
def circuit_health_daily(g):
    return _round(R.circuit_health(g.readings, g.meters, "1 day"), 8, "avg_voltage", "avg_usage_kwh")


@register("meter_daily_avg", """
SELECT meter_id, round(avg(usage_kwh)*96,4) AS avg_daily_kwh FROM readings WHERE quality='VALID' GROUP BY 1""")
def meter_daily_avg(g):
    return R.meter_daily_avg(g.readings)


@register("monthly_usage", """
WITH base AS (SELECT meter_id, cast(date_trunc('month', reading_ts) AS date) AS usage_month, sum(usage_kwh) AS total_kwh,
 max(usage_kwh) AS peak_kwh, min(usage_kwh) AS min_kwh, count(*) AS reading_count, avg(voltage_v) AS avg_voltage,
 count_if(voltage_v<114) AS low_voltage_readings, count_if(is_outage) AS outage_intervals FROM final GROUP BY 1,2)
SELECT b.meter_id, b.usage_month, round(b.total_kwh,8) AS total_kwh, b.peak_kwh, b.min_kwh, b.reading_count,
 round(b.avg_voltage,8) AS avg_voltage, b.low_voltage_readings, b.outage_intervals,
 round(b.total_kwh/day(last_day(b.usage_month)),8) AS avg_daily_kwh,
 round(p.total_kwh,8) AS prior_year_kwh, round((b.total_kwh-p.total_kwh)/nullif(p.total_kwh,0)*100,2) AS yoy_change_pct
FROM base b LEFT JOIN base p ON p.meter_id=b.meter_id AND p.usage_month + INTERVAL 12 MONTH = b.usage_month""")
def monthly_usage(g):
    return _round(R.monthly_usage(g.readings), 8, "total_kwh", "avg_voltage", "avg_daily_kwh", "prior_year_kwh")


@register("monthly_trend", """
SELECT date_trunc('month', reading_ts)::timestamp AS month, round(sum(usage_kwh_adjusted),8) AS total_kwh,
 count(DISTINCT meter_id) AS active_meters, round(avg(usage_kwh_adjusted),8) AS avg_interval_kwh FROM final GROUP BY 1""")
def monthly_trend(g):
    return _round(R.monthly_trend(R.readings_final(g.readings)), 8, "total_kwh", "avg_interval_kwh")


@register("daily_usage", """
SELECT date_trunc('day', reading_ts)::timestamp AS day, count(*) AS reading_count, count(DISTINCT meter_id) AS active_meters,
 round(sum(usage_kwh),8) AS total_kwh, round(avg(voltage_v),8) AS avg_voltage, count_if(voltage_v<114) AS low_voltage_events
FROM readings WHERE reading_ts>='2024-01-05' AND reading_ts<'2024-01-20' GROUP BY 1""")
def daily_usage(g):
    return _round(R.daily_usage(g.readings, "2024-01-05", "2024-01-20"), 8, "total_kwh", "avg_voltage")


@register("peak_hours", """
SELECT date_trunc('hour', reading_ts)::timestamp AS hour, round(sum(usage_kwh),8) AS total_kwh, count(DISTINCT meter_id) AS active_meters,
 count_if(voltage_v<114) AS sag_events FROM readings GROUP BY 1 ORDER BY sum(usage_kwh) DESC, 1 LIMIT 20""")
def peak_hours(g):
    return _round(R.peak_hours(g.readings), 8, "total_kwh")


@register("hour_profile", """
SELECT extract(hour from reading_ts) AS hour_of_day, round(avg(usage_kwh),8) AS avg_kwh, max(usage_kwh) AS max_kwh,
 count(*) AS reading_count, round(quantile_cont(usage_kwh,0.95),8) AS p95_kwh FROM readings GROUP BY 1""")
def hour_profile(g):
    return _round(_round(R.hour_profile(g.readings), 8, "avg_kwh"), 8, "p95_kwh")


@register("dow_profile", """
SELECT dayofweek(reading_ts) AS day_of_week, substr(dayname(reading_ts),1,3) AS day_name, max(usage_kwh) AS max_kwh,
 round(avg(usage_kwh),8) AS avg_kwh FROM readings GROUP BY 1,2""")
def dow_profile(g):
    return _round(R.dow_profile(g.readings), 8, "avg_kwh")


@register("yoy_compare", """
SELECT year(o_orderdate) AS year, count(*) AS reading_count, round(sum(o_totalprice),2) AS total_kwh, round(avg(o_totalprice),8) AS avg_kwh
FROM orders WHERE month(o_orderdate) IN (7,8) AND year(o_orderdate) IN (1995,1996,1997) GROUP BY 1""")
def yoy_compare(g):
    # order dates span several years, which the readings do not
    rows = g.raw("orders").select(F.col("o_orderdate").alias("reading_ts"), F.col("o_totalprice").alias("usage_kwh"))
    return _round(_round(R.yoy_compare(rows, [7, 8], [1995, 1996, 1997]), 2, "total_kwh"), 8, "avg_kwh")


@register("voltage_issue_meters", """
WITH m AS (SELECT meter_id, count(*) AS total_readings, count_if(voltage_v<108) AS severe_sags,
 count_if(voltage_v BETWEEN 108 AND 114) AS moderate_sags, count_if(voltage_v>126) AS swells, count_if(voltage_v<114) AS low
 FROM readings GROUP BY 1)
SELECT meter_id, total_readings, severe_sags, moderate_sags, swells, round(low::double*100/total_readings,2) AS sag_pct
FROM m WHERE low::double*100/total_readings>5 ORDER BY sag_pct DESC, meter_id LIMIT 50""")
def voltage_issue_meters(g):
    return R.voltage_issue_meters(g.readings)


@register("sag_by_type", """
SELECT sag_type, count(*) AS event_count, round(avg(voltage_v),8) AS avg_voltage, round(avg(voltage_drop),8) AS avg_drop,
 max(voltage_drop) AS max_drop FROM final WHERE sag_type IS NOT NULL GROUP BY 1""")
def sag_by_type(g):
    return _round(R.sag_by_type(R.readings_final(g.readings)), 8, "avg_voltage", "avg_drop")


@register("sags_per_meter", """
SELECT meter_id, count(*) AS sag_count, round(avg(voltage_drop),8) AS avg_drop FROM final
WHERE sag_type IN ('SEVERE_SAG','MODERATE_SAG') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""")
def sags_per_meter(g):
    return _round(R.sags_per_meter(R.readings_final(g.readings)), 8, "avg_drop")


@register("voltage_bands", """
SELECT CASE WHEN voltage_v<114 THEN 'LOW' WHEN voltage_v<=126 THEN 'NORMAL' ELSE 'HIGH' END AS voltage_band,
 count(*) AS reading_count, round(count(*)::double*100/sum(count(*)) OVER (),2) AS pct FROM readings GROUP BY 1""")
def voltage_bands(g):
    return R.voltage_bands(g.readings)


@register("low_voltage_days", """
SELECT cast(reading_ts AS date) AS day, count_if(voltage_v<114) AS low_voltage_count, count(*) AS total_readings,
 round(count_if(voltage_v<114)::double*100/count(*),2) AS low_voltage_pct FROM readings GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def low_voltage_days(g):
    return R.low_voltage_days(g.readings)


@register("segment_consumption", """
SELECT c.segment, count(DISTINCT c.customer_id) AS customer_count, count(DISTINCT f.meter_id) AS meter_count, count(*) AS reading_count,
 round(sum(usage_kwh_adjusted),8) AS total_kwh, round(avg(usage_kwh_adjusted),8) AS avg_kwh, round(avg(voltage_v),8) AS avg_voltage
FROM final f JOIN customers c ON c.meter_id=f.meter_id GROUP BY 1""")
def segment_consumption(g):
    return _round(R.segment_consumption(R.readings_final(g.readings), g.customers), 8, "total_kwh", "avg_kwh", "avg_voltage")


@register("usage_tiers", """
SELECT c.customer_id, round(avg(usage_kwh),8) AS avg_kwh, CASE WHEN avg(usage_kwh)>50 THEN 'High Usage' WHEN avg(usage_kwh)>20 THEN 'Medium Usage'
 ELSE 'Low Usage' END AS usage_tier FROM readings r JOIN customers c ON c.meter_id=r.meter_id GROUP BY 1""")
def usage_tiers(g):
    return _round(R.usage_tiers(g.readings, g.customers), 8, "avg_kwh")


@register("top_consumers", """
SELECT full_name, city, segment, round(sum(usage_kwh_adjusted),8) AS total_kwh FROM final f JOIN customers c ON c.meter_id=f.meter_id
GROUP BY 1,2,3 ORDER BY sum(usage_kwh_adjusted) DESC, 1 LIMIT 10""")
def top_consumers(g):
    return _round(R.top_consumers(R.readings_final(g.readings), g.customers), 8, "total_kwh")


@register("top_meters", """
SELECT meter_id, round(sum(usage_kwh_adjusted),8) AS total_kwh FROM final GROUP BY 1 ORDER BY sum(usage_kwh_adjusted) DESC, 1 LIMIT 20""")
def top_meters(g):
    return _round(R.top_meters(R.readings_final(g.readings)), 8, "total_kwh")


@register("usage_segment", """
WITH h AS (SELECT c.customer_id, extract(hour from reading_ts) AS h, count(*) AS n, sum(usage_kwh) AS kwh
 FROM readings r JOIN customers c ON c.meter_id=r.meter_id GROUP BY 1,2),
s AS (SELECT customer_id, sum(kwh)/sum(n)*96 AS d FROM h GROUP BY 1),
p AS (SELECT customer_id, h FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY n DESC, h) AS rn FROM h) WHERE rn=1)
SELECT s.customer_id, round(d,8) AS avg_daily_kwh, p.h AS peak_hour, CASE WHEN d>50 AND p.h BETWEEN 17 AND 21 THEN 'High-Evening'
 WHEN d>50 AND p.h BETWEEN 9 AND 17 THEN 'High-Daytime' WHEN d<=20 THEN 'Low-Usage' ELSE 'Medium-Mixed' END AS usage_segment
FROM s JOIN p ON p.customer_id=s.customer_id""")
def usage_segment(g):
    return _round(R.usage_segments(g.readings, g.customers), 8, "avg_daily_kwh")


@register("system_hourly", """
SELECT date_trunc('hour', reading_ts)::timestamp AS hour, round(sum(usage_kwh),8) AS total_kwh, round(avg(usage_kwh),8) AS avg_kwh,
 count(*) AS reading_count, count(DISTINCT meter_id) AS active_meters FROM readings GROUP BY 1""")
def system_hourly(g):
    return _round(R.system_hourly(g.readings), 8, "total_kwh", "avg_kwh")


@register("substation_hourly", """
SELECT date_trunc('hour', reading_ts)::timestamp AS hour, round(sum(usage_kwh),8) AS total_kwh, count(*) AS reading_count
FROM readings r JOIN meters m ON m.meter_id=r.meter_id WHERE m.substation_id='SUB-0007' GROUP BY 1""")
def substation_hourly(g):
    return _round(R.substation_hourly(g.readings, g.meters, "SUB-0007"), 8, "total_kwh")


@register("approx_monthly", """
SELECT date_trunc('month', reading_ts)::timestamp AS month, count(*) AS reading_count, true AS all_counted, count(DISTINCT meter_id) AS meters, true AS meters_within, true AS median_within, true AS p95_within FROM readings GROUP BY 1""")
def approx_monthly(g):
    """Monthly values from stored daily sketches, held against all readings of the month."""
    path = scratch_path(g.spark, "daily-sketches")
    R.daily_sketches(g.readings).write.parquet(path)
    return R.approx_errors(R.approx_monthly(g.spark.read.parquet(path)), g.readings)


@register("exact_quantiles", """
SELECT county, round(quantile_cont(usage_kwh,0.25),8) AS p25, round(median(usage_kwh),8) AS median_kwh, round(quantile_cont(usage_kwh,0.99),8) AS p99
FROM readings r JOIN meters m ON m.meter_id=r.meter_id GROUP BY 1""")
def exact_quantiles(g):
    rows = g.readings.select("meter_id", "usage_kwh").join(g.meters.select("meter_id", "county"), "meter_id")
    out = exact_percentiles(rows, ["county"], "usage_kwh", {"p25": 0.25, "median_kwh": 0.5, "p99": 0.99})
    return _round(out, 8, "p25", "median_kwh", "p99")


@register("exact_quantiles_null_group", """
SELECT CASE WHEN k%7<>0 THEN county END AS county, round(quantile_cont(usage_kwh,0.25),8) AS p25, round(median(usage_kwh),8) AS median_kwh
FROM readings r JOIN meters m ON m.meter_id=r.meter_id GROUP BY 1""")
def exact_quantiles_null_group(g):
    known = g.meters.select("meter_id", F.when(F.col("k") % 7 != 0, F.col("county")).alias("county"))
    rows = g.readings.select("meter_id", "usage_kwh").join(known, "meter_id")
    return _round(exact_percentiles(rows, ["county"], "usage_kwh", {"p25": 0.25, "median_kwh": 0.5}), 8, "p25", "median_kwh")


@register("completeness", """
SELECT count(*) AS total, count_if(quality='VALID') AS valid, round(count_if(quality='VALID')::double*100/nullif(count(*),0),2) AS completeness_pct FROM readings""")
def completeness(g):
    return R.completeness(g.readings)


@register("dispersion", """
SELECT meter_id, round(stddev_samp(usage_kwh),8) AS stddev_kwh, round(stddev_samp(usage_kwh)/nullif(avg(usage_kwh),0),8) AS cv,
 round((max(usage_kwh)-min(usage_kwh))/nullif(avg(usage_kwh),0),8) AS relative_range FROM readings GROUP BY 1""")
def dispersion(g):
    return _round(R.dispersion(g.readings), 8, "stddev_kwh", "cv", "relative_range")


@register("shared_ami_stats", """
SELECT cast(reading_ts AS date) AS reading_date, extract(hour from reading_ts) AS hour_of_day,
 'ZONE_'||(['A','B','C'])[cast(floor((cast('0x'||substr(md5(meter_id),1,13) as bigint)/4503599627370496.0)*3)+1 as int)] AS zone,
 count(DISTINCT meter_id) AS meter_count, round(avg(usage_kwh),8) AS avg_usage_kwh, round(stddev_samp(usage_kwh),8) AS stddev_usage_kwh,
 round(avg(voltage_v),8) AS avg_voltage, round(avg(power_factor),8) AS avg_power_factor, round(median(usage_kwh),8) AS median_usage_kwh
FROM readings GROUP BY 1,2,3""")
def shared_ami_stats(g):
    out = R.shared_ami_stats(g.readings, power_factor_digits=8)
    return _round(_round(out, 8, "avg_usage_kwh", "stddev_usage_kwh", "median_usage_kwh"), 8, "avg_voltage")


@register("zscore_anomaly", """
WITH k AS (SELECT r.*, m.transformer_id FROM readings r JOIN meters m ON m.meter_id=r.meter_id),
s AS (SELECT transformer_id, avg(usage_kwh) AS mean_kwh, stddev_samp(usage_kwh) AS sd FROM k GROUP BY 1),
z AS (SELECT meter_id, k.transformer_id, reading_ts, usage_kwh, mean_kwh, (usage_kwh-mean_kwh)/nullif(sd,0) AS z FROM k JOIN s ON s.transformer_id=k.transformer_id
 WHERE reading_ts > (SELECT max(reading_ts) FROM readings) - INTERVAL 7 DAY)
SELECT meter_id, transformer_id, reading_ts, usage_kwh, round(mean_kwh,8) AS mean_kwh, round(z,8) AS z_score FROM z WHERE abs(z)>3
ORDER BY z DESC, meter_id, reading_ts LIMIT 100""")
def zscore_anomaly(g):
    return _round(R.zscore_anomaly(g.readings, g.meters, days=7), 8, "mean_kwh", "z_score")


@register("energy_burden", """
WITH mu AS (SELECT meter_id, date_trunc('month', reading_ts) AS m, sum(usage_kwh) AS kwh FROM readings GROUP BY 1,2),
a AS (SELECT meter_id, avg(kwh) AS k FROM mu GROUP BY 1)
SELECT customer_id, segment, round(k,8) AS monthly_kwh, round(k*0.14,8) AS monthly_cost,
 round(k*0.14/(CASE segment WHEN 'HOUSEHOLD' THEN 52000 WHEN 'BUILDING' THEN 90000 WHEN 'FURNITURE' THEN 70000 WHEN 'MACHINERY' THEN 110000 WHEN 'AUTOMOBILE' THEN 80000 END/12.0::double)*100,8) AS burden_pct
FROM customers c LEFT JOIN a ON a.meter_id=c.meter_id""")
def energy_burden(g):
    incomes = {"HOUSEHOLD": 52000, "BUILDING": 90000, "FURNITURE": 70000, "MACHINERY": 110000, "AUTOMOBILE": 80000}
    out = R.energy_burden(g.customers, R.monthly_usage(g.readings), 0.14, incomes)
    return _round(out, 8, "monthly_kwh", "monthly_cost", "burden_pct")


@register("grouping_sets", """
SELECT county, segment, grouping(county)*2+grouping(segment) AS level, round(sum(usage_kwh),8) AS total_kwh, count(*) AS reading_count
FROM readings r JOIN meters m ON m.meter_id=r.meter_id GROUP BY ROLLUP(county, segment)""")
def grouping_sets(g):
    return _round(R.rollup_levels(g.readings, g.meters), 8, "total_kwh")


@register("recent_window", """
SELECT meter_id, reading_ts, usage_kwh FROM readings WHERE reading_ts > (SELECT max(reading_ts) FROM readings) - INTERVAL 24 HOUR""")
def recent_window(g):
    from wattline.operators.anchors import recent

    return recent(g.readings, "reading_ts", "24 hours").select("meter_id", "reading_ts", "usage_kwh")


@register("named_filters", """
SELECT count_if(extract(hour from reading_ts) BETWEEN 14 AND 19) AS peak_hours,
 count_if(extract(hour from reading_ts)<6 OR extract(hour from reading_ts)>=22) AS off_peak,
 count_if(quality='VALID') AS valid_readings_only, count_if(voltage_v<114) AS low_voltage_incidents,
 count_if(voltage_v<114 OR voltage_v>126) AS voltage_sag_events,
 count_if(year(reading_ts)=2024 AND month(reading_ts) IN (7,8)) AS summer_2024 FROM readings""")
def named_filters(g):
    names = ["PEAK_HOURS", "OFF_PEAK", "VALID_READINGS_ONLY", "LOW_VOLTAGE_INCIDENTS", "VOLTAGE_SAG_EVENTS", "SUMMER_2024"]
    return g.readings.agg(*[F.sum(F.when(rules.FILTERS[n](), 1).otherwise(0)).alias(n.lower()) for n in names])


@register("distinct_rows", "SELECT DISTINCT meter_id, quality FROM readings")
def distinct_rows(g):
    return g.readings.select("meter_id", "quality").distinct()


@register("customer_profile", """
WITH a AS (SELECT meter_id, avg(usage_kwh) AS k FROM readings GROUP BY 1)
SELECT c.customer_id, c.full_name, c.city, m.meter_id, m.transformer_id, round(a.k*96*30,8) AS est_monthly_kwh
FROM customers c JOIN meters m ON m.meter_id=c.meter_id LEFT JOIN a ON a.meter_id=m.meter_id WHERE c.account_status='ACTIVE'""")
def customer_profile(g):
    usage = g.readings.groupBy("meter_id").agg(F.round(F.avg("usage_kwh") * 96 * 30,8).alias("est_monthly_kwh"))
    hits = g.customers.where(F.col("account_status") == "ACTIVE").select("customer_id", "full_name", "city", "meter_id")
    return hits.join(g.meters.select("meter_id", "transformer_id"), "meter_id").join(usage, "meter_id", "left")


@register("fn_math", """
SELECT meter_id, reading_ts, floor(voltage_v)::bigint AS lo, ceil(voltage_v)::bigint AS hi, round(sqrt(usage_kwh),8) AS root,
 round(exp(-usage_kwh),8) AS decay, round(ln(1+usage_kwh),8) AS lg, round(sin(radians(voltage_v)),8) AS s, round(cos(radians(voltage_v)),8) AS c,
 round(abs(voltage_v-120),8) AS dev, greatest(voltage_v,120.0::double) AS big, least(voltage_v,120.0::double) AS small,
 extract(minute from reading_ts)%15 AS offgrid FROM readings""")
def fn_math(g):
    v, u = F.col("voltage_v"), F.col("usage_kwh")
    return g.readings.select(
        "meter_id", "reading_ts", F.floor(v).alias("lo"), F.ceil(v).alias("hi"), F.round(F.sqrt(u),8).alias("root"),
        F.round(F.exp(-u),8).alias("decay"), F.round(F.log(1 + u),8).alias("lg"), F.round(F.sin(F.radians(v)),8).alias("s"),
        F.round(F.cos(F.radians(v)),8).alias("c"), F.round(F.abs(v - 120),8).alias("dev"),
        rules.strict_greatest(v, F.lit(120.0)).alias("big"), rules.strict_least(v, F.lit(120.0)).alias("small"),
        (F.minute("reading_ts") % 15).alias("offgrid"),
    )

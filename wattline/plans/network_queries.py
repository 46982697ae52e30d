"""Named queries over hourly load, outages and assets."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattline.functions import rules
from wattline.operators import assets as A
from wattline.operators import load as L
from wattline.operators import outages as O
from wattline.operators import readings as R
from wattline.plans.registry import register

AS_OF = "2026-01-01"


def r8(df, *cols):
    return df.withColumns({c: F.round(c, 8) for c in cols})


def aged(g):
    """Transformers with age and derived columns."""
    return A.derive_transformer(A.age_years(g.transformers, AS_OF))


# ---------------------------------------------------------------- hourly load

@register("transformer_hourly_load", """
SELECT x.transformer_id, x.h AS load_hour, round(x.kw,4) AS load_kw, t.rated_kva, round(x.kw/nullif(t.rated_kva*0.95::double,0)*100,4) AS load_factor_pct,
 round((coalesce(w.temperature_f,85.0)-32.0)*5.0/9.0 + x.kw/nullif(t.rated_kva*0.95::double,0)*35.0,4) AS temperature_c
FROM (SELECT m.transformer_id, date_trunc('hour', reading_ts)::timestamp AS h, sum(usage_kwh*4) AS kw FROM readings r JOIN meters m ON m.meter_id=r.meter_id GROUP BY 1,2) x
LEFT JOIN transformers t ON t.transformer_id=x.transformer_id LEFT JOIN weather w ON w.hour=x.h""")
def transformer_hourly_load(g):
    out = L.transformer_hourly_load(g.readings, g.meters, g.transformers, g.weather)
    return out.withColumns({c: F.round(c, 4) for c in ("load_kw", "load_factor_pct", "temperature_c")})


@register("transformer_daily", """
SELECT transformer_id, cast(load_hour AS date) AS day, round(avg(load_kw),8) AS avg_load_kw, max(load_kw) AS peak_load_kw, round(avg(load_factor_pct),8) AS avg_load_pct
FROM hourly_load GROUP BY 1,2""")
def transformer_daily(g):
    return r8(L.transformer_daily(g.hourly_load), "avg_load_kw", "avg_load_pct")


@register("load_category", """
SELECT transformer_id, round(avg(load_factor_pct),8) AS avg_load_pct, CASE WHEN round(avg(load_factor_pct),6)<50 THEN 'NORMAL' WHEN round(avg(load_factor_pct),6)<80 THEN 'ELEVATED'
 WHEN round(avg(load_factor_pct),6)<100 THEN 'HIGH' ELSE 'CRITICAL' END AS load_category FROM hourly_load GROUP BY 1""")
def load_category(g):
    per = g.hourly_load.groupBy("transformer_id").agg(F.avg("load_factor_pct").alias("avg_load_pct"))
    return r8(per.withColumn("load_category", rules.load_category(F.round("avg_load_pct", 6))), "avg_load_pct")


@register("loading_distribution", """
SELECT CASE WHEN load_factor_pct<50 THEN 'LOW (<50%)' WHEN load_factor_pct<80 THEN 'MODERATE (50-80%)' WHEN load_factor_pct<100 THEN 'HIGH (80-100%)'
 ELSE 'OVERLOADED (>100%)' END AS loading_band, count(*) AS hours, round(count(*)::double*100/sum(count(*)) OVER (),2) AS pct FROM hourly_load GROUP BY 1""")
def loading_distribution(g):
    return L.loading_distribution(g.hourly_load)


@register("share_of_total", """
SELECT transformer_id, count(*) AS hours, round(count(*)::double*100/sum(count(*)) OVER (),2) AS pct FROM hourly_load GROUP BY 1""")
def share_of_total(g):
    from wattline.operators.anchors import share

    counts = g.hourly_load.groupBy("transformer_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("transformer_id", F.col("n").alias("hours"), share(counts).alias("pct"))


@register("overload_ranking", """
SELECT transformer_id, count(*) AS total_hours, count_if(load_factor_pct>100) AS overload_hours, max(load_factor_pct) AS peak_load_pct,
 round(count_if(load_factor_pct>100)::double*100/count(*),2) AS overload_pct FROM hourly_load GROUP BY 1 HAVING count_if(load_factor_pct>100)>10
ORDER BY 3 DESC, 1 LIMIT 20""")
def overload_ranking(g):
    return L.overload_ranking(g.hourly_load)


@register("stress_distribution", """
SELECT stress AS thermal_stress_category, count(*) AS hour_count, count(DISTINCT transformer_id) AS transformers_affected FROM stressed GROUP BY 1""")
def stress_distribution(g):
    return L.stress_distribution(g.hourly_load)


@register("thermal_stress", """
SELECT transformer_id, count_if(stress='CRITICAL') AS critical_hours, count_if(stress='HIGH') AS high_hours, round(avg(load_factor_pct),8) AS avg_load_pct
FROM stressed GROUP BY 1 HAVING count_if(stress='CRITICAL')>0 ORDER BY 2 DESC, 1 LIMIT 20""")
def thermal_stress(g):
    return r8(L.thermal_stress(g.hourly_load), "avg_load_pct")


@register("thermal_stress_hourly", """
WITH j AS (SELECT s.*, coalesce(w.temperature_f,85.0) AS tf, (coalesce(w.temperature_f,85.0)-32.0)*5.0/9.0 + load_factor_pct/100.0*35.0 AS oil
 FROM stressed s LEFT JOIN weather w ON w.hour=s.load_hour)
SELECT transformer_id, load_hour AS stress_hour, load_kw, round(load_factor_pct,6) AS load_factor_pct, round(tf,6) AS ambient_temp_f, round(oil*9.0/5.0+32.0,6) AS top_oil_temp_f,
 round((oil+pow(load_factor_pct/100.0,2)*15.0)*9.0/5.0+32.0,6) AS hot_spot_temp_f,
 round(greatest(0.0,least(100.0,load_factor_pct/1.5)),6) AS thermal_stress_score, stress AS stress_category,
 extract(hour from load_hour) BETWEEN 14 AND 19 AS is_peak_hour, extract(hour from load_hour) AS hour_of_day, dayofweek(load_hour) AS day_of_week FROM j""")
def thermal_stress_hourly(g):
    cols = ("load_factor_pct", "ambient_temp_f", "top_oil_temp_f", "hot_spot_temp_f", "thermal_stress_score")
    return L.thermal_stress_hourly(g.hourly_load, g.weather).withColumns({c: F.round(c, 6) for c in cols})


@register("shared_reliability", """
SELECT date_trunc('month', load_hour)::timestamp AS metric_month, CASE WHEN stress IN ('CRITICAL','HIGH') THEN 'HIGH_STRESS' ELSE 'NORMAL_STRESS' END AS stress_category,
 count(DISTINCT transformer_id) AS transformer_count, round(avg(load_factor_pct),8) AS avg_load_factor,
 round(avg(CASE WHEN load_factor_pct>100 THEN 1.0::double ELSE 0.0::double END)*100,8) AS overload_rate_pct FROM stressed GROUP BY 1,2""")
def shared_reliability(g):
    return r8(L.shared_reliability(g.hourly_load), "avg_load_factor", "overload_rate_pct")


@register("rolling_avg", """
WITH d AS (SELECT m.transformer_id, cast(reading_ts AS date) AS reading_date, sum(usage_kwh) AS daily_kwh FROM readings r JOIN meters m ON m.meter_id=r.meter_id GROUP BY 1,2)
SELECT transformer_id, reading_date, round(daily_kwh,8) AS daily_kwh,
 round(avg(daily_kwh) OVER (PARTITION BY transformer_id ORDER BY reading_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW),8) AS rolling_avg FROM d""")
def rolling_avg(g):
    return r8(L.rolling_avg(g.readings, g.meters), "daily_kwh", "rolling_avg")


@register("lag_features", """
WITH h AS (SELECT meter_id, date_trunc('hour', reading_ts)::timestamp AS hour, sum(usage_kwh) AS k FROM readings GROUP BY 1,2)
SELECT h.meter_id, h.hour, round(k,8) AS actual_usage_kwh,
 round((SELECT max(b.k) FROM h b WHERE b.meter_id=h.meter_id AND b.hour=h.hour-INTERVAL 1 HOUR),8) AS usage_lag_1h,
 round((SELECT max(b.k) FROM h b WHERE b.meter_id=h.meter_id AND b.hour=h.hour-INTERVAL 24 HOUR),8) AS usage_lag_24h,
 round((SELECT max(b.k) FROM h b WHERE b.meter_id=h.meter_id AND b.hour=h.hour-INTERVAL 168 HOUR),8) AS usage_lag_168h,
 round(avg(k) OVER d,8) AS usage_avg_24h, round(max(k) OVER d,8) AS usage_max_24h, round(avg(k) OVER w,8) AS usage_avg_7d,
 dayofweek(h.hour) AS day_of_week, dayofweek(h.hour) IN (0,6) AS is_weekend, cast(h.hour AS date)='2024-01-01' AS is_holiday, month(h.hour) AS month,
 round(temperature_f,8) AS temperature_f, round(humidity_pct,8) AS humidity_pct
FROM h LEFT JOIN weather ON weather.hour=h.hour
WINDOW d AS (PARTITION BY h.meter_id ORDER BY h.hour RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND INTERVAL 1 HOUR PRECEDING),
 w AS (PARTITION BY h.meter_id ORDER BY h.hour RANGE BETWEEN INTERVAL 168 HOUR PRECEDING AND INTERVAL 1 HOUR PRECEDING)""")
def lag_features(g):
    out = L.load_forecast_features(L.hourly_usage(g.readings), g.weather).drop("usage_stddev_24h")
    cols = [c for c in out.columns if c.startswith("usage_")] + ["actual_usage_kwh", "temperature_f", "humidity_pct"]
    return out.withColumns({c: F.round(c, 8) for c in cols})


@register("consecutive_run", """
WITH f AS (SELECT *, load_factor_pct>100 AS flag, row_number() OVER (PARTITION BY transformer_id ORDER BY load_hour) AS rn FROM hourly_load),
i AS (SELECT *, load_hour - INTERVAL 1 HOUR * (row_number() OVER (PARTITION BY transformer_id, flag ORDER BY load_hour)) AS grp FROM f)
SELECT transformer_id, load_hour, round(load_factor_pct,8) AS load_factor_pct, CASE WHEN flag THEN row_number() OVER (PARTITION BY transformer_id, flag, grp ORDER BY load_hour) ELSE 0 END AS consecutive_hours FROM i""")
def consecutive_run(g):
    return r8(L.consecutive_hours(g.hourly_load, F.col("load_factor_pct") > 100), "load_factor_pct")


@register("window_features", """
WITH a AS (SELECT max(load_hour) AS mx FROM hourly_load),
s AS (SELECT transformer_id, avg(load_factor_pct) FILTER (load_hour>=mx-INTERVAL 7 DAY) AS a7, max(load_factor_pct) FILTER (load_hour>=mx-INTERVAL 7 DAY) AS m7,
 stddev_samp(load_factor_pct) FILTER (load_hour>=mx-INTERVAL 7 DAY) AS s7, count_if(load_hour>=mx-INTERVAL 7 DAY AND load_factor_pct>100) AS o7,
 avg(load_factor_pct) AS a30, max(load_factor_pct) AS m30, count_if(load_factor_pct>100) AS o30, count_if(stress='HIGH') AS hi, count_if(stress='CRITICAL') AS cr
 FROM stressed, a WHERE load_hour>=mx-INTERVAL 30 DAY GROUP BY 1)
SELECT t.transformer_id, t.age_years, t.health_score, round(a7,8) AS avg_load_factor_7d, m7 AS max_load_factor_7d, round(s7,6) AS load_factor_stddev_7d,
 coalesce(o7,0) AS overload_hours_7d, round(a30,8) AS avg_load_factor_30d, m30 AS max_load_factor_30d, coalesce(o30,0) AS overload_hours_30d,
 coalesce(hi,0) AS thermal_stress_hours_high, coalesce(cr,0) AS thermal_stress_hours_critical
FROM aged t LEFT JOIN s ON s.transformer_id=t.transformer_id""")
def window_features(g):
    out = L.transformer_features(aged(g), g.hourly_load)
    out = r8(out, "avg_load_factor_7d", "avg_load_factor_30d")
    return out.withColumn("load_factor_stddev_7d", F.round("load_factor_stddev_7d", 6))


# ---------------------------------------------------------------- outages

@register("outage_severity", """
SELECT outage_id, cast(start_ts AS date) AS outage_date, extract(hour from start_ts) AS outage_hour,
 CASE WHEN customers>=100 THEN 'CRITICAL' WHEN customers>=10 THEN 'HIGH' WHEN customers>=2 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
 outage_id||' '||cause||' '||status||' on substation '||substation_id||' transformer '||transformer_id||' ' AS search_text FROM outages""")
def outage_severity(g):
    return O.outage_searchable(g.outages).select("outage_id", "outage_date", "outage_hour", "severity", "search_text")


@register("outage_severity_ops", """
SELECT outage_id, CASE WHEN cause='WEATHER' AND customers>1 THEN 'CRITICAL' WHEN customers>30 THEN 'HIGH' WHEN customers>5 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
 CASE cause WHEN 'WEATHER' THEN 'beryl_historical' WHEN 'VEGETATION' THEN 'historical_vegetation' WHEN 'TRANSFORMER_OVERLOAD' THEN 'historical_overload' ELSE 'historical_other' END AS scenario FROM outages""")
def outage_severity_ops(g):
    return O.ops_severity(g.outages).select("outage_id", "severity", "scenario")


@register("active_outages", """
SELECT o.outage_id, o.substation_id, s.substation_name, s.lat, s.lon, o.cause, o.customers, o.start_ts,
 date_sub('minute', o.start_ts, (SELECT max(end_ts) FROM outages)) AS minutes_out FROM outages o JOIN substations s ON s.substation_id=o.substation_id WHERE o.status='ACTIVE'""")
def active_outages(g):
    return O.active_outages(g.outages, g.substations)


@register("outage_stats", """
WITH a AS (SELECT max(start_ts) AS mx FROM outages)
SELECT count(*) AS total_outages, count_if(status='ACTIVE') AS active_outages, coalesce(sum(customers) FILTER (status='ACTIVE'),0)::bigint AS customers_out,
 round(avg(date_sub('minute', start_ts, CASE WHEN status='ACTIVE' THEN mx ELSE end_ts END)),8) AS avg_minutes FROM outages, a WHERE start_ts>mx-INTERVAL 7 DAY""")
def outage_stats(g):
    return r8(O.outage_stats(g.outages), "avg_minutes")


CAUSE = """SELECT cause, count(DISTINCT outage_id) AS outage_count, sum(customers)::bigint AS customers_affected,
 round(avg(date_sub('minute', start_ts, end_ts)),8) AS avg_duration_min FROM outages {where} GROUP BY 1"""


@register("outage_by_cause", CAUSE.format(where=""))
def outage_by_cause(g):
    return r8(O.outage_by_cause(g.outages), "avg_duration_min")


@register("storm_outages_by_cause", CAUSE.format(where="WHERE start_ts BETWEEN '2024-01-08' AND '2024-01-15'"))
def storm_outages_by_cause(g):
    return r8(O.outage_by_cause(g.outages, "2024-01-08", "2024-01-15"), "avg_duration_min")


@register("outage_timeline", """
SELECT date_trunc('hour', start_ts)::timestamp AS hour, count(*) AS outage_count, sum(customers)::bigint AS customers_affected FROM outages GROUP BY 1""")
def outage_timeline(g):
    return O.outage_timeline(g.outages)


@register("reliability_indices", """
WITH n AS (SELECT count(*) AS n FROM customers)
SELECT year(start_ts) AS year, round(sum(customers*date_sub('minute', start_ts, end_ts))/max(n),8) AS saidi, round(sum(customers)/max(n),8) AS saifi,
 round(count(*)/max(n),8) AS saifi_events FROM outages, n WHERE status='RESTORED' GROUP BY 1""")
def reliability_indices(g):
    return r8(O.reliability_indices(g.outages, g.customers), "saidi", "saifi", "saifi_events")


@register("join_interval", """
WITH spine AS (SELECT unnest(generate_series(timestamp '2024-01-01 00:00:00', timestamp '2024-02-02 00:00:00', INTERVAL 15 MINUTE)) AS slot_ts)
SELECT DISTINCT transformer_id, slot_ts FROM outages JOIN spine ON slot_ts BETWEEN start_ts AND end_ts""")
def join_interval(g):
    return O.outage_slots(g.outages)


@register("join_status_lookup", """
SELECT r.meter_id, m.transformer_id, r.reading_ts, time_bucket(INTERVAL 15 MINUTE, r.reading_ts) AS slot_ts, r.usage_kwh,
 CASE WHEN EXISTS (SELECT 1 FROM outages o WHERE o.transformer_id=m.transformer_id AND r.reading_ts BETWEEN o.start_ts AND o.end_ts) THEN 'OUTAGE' ELSE 'VALID' END AS slot_quality
FROM readings r JOIN meters m ON m.meter_id=r.meter_id""")
def join_status_lookup(g):
    return O.mark_outage(g.readings, g.meters, g.outages)


@register("outage_loss", """
WITH s AS (SELECT DISTINCT o.cause, f.meter_id, f.reading_ts, f.usage_kwh, f.usage_kwh_adjusted FROM final f JOIN meters m ON m.meter_id=f.meter_id
 JOIN outages o ON o.transformer_id=m.transformer_id AND f.reading_ts BETWEEN o.start_ts AND o.end_ts)
SELECT cause, count(*) AS affected_intervals, count(DISTINCT meter_id) AS affected_meters, round(sum(usage_kwh),6) AS kwh_at_stake, round(sum(usage_kwh-usage_kwh_adjusted),6) AS lost_kwh FROM s GROUP BY 1""")
def outage_loss(g):
    out = O.outage_loss(R.readings_final(g.readings), g.meters, g.outages)
    return out.withColumns({c: F.round(c, 6) for c in ("kwh_at_stake", "lost_kwh")})


@register("outage_load", """
WITH mc AS (SELECT transformer_id, count(*) AS n FROM meters GROUP BY 1)
SELECT o.outage_id, o.circuit_id, t.substation_id, o.transformer_id, o.start_ts, o.end_ts, 'RESTORED' AS status,
 CASE WHEN cast(o.start_ts AS date)='2024-01-08' AND extract(hour from o.start_ts) BETWEEN 17 AND 19 THEN 'WEATHER' ELSE o.cause END AS cause,
 coalesce(n,1) AS customers, 'CREW-'||cast(floor((cast('0x'||substr(md5(o.outage_id),1,13) as bigint)/4503599627370496.0)*8)+1 AS bigint) AS crew,
 o.start_ts + INTERVAL 1 MINUTE*cast(round(date_sub('minute',o.start_ts,o.end_ts)/2.0) AS int) AS estimated_restoration, date_sub('minute',o.start_ts,o.end_ts) AS duration_minutes,
 CASE WHEN cast(o.start_ts AS date)='2024-01-08' AND extract(hour from o.start_ts) BETWEEN 17 AND 19 THEN 'Storm impact. Original cause: '||o.cause ELSE 'Historical seed outage. Cause: '||o.cause END AS notes
FROM outages o JOIN transformers t ON t.transformer_id=o.transformer_id LEFT JOIN mc ON mc.transformer_id=o.transformer_id
WHERE o.start_ts>='2024-01-05' AND o.start_ts<'2024-01-20' AND o.end_ts>o.start_ts""")
def outage_load(g):
    return O.load_outages(g.outages, g.transformers, g.meters, "2024-01-05", "2024-01-20", "2024-01-08")


@register("outage_features", """
WITH k AS (SELECT r.*, m.circuit_id FROM readings r JOIN meters m ON m.meter_id=r.meter_id),
st AS (SELECT circuit_id, date_trunc('hour', reading_ts)::timestamp AS h, count(DISTINCT meter_id) AS mr, avg(voltage_v) AS av, stddev_samp(voltage_v) AS sv,
 count(DISTINCT meter_id) FILTER (voltage_v<114) AS lv FROM k GROUP BY 1,2),
mc AS (SELECT circuit_id, count(*) AS n FROM meters GROUP BY 1),
od AS (SELECT circuit_id, cast(start_ts AS date) AS d, count(*) AS n, sum(date_sub('minute',start_ts,end_ts)) AS mins FROM outages GROUP BY 1,2),
past AS (SELECT st.circuit_id, st.h, sum(CASE WHEN cast(st.h AS date)-od.d<=30 THEN od.n ELSE 0 END) AS o30, sum(od.n) AS o90, sum(od.mins)/sum(od.n) AS dur
 FROM st JOIN od ON od.circuit_id=st.circuit_id AND cast(st.h AS date)-od.d BETWEEN 1 AND 90 GROUP BY 1,2),
soon AS (SELECT DISTINCT st.circuit_id, st.h FROM st JOIN outages o ON o.circuit_id=st.circuit_id AND date_trunc('hour',o.start_ts) BETWEEN st.h+INTERVAL 1 HOUR AND st.h+INTERVAL 4 HOUR)
SELECT st.circuit_id, st.h AS feature_hour, mc.n AS meter_count, mr AS meters_reporting, round(mr/mc.n,8) AS reporting_rate, round(av,8) AS avg_voltage,
 round(sv,6) AS voltage_stddev, lv AS low_voltage_meters, coalesce(o30,0)::bigint AS outages_last_30d, coalesce(o90,0)::bigint AS outages_last_90d, round(dur,8) AS avg_outage_duration_min,
 soon.h IS NOT NULL AS had_outage_soon
FROM st JOIN mc ON mc.circuit_id=st.circuit_id LEFT JOIN past p ON p.circuit_id=st.circuit_id AND p.h=st.h LEFT JOIN soon ON soon.circuit_id=st.circuit_id AND soon.h=st.h""")
def outage_features(g):
    out = O.outage_features(g.readings, g.meters, g.outages)
    return r8(out, "reporting_rate", "avg_voltage", "avg_outage_duration_min").withColumn("voltage_stddev", F.round("voltage_stddev", 6))


# ---------------------------------------------------------------- assets

@register("health_scorecard", """
SELECT transformer_id, health_score, load_utilization_pct, CASE WHEN health_score>=80 THEN 'GOOD' WHEN health_score>=60 THEN 'FAIR' WHEN health_score>=40 THEN 'POOR' ELSE 'CRITICAL' END AS health_category,
 health_score<50 AND load_utilization_pct>80 AS requires_attention FROM transformers WHERE health_score IS NOT NULL""")
def health_scorecard(g):
    return A.equipment_scorecard(g.transformers)


@register("transformer_derived", """
SELECT transformer_id, location_area, 'FEEDER-'||coalesce(right(circuit_id,3),'000') AS feeder_id,
 CASE WHEN load_utilization_pct<50 THEN 'Residential' WHEN load_utilization_pct<75 THEN 'Commercial' ELSE 'Industrial' END AS load_serving_class FROM aged""")
def transformer_derived(g):
    return A.derive_transformer(g.transformers).select("transformer_id", "location_area", "feeder_id", "load_serving_class")


@register("age_years", "SELECT transformer_id, age_years FROM aged")
def age_years(g):
    return A.age_years(g.transformers, AS_OF).select("transformer_id", "age_years")


PRIORITY = "CASE WHEN health_score<30 AND age_years>35 THEN 'URGENT' WHEN health_score<50 OR age_years>40 THEN 'HIGH' WHEN health_score<70 AND age_years>30 THEN 'MEDIUM' ELSE 'LOW' END"


@register("replacement_priority", f"""
SELECT transformer_id, substation_id, rated_kva, age_years, health_score, {PRIORITY} AS replacement_priority FROM aged WHERE health_score<70 OR age_years>35
ORDER BY CASE {PRIORITY} WHEN 'URGENT' THEN 1 WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 3 ELSE 4 END, health_score, transformer_id LIMIT 100""")
def replacement_priority(g):
    return A.replacement_priority(aged(g))


@register("case_order", f"""
SELECT transformer_id, {PRIORITY} AS priority FROM aged ORDER BY CASE {PRIORITY} WHEN 'URGENT' THEN 1 WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 3 ELSE 4 END DESC, transformer_id LIMIT 30""")
def case_order(g):
    rows = aged(g).select("transformer_id", rules.replacement_priority(F.col("health_score"), F.col("age_years")).alias("priority"))
    return rows.orderBy(A.case_rank("priority", ["URGENT", "HIGH", "MEDIUM"]).desc(), "transformer_id").limit(30)


@register("anonymized_assets", """
SELECT sha256(transformer_id||'s1') AS asset_hash, location_area, rated_kva, health_score, make_date(install_year, (1+k%12)::int, 1) AS install_month FROM aged""")
def anonymized_assets(g):
    return A.anonymize_assets(g.transformers, "s1")


@register("load_status", """
SELECT transformer_id, load_utilization_pct, CASE WHEN load_utilization_pct>90 THEN 'CRITICAL' WHEN load_utilization_pct>75 THEN 'WARNING' ELSE 'NORMAL' END AS load_status FROM transformers""")
def load_status(g):
    return A.load_status(g.transformers).select("transformer_id", "load_utilization_pct", "load_status")


@register("nominal_voltage", """
SELECT substation_id, CASE WHEN v LIKE '%345%' THEN 345.0::double WHEN v LIKE '%230%' THEN 230.0 WHEN v LIKE '%138%' THEN 138.0 WHEN v LIKE '%69%' THEN 69.0 ELSE 12.47 END AS voltage_kv
FROM (SELECT substation_id, CASE k%5 WHEN 0 THEN '345KV' WHEN 1 THEN '230KV' WHEN 2 THEN '138KV' WHEN 3 THEN '69KV' ELSE '12KV' END AS v FROM substations)""")
def nominal_voltage(g):
    label = F.element_at(F.array(*[F.lit(x) for x in ("345KV", "230KV", "138KV", "69KV", "12KV")]), (F.col("k") % 5 + 1).cast("int"))
    return g.substations.select("substation_id", rules.nominal_kv(label).alias("voltage_kv"))


@register("at_risk_transformers", """
SELECT transformer_id, lat, lon, health_score, load_utilization_pct FROM transformers WHERE health_score<50 ORDER BY health_score, transformer_id LIMIT 500""")
def at_risk_transformers(g):
    return A.at_risk(g.transformers)


@register("fleet_overview", """
SELECT count(*) AS total_transformers, round(avg(age_years),8) AS avg_age, round(avg(health_score),8) AS avg_health, sum(rated_kva)/1000 AS total_capacity_mva FROM aged""")
def fleet_overview(g):
    return r8(A.fleet_overview(aged(g)), "avg_age", "avg_health")


@register("fleet_by_role", """
SELECT role, count(*) AS transformer_count, round(avg(age_years),8) AS avg_age, round(avg(health_score),8) AS avg_health, sum(rated_kva)::bigint AS total_kva FROM aged GROUP BY 1""")
def fleet_by_role(g):
    return r8(A.fleet_by_role(aged(g)), "avg_age", "avg_health")


@register("health_distribution", """
SELECT CASE WHEN health_score>=80 THEN 'GOOD' WHEN health_score>=60 THEN 'FAIR' WHEN health_score>=40 THEN 'POOR' ELSE 'CRITICAL' END AS health_category, count(*) AS transformer_count,
 round(avg(age_years),8) AS avg_age, round(count(*)::double*100/sum(count(*)) OVER (),2) AS pct FROM aged GROUP BY 1""")
def health_distribution(g):
    return r8(A.health_distribution(aged(g)), "avg_age")


@register("rate_class_share", """
SELECT segment, count(*) AS customer_count, round(count(*)::double*100/sum(count(*)) OVER (),2) AS pct FROM customers GROUP BY 1""")
def rate_class_share(g):
    return A.class_share(g.customers)


@register("age_buckets", """
SELECT CASE WHEN age_years<10 THEN '< 10 years' WHEN age_years<20 THEN '10-19 years' WHEN age_years<30 THEN '20-29 years' WHEN age_years<40 THEN '30-39 years' ELSE '40+ years' END AS age_bucket,
 count(*) AS transformer_count, round(avg(health_score),8) AS avg_health FROM aged GROUP BY 1""")
def age_buckets(g):
    return r8(A.age_buckets(aged(g)), "avg_health")


@register("aging_summary", "SELECT count(*) AS aging_transformers, round(avg(health_score),8) AS avg_health FROM aged WHERE age_years>35")
def aging_summary(g):
    return r8(A.aging_summary(aged(g)), "avg_health")


STATS = """h AS (SELECT transformer_id, avg(load_factor_pct) AS avg_load_pct, max(load_factor_pct) AS peak_load_pct, count_if(load_factor_pct>100) AS overload_hours,
 count_if(stress='CRITICAL') AS critical_stress_hours FROM stressed GROUP BY 1)"""


@register("composite_risk", f"""
WITH {STATS}
SELECT t.transformer_id, age_years, health_score, location_area, round(avg_load_pct,8) AS avg_load_pct, peak_load_pct, overload_hours, critical_stress_hours,
 round((100-health_score)*0.3::double + age_years/50.0::double*100.0*0.2::double + least(avg_load_pct,150.0)*0.25::double + least(overload_hours,100)*0.15::double + least(critical_stress_hours,50)*0.1::double,2) AS risk_score
FROM aged t JOIN h ON h.transformer_id=t.transformer_id WHERE health_score<60 OR overload_hours>20 OR age_years>35 ORDER BY risk_score DESC, t.transformer_id LIMIT 50""")
def composite_risk(g):
    return r8(A.composite_risk(aged(g), g.hourly_load), "avg_load_pct")


@register("high_risk_transformers", """
SELECT t.transformer_id, age_years, health_score, round(avg(load_factor_pct),8) AS avg_load_pct, max(load_factor_pct) AS peak_load_pct, count_if(load_factor_pct>100) AS overload_hours
FROM aged t JOIN hourly_load h ON h.transformer_id=t.transformer_id WHERE health_score<50 OR load_factor_pct>100 GROUP BY 1,2,3 ORDER BY health_score, peak_load_pct DESC, 1 LIMIT 20""")
def high_risk_transformers(g):
    return r8(A.high_risk(aged(g), g.hourly_load), "avg_load_pct")


@register("area_risk", f"""
WITH {STATS}
SELECT location_area, count(*) AS transformer_count, round(avg(health_score),8) AS avg_health, round(avg(age_years),8) AS avg_age, count_if(health_score<50) AS low_health_count,
 count_if(age_years>35) AS aging_count, coalesce(sum(critical_stress_hours),0)::bigint AS critical_hours FROM aged t LEFT JOIN h ON h.transformer_id=t.transformer_id GROUP BY 1""")
def area_risk(g):
    return r8(A.area_risk(aged(g), g.hourly_load), "avg_health", "avg_age")


@register("aging_by_manufacturer", "SELECT manufacturer, count(*) AS aging_count, round(avg(health_score),8) AS avg_health FROM aged WHERE age_years>30 GROUP BY 1")
def aging_by_manufacturer(g):
    return r8(A.aging_fleet(aged(g)), "avg_health")


@register("substation_capacity", """
WITH c AS (SELECT substation_id, count(*) AS n FROM transformers GROUP BY 1)
SELECT region_id, count(*) AS substation_count, sum(capacity_mva)::bigint AS total_mva, coalesce(sum(n),0)::bigint AS total_transformers FROM substations s LEFT JOIN c ON c.substation_id=s.substation_id GROUP BY 1""")
def substation_capacity(g):
    return A.substation_capacity(g.substations, g.transformers)


@register("bounding_box", """
SELECT circuit_id, min(lat) AS min_lat, max(lat) AS max_lat, min(lon) AS min_lon, max(lon) AS max_lon, (min(lat)+max(lat))/2 AS center_lat, (min(lon)+max(lon))/2 AS center_lon,
 count(*) AS transformer_count, sum(rated_kva)::bigint AS total_kva, round(avg(health_score),8) AS avg_health FROM transformers GROUP BY 1""")
def bounding_box(g):
    return r8(A.location_groups(g.transformers), "avg_health")


@register("ratio_metrics", """
SELECT segment, count(*) AS meter_count, round(count(*)/nullif(count(DISTINCT transformer_id),0),8) AS meters_per_transformer FROM meters GROUP BY 1""")
def ratio_metrics(g):
    return r8(A.meters_per_transformer(g.meters), "meters_per_transformer")


@register("health_score_model", """
SELECT transformer_id, round(least(100.0,greatest(0.0, greatest(0.0,100.0-age_years*1.5)*0.4 + greatest(0.0,100.0-load_utilization_pct*0.5)*0.3 + greatest(0.0,100.0-(k*17%1095)/365.0::double*20.0)*0.3)),6)::double AS modelled_health FROM aged""")
def health_score_model(g):
    out = A.health_score(A.age_years(g.transformers, AS_OF), F.col("k") * 17 % 1095)
    return out.select("transformer_id", F.round("modelled_health", 6).alias("modelled_health"))


@register("score_change", """
WITH s AS (SELECT transformer_id AS asset_id, d.d AS recorded_date, greatest(0.0::double, health_score - d.i*((k*d.i)%9)) AS health_score FROM transformers,
 (VALUES (0, date '2024-01-01'), (1, date '2024-02-01'), (2, date '2024-03-01'), (3, date '2024-04-01')) d(i,d)),
p AS (SELECT *, lag(health_score) OVER (PARTITION BY asset_id ORDER BY recorded_date) AS prev FROM s)
SELECT asset_id, recorded_date, health_score, prev AS previous_score, health_score-prev AS score_change,
 CASE WHEN health_score>=80 THEN 'GOOD' WHEN health_score>=60 THEN 'FAIR' WHEN health_score>=40 THEN 'POOR' ELSE 'CRITICAL' END AS health_category,
 coalesce(health_score-prev<=-10,false) OR health_score<40 AS alert_flag FROM p""")
def score_change(g):
    months = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(d).cast("date").alias("d")) for i, d in enumerate(("2024-01-01", "2024-02-01", "2024-03-01", "2024-04-01"))])
    snaps = g.transformers.select("transformer_id", "health_score", "k", F.explode(months).alias("m")).select(
        F.col("transformer_id").alias("asset_id"),
        F.col("m.d").alias("recorded_date"),
        F.greatest(F.lit(0.0), F.col("health_score") - F.col("m.i") * ((F.col("k") * F.col("m.i")) % 9)).alias("health_score"),
    )
    return A.health_history(snaps)

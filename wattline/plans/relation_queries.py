"""Named queries for the join, set and window shapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattline.functions.calendar import ts
from wattline.functions.hashing import uniform
from wattline.operators import relations as J
from wattline.operators.anchors import latest, topk
from wattline.operators.ordering import positioned, tiled
from wattline.plans.network_queries import aged, r8
from wattline.plans.oracle import hav, u
from wattline.plans.registry import register


@register("join_inner_equi", """
SELECT m.circuit_id, count(*) AS readings, round(sum(usage_kwh),6) AS kwh FROM readings r JOIN meters m ON m.meter_id=r.meter_id GROUP BY 1""")
def join_inner_equi(g):
    per = g.readings.groupBy("meter_id").agg(F.count(F.lit(1)).alias("n"), F.sum("usage_kwh").alias("k"))
    out = per.join(g.meters.select("meter_id", "circuit_id"), "meter_id").groupBy("circuit_id")
    return out.agg(F.sum("n").alias("readings"), F.round(F.sum("k"), 6).alias("kwh"))


@register("join_left_chain", """
SELECT m.meter_id, m.transformer_id, m.circuit_id, t.substation_id, t.rated_kva, c.status AS circuit_status, s.substation_name, m.county, m.segment
FROM meters m LEFT JOIN transformers t ON t.transformer_id=m.transformer_id LEFT JOIN circuits c ON c.circuit_id=m.circuit_id LEFT JOIN substations s ON s.substation_id=t.substation_id""")
def join_left_chain(g):
    return J.meter_context(g.meters, g.transformers, g.circuits, g.substations)


@register("join_multi_hop", """
SELECT s.substation_id, s.substation_name, count(DISTINCT customer_id) AS customer_count FROM customers c JOIN meters m ON m.meter_id=c.meter_id
JOIN transformers t ON t.transformer_id=m.transformer_id JOIN substations s ON s.substation_id=t.substation_id GROUP BY 1,2 ORDER BY 3 DESC, 1 LIMIT 20""")
def join_multi_hop(g):
    return J.customers_per_substation(g.customers, g.meters, g.transformers, g.substations)


@register("join_left_range_on", """
SELECT t.transformer_id, count(h.load_hour) AS recent_hours, round(avg(h.load_factor_pct),8) AS avg_lf FROM transformers t
LEFT JOIN hourly_load h ON h.transformer_id=t.transformer_id AND h.load_hour>=timestamp '2000-06-01' GROUP BY 1""")
def join_left_range_on(g):
    joined = J.left_join_window(g.transformers.select("transformer_id"), g.hourly_load, "transformer_id", "load_hour", ts("2000-06-01 00:00:00"))
    return r8(joined.groupBy("transformer_id").agg(F.count("load_hour").alias("recent_hours"), F.avg("load_factor_pct").alias("avg_lf")), "avg_lf")


@register("join_cross_expand", """
SELECT substation_id, d.day FROM substations CROSS JOIN (SELECT unnest(generate_series(timestamp '2024-01-01', timestamp '2024-01-31', INTERVAL 1 DAY)) AS day) d""")
def join_cross_expand(g):
    from wattline.sources.spines import time_spine

    spine = time_spine(g.spark, "2024-01-01 00:00:00", "2024-01-31 00:00:00", "1 day", "day")
    return J.expand(g.substations.select("substation_id"), spine, "day")


@register("join_cross_rank1", """
SELECT transformer_id, health_score, round(health_score-(SELECT avg(health_score) FROM transformers),8) AS vs_fleet FROM transformers""")
def join_cross_rank1(g):
    mean = g.transformers.agg(F.avg("health_score").alias("m")).scalar()
    return g.transformers.select("transformer_id", "health_score", F.round(F.col("health_score") - mean, 8).alias("vs_fleet"))


@register("join_time_bucket", """
SELECT r.meter_id, r.reading_ts, r.usage_kwh, round(w.temperature_f,6) AS temperature_f FROM readings r LEFT JOIN weather w ON w.hour=date_trunc('hour', r.reading_ts)""")
def join_time_bucket(g):
    out = J.with_weather(g.readings.select("meter_id", "reading_ts", "usage_kwh"), "reading_ts", g.weather)
    return out.select("meter_id", "reading_ts", "usage_kwh", F.round("temperature_f", 6).alias("temperature_f"))


@register("join_anti_orphans", """
SELECT 'pole_of_transformer' AS relation, count(*) AS orphans FROM transformers t LEFT JOIN poles p ON p.transformer_id=t.transformer_id WHERE p.pole_id IS NULL
UNION ALL SELECT 'reading_of_meter', count(*) FROM meters m LEFT JOIN readings r ON r.meter_id=m.meter_id WHERE r.meter_id IS NULL
UNION ALL SELECT 'meter_of_transformer', count(*) FROM transformers t LEFT JOIN meters m ON m.transformer_id=t.transformer_id WHERE m.meter_id IS NULL""")
def join_anti_orphans(g):
    def count(name, child, parent, key):
        return J.orphans(child, parent, key).agg(F.count(F.lit(1)).alias("orphans")).select(F.lit(name).alias("relation"), "orphans")

    return (
        count("pole_of_transformer", g.transformers, g.poles, "transformer_id")
        .unionByName(count("reading_of_meter", g.meters, g.readings, "meter_id"))
        .unionByName(count("meter_of_transformer", g.transformers, g.meters, "transformer_id"))
    )


@register("join_anti_not_exists", "SELECT DISTINCT meter_id FROM readings r WHERE NOT EXISTS (SELECT 1 FROM meters m WHERE m.meter_id=r.meter_id AND m.segment<>'BUILDING')")
def join_anti_not_exists(g):
    return J.orphan_readings(g.readings, g.meters.where("segment <> 'BUILDING'"))


@register("join_semi_exists", "SELECT meter_id, segment FROM meters m WHERE EXISTS (SELECT 1 FROM readings r WHERE r.meter_id=m.meter_id)")
def join_semi_exists(g):
    return J.linked(g.meters.select("meter_id", "segment"), g.readings, "meter_id")


@register("join_full_outer_diff", """
WITH s AS (SELECT county AS table_name, count(*) AS n FROM meters WHERE county<>'County4' GROUP BY 1), t AS (SELECT county AS table_name, count(*) AS n FROM meters WHERE county<>'County0' AND (county<>'County1' OR k%2=0) GROUP BY 1)
SELECT coalesce(s.table_name,t.table_name) AS table_name, s.n AS source_rows, t.n AS target_rows, CASE WHEN t.n IS NULL THEN 'MISSING' WHEN s.n IS NULL THEN 'NEW_TABLE' WHEN s.n=t.n THEN 'PASS' ELSE 'ROW_COUNT_DIFF' END AS status
FROM s FULL OUTER JOIN t ON s.table_name=t.table_name""")
def join_full_outer_diff(g):
    def counts(df):
        return df.groupBy(F.col("county").alias("table_name")).agg(F.count(F.lit(1)).alias("row_count"))

    return J.count_diff(
        counts(g.meters.where("county <> 'County4'")),
        counts(g.meters.where("county <> 'County0' AND (county <> 'County1' OR k % 2 = 0)")),
    )


@register("join_preagg", "SELECT t.transformer_id, (SELECT count(*) FROM meters m WHERE m.transformer_id=t.transformer_id) AS meter_count FROM transformers t")
def join_preagg(g):
    return J.with_child_counts(g.transformers.select("transformer_id"), g.meters, "transformer_id", "meter_count")


METRO = """
SELECT s.substation_id, s.substation_name, s.lat, s.lon, s.capacity_mva,
 (SELECT round(avg(h.load_factor_pct),2) FROM hourly_load h JOIN transformers t ON t.transformer_id=h.transformer_id WHERE t.substation_id=s.substation_id AND h.load_hour>=(SELECT max(load_hour) FROM hourly_load)-INTERVAL 90 DAY) AS avg_load_pct,
 (SELECT count(*) FROM circuits c WHERE c.substation_id=s.substation_id AND c.status='OUTAGE') AS active_outages,
 (SELECT count(*) FROM transformers t WHERE t.substation_id=s.substation_id) AS transformer_count,
 (SELECT coalesce(sum(rated_kva),0) FROM transformers t WHERE t.substation_id=s.substation_id)::bigint AS total_capacity_kva FROM substations s"""


@register("join_corr_scalar", METRO)
def join_corr_scalar(g):
    since = latest(g.hourly_load, "load_hour") - F.expr("interval 90 days")
    return J.metro(g.substations, g.circuits, g.transformers, g.hourly_load, since)


@register("topology_circuits", """
WITH v AS (SELECT m.circuit_id, avg(voltage_v) AS v FROM readings r JOIN meters m ON m.meter_id=r.meter_id WHERE reading_ts>=(SELECT max(reading_ts) FROM readings)-INTERVAL 1 DAY GROUP BY 1)
SELECT c.circuit_id, c.substation_id, c.status, s.substation_name, (SELECT count(*) FROM meters m WHERE m.circuit_id=c.circuit_id) AS meter_count, round(v.v,8) AS avg_voltage, c.status='OUTAGE' AS has_outage
FROM circuits c LEFT JOIN substations s ON s.substation_id=c.substation_id LEFT JOIN v ON v.circuit_id=c.circuit_id""")
def topology_circuits(g):
    since = latest(g.readings, "reading_ts") - F.expr("interval 1 day")
    return r8(J.circuit_view(g.circuits, g.substations, g.meters, g.readings, since), "avg_voltage")


@register("topology_views", """
SELECT s.substation_id AS service_area_id, substation_name AS service_area_name, lat AS center_lat, lon AS center_lon, capacity_mva AS total_capacity_mva,
 (SELECT count(*) FROM meters m WHERE m.substation_id=s.substation_id) AS customer_count, (SELECT count(*) FROM transformers t WHERE t.substation_id=s.substation_id) AS transformer_count,
 (SELECT count(*) FROM circuits c WHERE c.substation_id=s.substation_id) AS circuit_count,
 round((SELECT sum(customers*date_sub('minute',start_ts,end_ts)) FROM outages o WHERE o.substation_id=s.substation_id)/nullif((SELECT count(*) FROM meters m WHERE m.substation_id=s.substation_id),0),6) AS saidi_minutes FROM substations s""")
def topology_views(g):
    out = J.service_areas(g.substations, g.circuits, g.transformers, g.meters, g.outages)
    return out.withColumn("saidi_minutes", F.round("saidi_minutes", 6))


@register("join_fanout_guard", f"""
SELECT t.substation_id, t.transformer_id, 'SUBSTATION_TO_TRANSFORMER' AS connection_type, s.lat AS from_lat, s.lon AS from_lon, t.lat AS to_lat, t.lon AS to_lon, t.load_utilization_pct,
 (SELECT min(circuit_id) FROM circuits c WHERE c.substation_id=t.substation_id) AS circuit_id, t.rated_kva, round({hav('s.lat','s.lon','t.lat','t.lon')},6) AS distance_km, '12.47 kV' AS voltage_level
FROM transformers t JOIN substations s ON s.substation_id=t.substation_id""")
def join_fanout_guard(g):
    return J.feeders(g.transformers, g.substations, g.circuits).withColumn("distance_km", F.round("distance_km", 6))


@register("join_rank_match", """
WITH sc AS (SELECT row_number() OVER (ORDER BY r_regionkey) AS rnk, r_name AS scenario FROM region),
rk AS (SELECT substation_id, capacity_mva, row_number() OVER (ORDER BY capacity_mva DESC NULLS LAST, substation_id) AS rnk FROM substations)
SELECT sc.scenario, sc.rnk, rk.substation_id, rk.capacity_mva FROM sc JOIN rk ON rk.rnk=sc.rnk""")
def join_rank_match(g):
    scenarios = positioned(g.raw("region").select("r_regionkey", F.col("r_name").alias("scenario")), [F.col("r_regionkey").asc()], position="rnk")
    ranked = positioned(g.substations.select("substation_id", "capacity_mva"), [F.col("capacity_mva").desc_nulls_last(), F.col("substation_id").asc()], position="rnk")
    return scenarios.join(ranked, "rnk").select("scenario", "rnk", "substation_id", "capacity_mva")


@register("join_random_relink", f"""
WITH p AS (SELECT pole_id, row_number() OVER (ORDER BY pole_id) AS rn FROM poles)
SELECT m.meter_id, p.pole_id FROM meters m JOIN p ON p.rn=floor({u("m.meter_id||'pole'")}*(SELECT count(*) FROM poles))+1""")
def join_random_relink(g):
    return J.relink(g.meters.select("meter_id"), "meter_id", g.poles, "pole_id")


@register("join_self_siblings", """
SELECT a.transformer_id, b.transformer_id AS sibling_id FROM transformers a JOIN transformers b ON a.substation_id=b.substation_id AND a.transformer_id<>b.transformer_id
WHERE a.transformer_id IN (SELECT transformer_id FROM transformers ORDER BY health_score, transformer_id LIMIT 1)""")
def join_self_siblings(g):
    wanted = topk(g.transformers.select("transformer_id", "health_score"), [F.col("health_score").asc(), F.col("transformer_id").asc()], 1)
    return J.siblings(g.transformers, wanted)


@register("join_or_membership", "SELECT transformer_id, substation_id FROM transformers WHERE substation_id='SUB-0003' OR (true AND substation_id IN ('SUB-0004','SUB-0009'))")
def join_or_membership(g):
    return J.affected_assets(g.transformers, "SUB-0003", ["SUB-0004", "SUB-0009"]).select("transformer_id", "substation_id")


@register("join_key_using", "SELECT customer_id, meter_id, transformer_id, county FROM customers JOIN meters USING (meter_id)")
def join_key_using(g):
    return g.customers.join(g.meters, on="meter_id").select("customer_id", "meter_id", "transformer_id", "county")


@register("join_lateral_flatten", "SELECT transformer_id, unnest([circuit_id, substation_id]) AS upstream_id FROM transformers")
def join_lateral_flatten(g):
    return J.flatten(g.transformers.select("transformer_id", F.array("circuit_id", "substation_id").alias("ups")), "ups", "upstream_id")


@register("key_normalize", """
WITH k AS (SELECT transformer_id, CASE k%4 WHEN 0 THEN 'SUB-HOU-0'||right(substation_id,3) WHEN 1 THEN 'SUB_'||right(substation_id,4) WHEN 2 THEN substation_id ELSE 'X' END AS legacy FROM transformers),
n AS (SELECT *, CASE WHEN regexp_matches(legacy,'^SUB-HOU-[0-9]+$') THEN 'SUB-HOU-'||lpad(cast(cast(substr(legacy,9) AS bigint) AS varchar),3,'0') WHEN regexp_matches(legacy,'^SUB_[0-9]+$') THEN 'SUB-'||lpad(cast(cast(substr(legacy,5) AS bigint) AS varchar),4,'0') ELSE legacy END AS guess FROM k)
SELECT transformer_id, legacy, s.substation_id AS normalized FROM n LEFT JOIN substations s ON s.substation_id=n.guess""")
def key_normalize(g):
    k = F.col("k") % 4
    rows = g.transformers.select(
        "transformer_id",
        F.when(k == 0, F.concat(F.lit("SUB-HOU-0"), F.right("substation_id", F.lit(3))))
        .when(k == 1, F.concat(F.lit("SUB_"), F.right("substation_id", F.lit(4))))
        .when(k == 2, F.col("substation_id")).otherwise("X").alias("legacy"),
    )
    return J.normalize_key(rows, "legacy", g.substations, "substation_id")


@register("key_xref", """
SELECT s.substation_id AS canonical_id, 'OLD'||t.k%30 AS source_id, t.transformer_id FROM transformers t JOIN substations s ON 'OLD'||s.k='OLD'||t.k%30""")
def key_xref(g):
    xref = g.substations.select(F.lit("legacy").alias("source_system"), F.concat(F.lit("OLD"), F.col("k").cast("string")).alias("source_id"), F.col("substation_id").alias("canonical_id"))
    rows = g.transformers.select("transformer_id", F.concat(F.lit("OLD"), (F.col("k") % 30).cast("string")).alias("source_id"))
    return J.apply_xref(rows, "source_id", xref, "legacy")


# ---------------------------------------------------------------- windows, sets, samples

@register("latest_per_key", """
SELECT meter_id, reading_ts, usage_kwh FROM (SELECT *, row_number() OVER (PARTITION BY meter_id ORDER BY reading_ts DESC) AS rn FROM readings) WHERE rn=1""")
def latest_per_key(g):
    from wattline.operators.maintenance import latest_per_key as latest_rows

    return latest_rows(g.readings, ["meter_id"], ["reading_ts"]).select("meter_id", "reading_ts", "usage_kwh")


@register("global_sequence", "SELECT meter_id, reading_ts, row_number() OVER (ORDER BY reading_ts, meter_id) AS seq FROM readings")
def global_sequence(g):
    return positioned(g.readings.select("meter_id", "reading_ts"), [F.col("reading_ts").asc(), F.col("meter_id").asc()], position="seq")


@register("rank_nulls_last", """
SELECT substation_id, nullif(capacity_mva, 137) AS capacity, row_number() OVER (ORDER BY nullif(capacity_mva,137) DESC NULLS LAST, substation_id) AS rnk FROM substations""")
def rank_nulls_last(g):
    rows = g.substations.select("substation_id", F.nullif(F.col("capacity_mva"), F.lit(137)).alias("capacity"))
    return positioned(rows, [F.col("capacity").desc_nulls_last(), F.col("substation_id").asc()], position="rnk")


@register("ntile_buckets", """
WITH b AS (SELECT meter_id, avg(usage_kwh) AS base FROM readings GROUP BY 1)
SELECT meter_id, ntile(5) OVER (ORDER BY round(base,8), meter_id) AS quintile FROM b""")
def ntile_buckets(g):
    base = g.readings.groupBy("meter_id").agg(F.round(F.avg("usage_kwh"), 8).alias("base"))
    return tiled(base, [F.col("base").asc(), F.col("meter_id").asc()], 5, "quintile").select("meter_id", "quintile")


@register("topk", "SELECT transformer_id, load_hour, load_kw FROM hourly_load ORDER BY load_kw DESC, transformer_id, load_hour LIMIT 25")
def topk_query(g):
    return topk(g.hourly_load.select("transformer_id", "load_hour", "load_kw"), [F.col("load_kw").desc_nulls_last(), F.col("transformer_id").asc(), F.col("load_hour").asc()], 25)


@register("random_sample", f"SELECT meter_id FROM meters ORDER BY {u("meter_id||'7'")}, meter_id LIMIT 40")
def random_sample(g):
    from wattline.sources.files import sample_rows

    return sample_rows(g.meters.select("meter_id"), 40, "meter_id", seed=7)


@register("hash_split", f"SELECT meter_id, CASE WHEN {u("meter_id||'42'")}<0.8 THEN 'train' ELSE 'test' END AS part FROM meters")
def hash_split(g):
    from wattline.operators.learning import split_label

    return g.meters.select("meter_id", split_label("meter_id", 0.8, 42).alias("part"))


@register("union_all", """
SELECT substation_id AS asset_id, 'SUBSTATION' AS asset_type, NULL::varchar AS parent_id FROM substations
UNION ALL SELECT circuit_id, 'CIRCUIT', substation_id FROM circuits UNION ALL SELECT transformer_id, 'TRANSFORMER', circuit_id FROM transformers UNION ALL SELECT meter_id, 'METER', transformer_id FROM meters""")
def union_all(g):
    from wattline.operators.graph import hierarchy_nodes

    return hierarchy_nodes(g.substations, g.circuits, g.transformers, g.meters).select("asset_id", "asset_type", "parent_id")


@register("count_summary", """
SELECT 'substations' AS table_name, count(*) AS row_count FROM substations UNION ALL SELECT 'circuits', count(*) FROM circuits UNION ALL SELECT 'transformers', count(*) FROM transformers
UNION ALL SELECT 'meters', count(*) FROM meters UNION ALL SELECT 'readings', count(*) FROM readings UNION ALL SELECT 'outages', count(*) FROM outages""")
def count_summary(g):
    from wattline.operators.quality import table_counts

    return table_counts({n: getattr(g, n) for n in ("substations", "circuits", "transformers", "meters", "readings", "outages")})


@register("conditional_pivot", """
SELECT county, round(avg(usage_kwh) FILTER (dayofweek(reading_ts) IN (0,6)),8) AS weekend_kwh, round(avg(usage_kwh) FILTER (dayofweek(reading_ts) NOT IN (0,6)),8) AS weekday_kwh
FROM readings r JOIN meters m ON m.meter_id=r.meter_id GROUP BY 1""")
def conditional_pivot(g):
    kind = F.when(F.dayofweek("reading_ts").isin(1, 7), "weekend").otherwise("weekday")
    rows = g.readings.withColumn("kind", kind).join(g.meters.select("meter_id", "county"), "meter_id")
    wide = rows.groupBy("county").pivot("kind", ["weekend", "weekday"]).agg(F.avg("usage_kwh"))
    return wide.select("county", F.round("weekend", 8).alias("weekend_kwh"), F.round("weekday", 8).alias("weekday_kwh"))


@register("ordered_collect", """
WITH c AS (SELECT substation_id, cause, count(*) AS n FROM outages GROUP BY 1,2) SELECT substation_id, list(cause||'='||n ORDER BY cause) AS causes FROM c GROUP BY 1""")
def ordered_collect(g):
    # one array entry per cause, counted before it is collected
    counts = g.outages.groupBy("substation_id", "cause").agg(F.count(F.lit(1)).alias("n"))
    rows = counts.groupBy("substation_id").agg(F.sort_array(F.collect_list(F.struct("cause", "n"))).alias("s"))
    return rows.select("substation_id", F.transform("s", lambda x: F.concat_ws("=", x["cause"], x["n"])).alias("causes"))


@register("distinct_listagg", "SELECT transformer_id, string_agg(DISTINCT segment, ', ' ORDER BY segment) AS segments FROM meters GROUP BY 1")
def distinct_listagg(g):
    return g.meters.select("transformer_id", "segment").distinct().groupBy("transformer_id").agg(F.array_join(F.sort_array(F.collect_set("segment")), ", ").alias("segments"))


@register("corr_temp", """
WITH h AS (SELECT date_trunc('hour', reading_ts) AS hr, avg(usage_kwh) AS k FROM readings WHERE quality='VALID' GROUP BY 1)
SELECT count(*) AS hours, round(corr(k, temperature_f),8) AS corr_value FROM h JOIN weather w ON w.hour=h.hr""")
def corr_temp(g):
    from wattline.operators.quality import hourly_weather

    return hourly_weather(g.readings.where("quality = 'VALID'"), g.weather).agg(F.count(F.lit(1)).alias("hours"), F.round(F.corr("avg_kwh", "temperature_f"), 8).alias("corr_value"))


@register("ingest_latency", f"""
SELECT round(avg(cast(floor({u("meter_id||'lat'")}*900) AS bigint)),8) AS avg_latency_seconds, count(*) AS n FROM readings""")
def ingest_latency(g):
    delay = F.floor(uniform(F.concat(F.col("meter_id"), F.lit("lat"))) * 900).cast("int")
    arrived = F.col("reading_ts") + F.make_interval(secs=delay)
    return r8(g.readings.agg(F.avg(F.timestamp_diff("SECOND", F.col("reading_ts"), arrived)).alias("avg_latency_seconds"), F.count(F.lit(1)).alias("n")), "avg_latency_seconds")


@register("kpi_row", """
SELECT (SELECT count(*) FROM customers WHERE account_status='ACTIVE') AS active_customers, (SELECT count(*) FROM outages WHERE status='ACTIVE') AS active_outages,
 (SELECT sum(customers) FROM outages WHERE status='ACTIVE')::bigint AS customers_out, (SELECT round(avg(health_score),8) FROM transformers) AS avg_health,
 (SELECT count(*) FROM transformers WHERE load_utilization_pct>100) AS overloaded, (SELECT sum(capacity_mva) FROM substations)::bigint AS capacity_mva""")
def kpi_row(g):
    def one(df, agg, name):
        return df.agg(agg.alias(name)).scalar().alias(name)

    active = g.outages.where("status = 'ACTIVE'")
    return g.spark.range(1).select(
        one(g.customers.where("account_status = 'ACTIVE'"), F.count(F.lit(1)), "active_customers"),
        one(active, F.count(F.lit(1)), "active_outages"),
        one(active, F.sum("customers"), "customers_out"),
        one(g.transformers, F.round(F.avg("health_score"), 8), "avg_health"),
        one(g.transformers.where("load_utilization_pct > 100"), F.count(F.lit(1)), "overloaded"),
        one(g.substations, F.sum("capacity_mva"), "capacity_mva"),
    )


# ---------------------------------------------------------------- scalar function wrappers

@register("fn_date", """
SELECT meter_id, reading_ts, date_trunc('hour', reading_ts)::timestamp AS h, cast(reading_ts AS date) AS d, extract(minute from reading_ts) AS mi, extract(second from reading_ts)::bigint AS se,
 month(reading_ts) AS mo, year(reading_ts) AS y, dayofweek(reading_ts) AS dow, substr(dayname(reading_ts),1,3) AS dn FROM readings""")
def fn_date(g):
    from wattline.functions.calendar import day_of_week, trunc

    c = F.col("reading_ts")
    return g.readings.select(
        "meter_id", "reading_ts", trunc("HOUR", c).alias("h"), F.to_date(c).alias("d"), F.minute(c).alias("mi"), F.second(c).alias("se"),
        F.month(c).alias("mo"), F.year(c).alias("y"), day_of_week(c).alias("dow"), F.dayname(c).alias("dn"),
    )


@register("fn_date_arith", """
SELECT outage_id, start_ts + INTERVAL 90 MINUTE AS plus90, date_diff('hour', start_ts, end_ts) AS hour_boundaries, date_sub('hour', start_ts, end_ts) AS whole_hours,
 date_diff('day', start_ts, end_ts) AS day_boundaries FROM outages""")
def fn_date_arith(g):
    from wattline.functions.calendar import NTZ, boundary_diff

    s, e = F.col("start_ts"), F.col("end_ts")
    return g.outages.select(
        "outage_id", (s + F.expr("interval 90 minutes")).cast(NTZ).alias("plus90"), boundary_diff("HOUR", s, e).alias("hour_boundaries"),
        F.timestamp_diff("HOUR", s, e).alias("whole_hours"), boundary_diff("DAY", s, e).alias("day_boundaries"),
    )


@register("fn_try", """
SELECT k, try_cast(CASE WHEN k%3=0 THEN 'x' ELSE cast(k/4 AS varchar) END AS double) AS num, try_cast(CASE WHEN k%5=0 THEN 'bad' ELSE '2024-01-1'||k%10 END AS date) AS d FROM meters""")
def fn_try(g):
    k = F.col("k")
    return g.meters.select(
        "k",
        F.when(k % 3 == 0, "x").otherwise((k / 4).cast("string")).try_cast("double").alias("num"),
        F.when(k % 5 == 0, "bad").otherwise(F.concat(F.lit("2024-01-1"), (k % 10).cast("string"))).try_cast("date").alias("d"),
    )


@register("fn_string", """
SELECT transformer_id, lower(transformer_id)||'/'||right(circuit_id,3) AS joined, replace(manufacturer,'Brand#','B') AS brand, split_part(substation_id,'-',2) AS part,
 starts_with(manufacturer,'Brand#1') AS b1, regexp_extract(manufacturer,'[0-9]+') AS digits, lpad(cast(k%100 AS varchar),4,'0') AS padded, role LIKE '%O%' AS has_o FROM transformers""")
def fn_string(g):
    return g.transformers.select(
        "transformer_id",
        F.concat(F.lower("transformer_id"), F.lit("/"), F.right("circuit_id", F.lit(3))).alias("joined"),
        F.replace(F.col("manufacturer"), F.lit("Brand#"), F.lit("B")).alias("brand"),
        F.split_part(F.col("substation_id"), F.lit("-"), F.lit(2)).alias("part"),
        F.startswith(F.col("manufacturer"), F.lit("Brand#1")).alias("b1"),
        F.regexp_extract("manufacturer", "[0-9]+", 0).alias("digits"),
        F.lpad((F.col("k") % 100).cast("string"), 4, "0").alias("padded"),
        F.col("role").like("%O%").alias("has_o"),
    )


@register("fn_cond", """
SELECT meter_id, reading_ts, CASE WHEN voltage_v BETWEEN 114 AND 126 THEN 'ok' ELSE 'off' END AS band, coalesce(nullif(usage_kwh,0.0),-1.0::double) AS usage_or, quality IN ('VALID','ESTIMATED') AS usable FROM readings""")
def fn_cond(g):
    return g.readings.select(
        "meter_id", "reading_ts", F.when(F.col("voltage_v").between(114, 126), "ok").otherwise("off").alias("band"),
        F.coalesce(F.nullif(F.col("usage_kwh"), F.lit(0.0)), F.lit(-1.0)).alias("usage_or"), F.col("quality").isin("VALID", "ESTIMATED").alias("usable"),
    )


@register("fn_hash", "SELECT meter_id, md5(meter_id) AS m, sha256(meter_id) AS s2 FROM meters")
def fn_hash(g):
    return g.meters.select("meter_id", F.md5("meter_id").alias("m"), F.sha2("meter_id", 256).alias("s2"))


@register("fn_random", f"SELECT meter_id, {u("meter_id||'a'")} AS u1, cast(floor({u('meter_id')}*6)+1 AS bigint) AS die, round(sqrt(-2*ln(1-{u("meter_id||'n#1'")}))*cos(2*pi()*{u("meter_id||'n#2'")}),8) AS gauss FROM meters")
def fn_random(g):
    from wattline.functions.hashing import keyed_normal, keyed_uniform, uniform_int

    m = F.col("meter_id")
    return g.meters.select("meter_id", keyed_uniform(m, "a").alias("u1"), uniform_int(1, 6, m).alias("die"), F.round(keyed_normal(m, "n"), 8).alias("gauss"))


@register("fn_array", """
SELECT transformer_id, len([circuit_id, substation_id, role]) AS n, list_contains([circuit_id, substation_id],'SUB-0005') AS has5, list_append([circuit_id], manufacturer) AS arr FROM transformers""")
def fn_array(g):
    return g.transformers.select(
        "transformer_id", F.size(F.array("circuit_id", "substation_id", "role")).alias("n"),
        F.array_contains(F.array("circuit_id", "substation_id"), "SUB-0005").alias("has5"), F.array_append(F.array("circuit_id"), F.col("manufacturer")).alias("arr"),
    )


@register("fn_object", """
SELECT event_id, cast(json_extract_string(props,'$.k') AS bigint) AS k, '{"id":'||event_id||',"type":"'||event_type||'"}' AS payload FROM events""")
def fn_object(g):
    v = F.parse_json(F.col("props"))
    return g.raw("events").select(
        "event_id", F.variant_get(v, "$.k", "bigint").alias("k"),
        F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"), F.lit(None).cast("string").alias("gone"))).alias("payload"),
    )


@register("payload_status", """
SELECT event_id, CASE WHEN k%3=0 THEN 'FAIL' ELSE 'PASS' END AS verdict, 'r'||k%7 AS reason FROM (SELECT event_id, cast(json_extract_string(props,'$.k') AS int) AS k FROM events)""")
def payload_status(g):
    from wattline.sources.landing import run_status

    k = F.get_json_object("props", "$.k").cast("int")
    runs = g.raw("events").select("event_id", F.to_json(F.struct(F.when(k % 3 == 0, "FAIL").otherwise("PASS").alias("verdict"), F.concat(F.lit("r"), (k % 7).cast("string")).alias("reason"))).alias("validation"))
    return run_status(runs, "validation").select("event_id", "verdict", "reason")


@register("primary_metric", """
WITH m AS (SELECT 'M'||k AS model_id, CASE WHEN k%3=0 THEN k/100.0::double END AS accuracy, CASE WHEN k%3<=1 THEN k/90.0::double END AS auc, (k*7)::double AS rmse, CASE WHEN k%4=0 THEN 'STAGING' ELSE 'PRODUCTION' END AS status FROM substations)
SELECT model_id, round(coalesce(accuracy, auc, 1-rmse/1000),8) AS primary_metric FROM m WHERE status='PRODUCTION'""")
def primary_metric(g):
    from wattline.operators.learning import production_models

    k = F.col("k")
    catalog = g.substations.select(
        F.concat(F.lit("M"), k.cast("string")).alias("model_id"), F.when(k % 3 == 0, k / 100.0).alias("accuracy"),
        F.when(k % 3 <= 1, k / 90.0).alias("auc"), (k * 7).cast("double").alias("rmse"), F.when(k % 4 == 0, "STAGING").otherwise("PRODUCTION").alias("status"),
    )
    return r8(production_models(catalog).select("model_id", "primary_metric"), "primary_metric")


@register("row_to_payload", """
SELECT transformer_id, '{"circuit_id":"'||circuit_id||'","rated_kva":'||rated_kva||'}' AS payload FROM transformers""")
def row_to_payload(g):
    from wattline.sources.landing import to_payload

    return to_payload(g.transformers, ["circuit_id", "rated_kva"]).select("transformer_id", "payload")


@register("class_bucket", """
SELECT meter_id, CASE segment WHEN 'HOUSEHOLD' THEN 'RES' WHEN 'BUILDING' THEN 'COM' WHEN 'FURNITURE' THEN 'COM' WHEN 'MACHINERY' THEN 'IND' WHEN 'AUTOMOBILE' THEN 'GOV' END AS bucket FROM meters""")
def class_bucket(g):
    from wattline.functions.rules import class_bucket as bucket
    from wattline.operators.modelling import class_of_segment

    return g.meters.select("meter_id", bucket(class_of_segment(F.col("segment"))).alias("bucket"))


@register("segment_multiplier", """
SELECT customer_id, segment, coalesce(CASE segment WHEN 'HOUSEHOLD' THEN 1.0::double WHEN 'MACHINERY' THEN 2.5 END, 1.2) AS load_multiplier, coalesce(CASE segment WHEN 'HOUSEHOLD' THEN true WHEN 'MACHINERY' THEN false END, false) AS solar_eligible FROM customers""")
def segment_multiplier(g):
    from wattline.operators.modelling import with_multiplier

    config = g.spark.createDataFrame([("HOUSEHOLD", 1.0, True), ("MACHINERY", 2.5, False)], "segment string, load_multiplier double, solar_eligible boolean")
    return with_multiplier(g.customers, config, 1.2).select("customer_id", "segment", "load_multiplier", "solar_eligible")


@register("rollup_aged", "SELECT location_area, manufacturer, count(*) AS n FROM aged GROUP BY CUBE(location_area, manufacturer)")
def rollup_aged(g):
    return aged(g).cube("location_area", "manufacturer").agg(F.count(F.lit(1)).alias("n"))

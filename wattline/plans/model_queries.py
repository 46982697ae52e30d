"""Named queries for load modelling, quality checks, learning and the semantic layer."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattline.functions.hashing import keyed_uniform
from wattline.operators import assets as A
from wattline.operators import learning as M
from wattline.operators import load as L
from wattline.operators import modelling as S
from wattline.operators import outages as O
from wattline.operators import quality as Q
from wattline.operators import readings as R
from wattline.operators.relations import dealt
from wattline.plans.network_queries import aged, r8
from wattline.plans.oracle import hav, u
from wattline.plans.registry import register
from wattline.plans.semantic import grid_model
from wattline.session import cut
from wattline.sources.spines import time_spine

HOLIDAY = "2024-01-15"
STORM = ("2024-01-07 00:00:00", "2024-01-08 02:00:00")


def classed(g):
    return g.meters.withColumn("customer_class", S.class_of_segment(F.col("segment")))


CLASS = "CASE segment WHEN 'HOUSEHOLD' THEN 'HIGH_INCOME' WHEN 'BUILDING' THEN 'COM_SMALL' WHEN 'FURNITURE' THEN 'COM_LARGE' WHEN 'MACHINERY' THEN 'IND_LIGHT' WHEN 'AUTOMOBILE' THEN 'GOV_LOCAL' END"

PERSONA = f"""cm AS (SELECT *, {CLASS} AS customer_class FROM meters),
 pe AS (SELECT meter_id, transformer_id, lat, customer_class, CASE WHEN customer_class LIKE '%INCOME' THEN 'RES' ELSE substr(customer_class,1,3) END AS class_bucket,
 round(0.7::double+0.6::double*{u("meter_id||'_size'")},3) AS home_size_factor, customer_class='HIGH_INCOME' AND {u("meter_id||'_solar'")}<0.10 AS has_solar, customer_class='HIGH_INCOME' AND {u("meter_id||'_ev'")}<0.15 AS has_ev,
 customer_class='HIGH_INCOME' AND lat>29.7 AND {u("meter_id||'_pool'")}<0.25 AS has_pool_pump,
 (CASE WHEN lat>=30.10 THEN -2.5 WHEN lat>=29.95 THEN -1.5 WHEN lat>=29.75 THEN -0.5 WHEN lat<=29.50 THEN 1.5 ELSE 0.0 END)::double AS microclimate_offset_f,
 (CASE customer_class WHEN 'IND_LIGHT' THEN 0.88 WHEN 'COM_LARGE' THEN 0.92 WHEN 'COM_SMALL' THEN 0.95 ELSE 0.97 END)::double AS pf_base,
 (CASE customer_class WHEN 'HIGH_INCOME' THEN 0.95 WHEN 'COM_SMALL' THEN 0.85 WHEN 'COM_LARGE' THEN 4.5 WHEN 'IND_LIGHT' THEN 7.0 WHEN 'GOV_LOCAL' THEN 1.6 END)::double AS base_per_15min FROM cm)"""


@register("meter_personas", f"WITH {PERSONA} SELECT * FROM pe")
def meter_personas(g):
    return S.personas(classed(g))


def _curve_sql() -> str:
    rows = [f"('{b}',{h},{v}::double)" for b, vals in S.DIURNAL.items() for h, v in enumerate(vals)]
    return "SELECT * FROM (VALUES " + ",".join(rows) + ") v(b,h,m)"


def _case(table: dict) -> str:
    return "(CASE class_bucket " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in table.items()) + " END)::double"


_NINE_DAYS = "SELECT unnest(generate_series(timestamp '2024-01-07 00:00:00', timestamp '2024-01-15 23:45:00', INTERVAL 15 MINUTE)) AS slot_ts"


def _load_sql(agg: str, slots: str = _NINE_DAYS) -> str:
    t = "(coalesce(w.temperature_f,85.0)+microclimate_offset_f)"
    return f"""
WITH {PERSONA}, sp AS ({slots}),
cv AS ({_curve_sql()}), os AS (SELECT DISTINCT transformer_id, sp.slot_ts FROM outages JOIN sp ON sp.slot_ts BETWEEN start_ts AND end_ts),
x AS (SELECT pe.*, sp.slot_ts, os.slot_ts IS NOT NULL AS out, cv.m * (1.0::double + {_case(S.COOLING)}*greatest(0.0::double,{t}-72) + {_case(S.HEATING)}*greatest(0.0::double,60-{t}) + {_case(S.HUMIDITY)}*(coalesce(w.humidity_pct,70)-50))
 * CASE dayofweek(sp.slot_ts) WHEN 0 THEN {_case(S.SUNDAY)} WHEN 6 THEN {_case(S.SATURDAY)} ELSE 1.0::double END
 * CASE WHEN cast(sp.slot_ts AS date)=DATE '{HOLIDAY}' THEN {_case(S.HOLIDAY)} ELSE 1.0::double END
 * CASE WHEN sp.slot_ts BETWEEN '{STORM[0]}' AND '{STORM[1]}' AND lat<29.95 THEN 1.15::double ELSE 1.0::double END
 * home_size_factor * CASE WHEN has_solar AND extract(hour from sp.slot_ts) BETWEEN 10 AND 16 THEN 0.55::double ELSE 1.0::double END AS f,
 CASE WHEN has_ev AND (extract(hour from sp.slot_ts)>=23 OR extract(hour from sp.slot_ts)<=5) THEN 0.4::double ELSE 0.0::double END + CASE WHEN has_pool_pump AND extract(hour from sp.slot_ts) BETWEEN 4 AND 7 THEN 0.25::double ELSE 0.0::double END AS extra
 FROM pe CROSS JOIN sp LEFT JOIN weather w ON w.hour=date_trunc('hour', sp.slot_ts) JOIN cv ON cv.b=pe.class_bucket AND cv.h=extract(hour from sp.slot_ts) LEFT JOIN os ON os.transformer_id=pe.transformer_id AND os.slot_ts=sp.slot_ts),
lm AS (SELECT meter_id, slot_ts AS reading_ts, CASE WHEN out THEN 0 ELSE base_per_15min*f+extra END AS usage_kwh, round(CASE WHEN out THEN 0 ELSE 120.0::double-4.0*(base_per_15min/5.0) END,2) AS voltage_v,
 round(CASE WHEN out THEN 0 ELSE greatest(0.01::double, base_per_15min*home_size_factor*4*1000/(120.0*pf_base)) END,2) AS current_a, CASE WHEN out THEN 'OUTAGE' ELSE 'VALID' END AS quality FROM x)
{agg}"""


def modelled(g):
    spine = time_spine(g.spark, "2024-01-07 00:00:00", "2024-01-15 23:45:00")
    return S.expected_load(S.personas(classed(g)), spine, g.weather, O.outage_slots(g.outages), [HOLIDAY], STORM, kwh_digits=10)


@register("load_model", _load_sql("""
SELECT meter_id, cast(reading_ts AS date) AS day, count(*) AS slots, count_if(quality='OUTAGE') AS outage_slots, round(sum(usage_kwh),4) AS kwh, round(sum(voltage_v),4) AS voltage_sum, round(sum(current_a),4) AS current_sum FROM lm GROUP BY 1,2"""))
def load_model(g):
    out = modelled(g).groupBy("meter_id", F.to_date("reading_ts").alias("day"))
    return out.agg(
        F.count(F.lit(1)).alias("slots"), F.sum(F.when(F.col("quality") == "OUTAGE", 1).otherwise(0)).alias("outage_slots"),
        F.round(F.sum("usage_kwh"), 4).alias("kwh"), F.round(F.sum("voltage_v"), 4).alias("voltage_sum"), F.round(F.sum("current_a"), 4).alias("current_sum"),
    )


TYPE = "CASE segment WHEN 'HOUSEHOLD' THEN 'RESIDENTIAL' WHEN 'MACHINERY' THEN 'INDUSTRIAL' WHEN 'AUTOMOBILE' THEN 'OTHER' ELSE 'COMMERCIAL' END"


def _typed(g):
    s = F.col("segment")
    kind = F.when(s == "HOUSEHOLD", "RESIDENTIAL").when(s == "MACHINERY", "INDUSTRIAL").when(s == "AUTOMOBILE", "OTHER").otherwise("COMMERCIAL")
    return g.meters.withColumn("meter_type", kind)


@register("simple_load_model", f"""
WITH sp AS (SELECT unnest(generate_series(timestamp '2024-01-06 00:00:00', timestamp '2024-01-06 23:45:00', INTERVAL 15 MINUTE)) AS t),
m AS (SELECT meter_id, {TYPE} AS ty FROM meters), x AS (SELECT meter_id, t, extract(hour from t) AS h, (CASE ty WHEN 'RESIDENTIAL' THEN 1.5 WHEN 'COMMERCIAL' THEN 15.0 WHEN 'INDUSTRIAL' THEN 150.0 ELSE 2.0 END)::double AS b,
 {u("meter_id||'@'||strftime(t,'%Y%m%d%H%M')||'kwh'")} AS un FROM m CROSS JOIN sp)
SELECT meter_id, t AS reading_ts, round(b*0.25::double*(CASE WHEN h BETWEEN 6 AND 9 THEN 1.5 WHEN h BETWEEN 17 AND 21 THEN 1.8 WHEN h BETWEEN 0 AND 5 THEN 0.4 ELSE 1.0 END)::double*(0.8::double+un*0.4::double),3) AS usage_kwh FROM x""")
def simple_load_model(g):
    return S.simple_load(_typed(g), time_spine(g.spark, "2024-01-06 00:00:00", "2024-01-06 23:45:00"))


def _profile_sql() -> str:
    return "SELECT * FROM (VALUES " + ",".join(f"('{b}',{h},{v}::double)" for b, vals in S.PROFILES.items() for h, v in enumerate(vals)) + ") v(p,h,m)"


@register("profile_load_model", f"""
WITH sp AS (SELECT unnest(generate_series(timestamp '2024-01-06 00:00:00', timestamp '2024-01-07 23:00:00', INTERVAL 1 HOUR)) AS t), pr AS ({_profile_sql()}),
m AS (SELECT meter_id, CASE segment WHEN 'HOUSEHOLD' THEN 'RESIDENTIAL' WHEN 'MACHINERY' THEN 'INDUSTRIAL' ELSE 'COMMERCIAL' END AS p, 0.5::double+k%7 AS b FROM meters)
SELECT meter_id, t AS reading_ts, round(b*pr.m*1.1::double*CASE WHEN m.p='COMMERCIAL' AND dayofweek(t) IN (0,6) THEN 0.3::double ELSE 1.0::double END,3) AS usage_kwh FROM m CROSS JOIN sp JOIN pr ON pr.p=m.p AND pr.h=extract(hour from t)""")
def profile_load_model(g):
    s = F.col("segment")
    rows = g.meters.withColumn("profile", F.when(s == "HOUSEHOLD", "RESIDENTIAL").when(s == "MACHINERY", "INDUSTRIAL").otherwise("COMMERCIAL"))
    return S.profile_load(rows, time_spine(g.spark, "2024-01-06 00:00:00", "2024-01-07 23:00:00", "1 hour"), F.lit(0.5) + F.col("k") % 7)


@register("topology_expansion", f"""
WITH RECURSIVE z(i) AS (SELECT 1 UNION ALL SELECT i+1 FROM z WHERE i<45),
c AS (SELECT 'FEEDER-'||substation_id||'-'||lpad(cast(i AS varchar),2,'0') AS circuit_id, i AS seq FROM substations JOIN z ON i<=floor({u("substation_id||'ncirc'")}*26)+20),
t AS (SELECT c.circuit_id, z.i AS s2, row_number() OVER (ORDER BY c.circuit_id, z.i) AS pos FROM c JOIN z ON z.i<=floor({u("c.circuit_id||'nxfmr'")}*18)+3),
x AS (SELECT circuit_id, 'XFMR-HOU-'||lpad(cast(pos AS varchar),6,'0') AS tid FROM t),
y AS (SELECT *, (list_value(15.0,25.0,37.5,50.0,75.0,100.0,167.0,250.0,333.0,500.0,750.0,1000.0))[cast(floor({u("tid||'kva'")}*12)+1 AS int)]::double AS kva, CASE WHEN {u("tid||'haspole'")}<0.68 THEN 1 ELSE 0 END AS hp FROM x)
SELECT circuit_id, count(*) AS transformer_count, sum(kva) AS total_kva, sum(hp)::bigint AS pole_count FROM y GROUP BY 1""")
def topology_expansion(g):
    circuits = S.expand_circuits(g.substations)
    xfmr = S.expand_transformers(circuits)
    poles = S.expand_poles(xfmr).groupBy("circuit_id").agg(F.count(F.lit(1)).alias("pole_count"))
    per = xfmr.groupBy("circuit_id").agg(F.count(F.lit(1)).alias("transformer_count"), F.sum("rated_kva").alias("total_kva"))
    return per.join(poles, "circuit_id", "left").withColumn("pole_count", F.coalesce("pole_count", F.lit(0)))


_ALL_DAYS = """SELECT unnest(generate_series(lo, hi + INTERVAL 1425 MINUTE, INTERVAL 15 MINUTE)) AS slot_ts
 FROM (SELECT date_trunc('day', min(reading_ts))::timestamp AS lo, date_trunc('day', max(reading_ts))::timestamp AS hi FROM readings)"""


_CHUNKS = _load_sql("""
, hm AS (SELECT meter_id, date_trunc('hour', reading_ts) AS h, sum(usage_kwh*4.0::double) AS kw FROM lm GROUP BY 1,2),
ht AS (SELECT transformer_id, h, sum(kw) AS kw FROM hm JOIN meters USING (meter_id) GROUP BY 1,2),
br AS (SELECT cast(h AS date) AS d, count(*) AS n FROM ht JOIN transformers USING (transformer_id) WHERE kw > rated_kva*0.9::double GROUP BY 1),
ch AS (SELECT cast(reading_ts AS date) AS d, count(*) AS row_count, count_if(m.transformer_id IS NULL) AS orphans,
 count_if(extract(minute from reading_ts) NOT IN (0,15,30,45) OR extract(second from reading_ts)<>0) AS off_grid FROM lm LEFT JOIN meters m USING (meter_id) GROUP BY 1),
v AS (SELECT d, row_count, orphans=0 AND coalesce(n,0)=0 AND off_grid=0 AND round(row_count*100.0::double/(96*(SELECT count(*) FROM meters)),2) BETWEEN 95 AND 105 AS passed FROM ch LEFT JOIN br USING (d))""", _ALL_DAYS)


@register("chunked_backfill", _CHUNKS + """
SELECT strftime(d,'%Y-%m-%d') AS day, row_count, passed FROM v WHERE d < (SELECT min(d) FROM v)+INTERVAL 2 DAY""")
def chunked_backfill(g):
    """The first two days of the readings, both written and judged, whatever the first one's verdict."""
    return _backfill(g, most_days=2, keep_going=True)


@register("chunked_backfill_span", _CHUNKS + """
SELECT strftime(d,'%Y-%m-%d') AS day, row_count, passed FROM v WHERE d <= coalesce((SELECT min(d) FROM v WHERE NOT passed), (SELECT max(d) FROM v))""")
def chunked_backfill_span(g):
    """All days of the readings, held against the real transformers; the run ends with the first day that fails."""
    return _backfill(g)


def _backfill(g, most_days=None, keep_going=False):
    from datetime import timedelta

    from wattline.plans.backfill import backfill
    from wattline.session import scratch_path

    first, last = g.readings.agg(F.to_date(F.min("reading_ts")), F.to_date(F.max("reading_ts"))).first()
    days = [str(first + timedelta(i)) for i in range((last - first).days + 1)][:most_days] if first else []
    people = S.personas(classed(g))
    n = g.meters.count()

    def build(day):
        spine = time_spine(g.spark, f"{day} 00:00:00", f"{day} 23:45:00")
        slots = O.outage_slots(O.touching(g.outages, day)).where(F.to_date("slot_ts") == F.lit(day).cast("date"))
        return S.expected_load(people, spine, g.weather, slots, [HOLIDAY], STORM, kwh_digits=10)

    def gate(rows, day):
        return Q.validate_chunk(rows, g.meters, g.transformers, f"{day} 00:00:00", f"{day} 23:45:00", n * 96)

    log = backfill(g.spark, days, build, gate, scratch_path(g.spark, "backfill"), keep_going=keep_going)
    return log.select("day", "row_count", F.col("status").isin("PASS", "WARN").alias("passed"))


# ---------------------------------------------------------------- quality

def r4(df, *cols):
    return df.withColumns({c: F.round(c, 4) for c in cols})


COORD = "count_if(lat IS NULL OR lon IS NULL OR lat NOT BETWEEN 28 AND 31 OR lon NOT BETWEEN -97 AND -93.5)"


@register("dq_coordinates", "WITH c AS (" + " UNION ALL ".join(
    f"SELECT '{t}' AS detail, count(*) AS total, {COORD} AS violations FROM {src}" for t, src in (("substations", "substations"), ("transformers", "transformers"), ("poles", "poles"), ("meters", "meters"), ("shifted", "(SELECT lat+CASE WHEN k%7=0 THEN 5 ELSE 0 END AS lat, lon FROM meters)"))
) + ") SELECT 'coordinate_validity' AS check_name, *, CASE WHEN violations=0 THEN 'PASS' ELSE 'FAIL' END AS status FROM c")
def dq_coordinates(g):
    shifted = g.meters.withColumn("lat", F.col("lat") + F.when(F.col("k") % 7 == 0, 5).otherwise(0))
    return Q.check_coords({"substations": g.substations, "transformers": g.transformers, "poles": g.poles, "meters": g.meters, "shifted": shifted})


def _fk(name, child, parent, key):
    return f"SELECT '{name}' AS detail, count(*) AS violations FROM {child} c WHERE NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.{key}=c.{key})"


RELATIONS = [
    ("circuit -> substation", "circuits", "substations", "substation_id"), ("transformer -> circuit", "transformers", "circuits", "circuit_id"),
    ("transformer -> substation", "transformers", "substations", "substation_id"), ("pole -> transformer", "poles", "transformers", "transformer_id"),
    ("meter -> pole", "meters", "poles", "transformer_id"), ("meter -> transformer", "meters", "transformers", "transformer_id"),
    ("outage -> substation", "outages", "substations", "substation_id"), ("outage -> circuit", "outages", "circuits", "circuit_id"), ("outage -> transformer", "outages", "transformers", "transformer_id"),
]


@register("dq_referential", "WITH c AS (" + " UNION ALL ".join(_fk(*r) for r in RELATIONS) + ") SELECT 'referential_integrity' AS check_name, *, CASE WHEN violations=0 THEN 'PASS' ELSE 'FAIL' END AS status FROM c")
def dq_referential(g):
    return Q.check_fk([(n, getattr(g, c), getattr(g, p), k, c == "outages") for n, c, p, k in RELATIONS])


def _gate(name, child, parent, key, limit, need):
    d = hav("c.lat", "c.lon", "p.lat", "p.lon")
    return f"SELECT 'spatial_invariants' AS check_name, '{name}' AS detail, {need}::double AS required_pct, round(avg(CASE WHEN {d}<={limit} THEN 100.0::double ELSE 0.0::double END),3) AS actual_pct, round(avg({d})*1000,1) AS mean_m FROM {child} c JOIN {parent} p ON p.{key}=c.{key}"


GATES = [("meter -> transformer within 500 m", "meters", "transformers", "transformer_id", 0.5, 97.5), ("pole -> transformer within 150 m", "poles", "transformers", "transformer_id", 0.15, 99.0), ("transformer -> substation within 15 km", "transformers", "substations", "substation_id", 15.0, 99.5)]


@register("dq_spatial_gates", "WITH c AS (" + " UNION ALL ".join(_gate(*x) for x in GATES) + ") SELECT *, CASE WHEN actual_pct>=required_pct THEN 'PASS' ELSE 'FAIL' END AS status FROM c")
def dq_spatial_gates(g):
    return Q.union([Q.check_distance(n, getattr(g, c), getattr(g, p), k, lim, need) for n, c, p, k, lim, need in GATES])


@register("dq_edges", """
WITH e AS (SELECT 'SUBSTATION -> CIRCUIT' AS detail, count(*) AS total FROM circuits UNION ALL SELECT 'CIRCUIT -> TRANSFORMER', count(*) FROM transformers UNION ALL SELECT 'TRANSFORMER -> METER', count(*) FROM meters)
SELECT 'no_absurd_edges' AS check_name, detail, total, 0::bigint AS violations, 'PASS' AS status FROM e""")
def dq_edges(g):
    from wattline.plans.spatial_queries import _edges

    return Q.check_edges(_edges(g))


@register("dq_contracts", """
SELECT 'column_contracts' AS check_name, 'feeders' AS detail, 5::bigint AS required_cols, 'voltage_kv' AS missing, count(*) AS row_count, count(*) FILTER (t.substation_id IS NULL OR t.rated_kva IS NULL OR t.lat IS NULL) AS null_rows, 'FAIL' AS status
 FROM transformers t JOIN substations s ON s.substation_id=t.substation_id
UNION ALL SELECT 'column_contracts', 'metro', 4, '', count(*), count(*) FILTER (lat IS NULL OR lon IS NULL OR capacity_mva IS NULL), CASE WHEN count(*) FILTER (lat IS NULL OR lon IS NULL OR capacity_mva IS NULL)=0 THEN 'PASS' ELSE 'FAIL' END FROM substations
UNION ALL SELECT 'column_contracts', 'events', 4, '', count(*), count(*) FILTER (voltage_event_id IS NULL OR sag_type IS NULL), CASE WHEN count(*) FILTER (voltage_event_id IS NULL OR sag_type IS NULL)=0 THEN 'PASS' ELSE 'FAIL' END FROM final""")
def dq_contracts(g):
    """A view without a required column, one that keeps its contract, and one whose rows leave required columns empty."""
    from wattline.operators.relations import feeders

    return Q.check_contract({
        "feeders": (feeders(g.transformers, g.substations, g.circuits), ["substation_id", "transformer_id", "distance_km", "rated_kva", "voltage_kv"]),
        "metro": (g.substations, ["substation_id", "lat", "lon", "capacity_mva"]),
        "events": (R.readings_final(g.readings), ["meter_id", "reading_ts", "sag_type", "voltage_event_id"]),
    })


@register("dq_null_keys", "SELECT count(*) AS total, count_if(meter_id IS NULL) AS null_meter_id, count_if(reading_ts IS NULL) AS null_reading_ts, min(reading_ts) AS first_ts, max(reading_ts) AS last_ts FROM readings")
def dq_null_keys(g):
    return Q.check_keys(g.readings, ["meter_id", "reading_ts"], "reading_ts")


FINAL_COLUMNS = ("meter_id", "reading_ts", "usage_kwh", "voltage_v", "power_factor", "quality", "is_outage", "usage_kwh_adjusted", "sag_type", "voltage_drop", "voltage_event_id")


@register("dq_column_completeness", " UNION ALL ".join(f"SELECT '{c}' AS column_name, count({c}) AS filled, round(count({c})::double*100/count(*),2) AS completeness_pct FROM final" for c in FINAL_COLUMNS))
def dq_column_completeness(g):
    """Every column of the final readings."""
    return Q.column_completeness(R.readings_final(g.readings))


@register("dq_row_thresholds", """
WITH c AS (SELECT 'meters' AS table_name, count(*) AS row_count FROM meters UNION ALL SELECT 'readings', count(*) FROM readings UNION ALL SELECT 'outages', count(*) FROM outages)
SELECT c.table_name, row_count, lim AS minimum_rows, CASE WHEN lim IS NULL THEN 'INFO' WHEN row_count>=lim THEN 'PASS' WHEN row_count>0 THEN 'WARN' ELSE 'FAIL' END AS status FROM c LEFT JOIN (VALUES ('meters',100::bigint),('readings',100000000::bigint)) l(table_name, lim) ON l.table_name=c.table_name""")
def dq_row_thresholds(g):
    return Q.check_rows(Q.table_counts({n: getattr(g, n) for n in ("meters", "readings", "outages")}), {"meters": 100, "readings": 100_000_000})


@register("dq_chunk", """
WITH r AS (SELECT * FROM readings WHERE reading_ts BETWEEN '2024-01-05' AND '2024-01-06'),
b AS (SELECT count(*) AS total_readings, round(avg(CASE WHEN voltage_v BETWEEN 115 AND 125 THEN 1.0::double ELSE 0.0::double END)*100,2) AS voltage_ok_pct, round(avg(CASE WHEN power_factor BETWEEN 0.85 AND 0.99 THEN 1.0::double ELSE 0.0::double END)*100,2) AS pf_ok_pct,
 round(avg(CASE WHEN extract(minute from reading_ts) IN (0,15,30,45) AND floor(extract(second from reading_ts))=0 THEN 1.0::double ELSE 0.0::double END)*100,2) AS grid_ok_pct FROM r),
cb AS (SELECT count(*) AS capacity_breaches FROM (SELECT m.transformer_id, date_trunc('hour',reading_ts) AS h, sum(usage_kwh*4) AS kw FROM r JOIN meters m ON m.meter_id=r.meter_id GROUP BY 1,2) x JOIN transformers t ON t.transformer_id=x.transformer_id WHERE x.kw>t.rated_kva*0.9),
m AS (SELECT b.*, cb.*, 0::bigint AS fk_orphans, 400::bigint AS expected_rows, round(total_readings*100.0::double/400,2) AS row_count_pct FROM b, cb)
SELECT fk_orphans, total_readings, expected_rows, row_count_pct, voltage_ok_pct, pf_ok_pct, grid_ok_pct, capacity_breaches, CASE WHEN capacity_breaches>0 OR grid_ok_pct<100 OR row_count_pct NOT BETWEEN 95 AND 105 THEN 'FAIL' WHEN voltage_ok_pct<95 OR pf_ok_pct<99 THEN 'WARN' ELSE 'PASS' END AS verdict FROM m""")
def dq_chunk(g):
    return Q.validate_chunk(g.readings, g.meters, g.transformers, "2024-01-05 00:00:00", "2024-01-06 00:00:00", 400).drop("details", "reason")


@register("dq_daily_variance", """
WITH d AS (SELECT cast(reading_ts AS date) AS d, avg(usage_kwh)*96 AS k FROM readings WHERE quality='VALID' GROUP BY 1), s AS (SELECT round((max(k)-min(k))/nullif(avg(k),0)*100,2) AS rel_range_pct FROM d)
SELECT '01_daily_variance' AS check_name, rel_range_pct, CASE WHEN rel_range_pct BETWEEN 5 AND 30 THEN 'PASS' ELSE 'FAIL' END AS result FROM s""")
def dq_daily_variance(g):
    return Q.daily_variance(g.readings)


@register("dq_temp_corr", """
WITH h AS (SELECT date_trunc('hour', reading_ts) AS hr, avg(usage_kwh) AS k FROM readings WHERE quality='VALID' GROUP BY 1), c AS (SELECT corr(k, temperature_f) AS c FROM h JOIN weather w ON w.hour=h.hr)
SELECT '02_temp_corr' AS check_name, round(c,4) AS corr_value, CASE WHEN c>0.4 THEN 'PASS' ELSE 'FAIL' END AS result FROM c""")
def dq_temp_corr(g):
    return Q.temp_corr(g.readings, g.weather)


@register("dq_event_signal", """
WITH d AS (SELECT cast(reading_ts AS date) AS d, avg(usage_kwh)*96 AS k FROM readings r JOIN meters m ON m.meter_id=r.meter_id WHERE m.lat<29.7 GROUP BY 1),
b AS (SELECT avg(k) FILTER (d BETWEEN '2024-01-01' AND '2024-01-06') AS pre, avg(k) FILTER (d BETWEEN '2024-01-07' AND '2024-01-08') AS spike, avg(k) FILTER (d BETWEEN '2024-01-09' AND '2024-01-15') AS post FROM d)
SELECT '03_event_signal' AS check_name, round(pre,2) AS pre, round(spike,2) AS spike, round(post,2) AS post, CASE WHEN spike>pre AND post<pre THEN 'PASS' ELSE 'FAIL' END AS result FROM b""")
def dq_event_signal(g):
    return Q.event_signal(g.readings, g.meters, ("2024-01-01", "2024-01-06"), ("2024-01-07", "2024-01-08"), ("2024-01-09", "2024-01-15"))


@register("dq_outage_zero", "SELECT '04_outage_zeros' AS check_name, count(*) AS total_outage, count_if(usage_kwh<>0) AS non_zero, CASE WHEN count_if(usage_kwh<>0)=0 THEN 'PASS' ELSE 'FAIL' END AS result FROM readings WHERE quality='OUTAGE'")
def dq_outage_zero(g):
    return Q.outage_zero(g.readings)


@register("dq_weekend", """
WITH w AS (SELECT avg(usage_kwh) FILTER (dayofweek(reading_ts) IN (0,6))/avg(usage_kwh) FILTER (dayofweek(reading_ts) NOT IN (0,6)) AS r FROM readings WHERE quality='VALID')
SELECT '05_weekend_split' AS check_name, round(r,4) AS ratio, CASE WHEN r BETWEEN 1.04 AND 1.15 THEN 'PASS' ELSE 'FAIL' END AS result FROM w""")
def dq_weekend(g):
    return Q.weekend_ratio(g.readings)


@register("dq_holiday", """
WITH d AS (SELECT cast(reading_ts AS date) AS d, avg(usage_kwh) AS k FROM readings WHERE quality='VALID' GROUP BY 1), w AS (SELECT max(k) FILTER (d='2024-01-15')/avg(k) FILTER (d<>'2024-01-15') AS r FROM d WHERE d BETWEEN '2024-01-12' AND '2024-01-18')
SELECT '06_holiday_spike' AS check_name, round(r,4) AS ratio, CASE WHEN r BETWEEN 1.10 AND 1.30 THEN 'PASS' ELSE 'FAIL' END AS result FROM w""")
def dq_holiday(g):
    return Q.holiday_ratio(g.readings, HOLIDAY, "2024-01-12", "2024-01-18")


def _base(g):
    return g.meters.select("meter_id", (F.col("k") * 31 % 97).alias("base"))


QUINT = "q AS (SELECT meter_id, ntile(5) OVER (ORDER BY k*31%97, meter_id) AS quintile FROM meters)"


@register("dq_monotone", f"""
WITH {QUINT}, a AS (SELECT quintile, avg(usage_kwh)*96 AS k FROM readings r JOIN q ON q.meter_id=r.meter_id WHERE quality='VALID' GROUP BY 1),
p AS (SELECT min(k) FILTER (quintile=1) AS q1, min(k) FILTER (quintile=2) AS q2, min(k) FILTER (quintile=3) AS q3, min(k) FILTER (quintile=4) AS q4, min(k) FILTER (quintile=5) AS q5 FROM a)
SELECT '07_segment_ordering' AS check_name, round(q1,4) AS q1, round(q2,4) AS q2, round(q3,4) AS q3, round(q4,4) AS q4, round(q5,4) AS q5, CASE WHEN q1<q2 AND q2<q3 AND q3<q4 AND q4<q5 THEN 'PASS' ELSE 'FAIL' END AS result FROM p""")
def dq_monotone(g):
    return Q.monotone(g.readings, _base(g))


@register("dq_geo_cv", """
WITH c AS (SELECT county, avg(usage_kwh)*96 AS k FROM readings r JOIN meters m ON m.meter_id=r.meter_id WHERE quality='VALID' GROUP BY 1), s AS (SELECT stddev_samp(k)/nullif(avg(k),0)*100 AS cv FROM c)
SELECT '08_geographic_variance' AS check_name, round(cv,2) AS cv_pct, CASE WHEN cv>=3 THEN 'PASS' ELSE 'FAIL' END AS result FROM s""")
def dq_geo_cv(g):
    return Q.geo_cv(g.readings, g.meters)


@register("dq_diurnal", """
WITH h AS (SELECT extract(hour from reading_ts) AS h, avg(usage_kwh) AS k FROM readings WHERE quality='VALID' GROUP BY 1), r AS (SELECT avg(k) FILTER (h BETWEEN 17 AND 20)/avg(k) FILTER (h BETWEEN 0 AND 3) AS r FROM h)
SELECT '09_diurnal_ratio' AS check_name, round(r,3) AS peak_ratio, CASE WHEN r>=1.8 THEN 'PASS' ELSE 'FAIL' END AS result FROM r""")
def dq_diurnal(g):
    return Q.diurnal_ratio(g.readings)


@register("dq_device", f"""
WITH {PERSONA}, m AS (SELECT meter_id, avg(usage_kwh) FILTER (extract(hour from reading_ts) BETWEEN 10 AND 16) AS d, avg(usage_kwh) FILTER (extract(hour from reading_ts)>=23 OR extract(hour from reading_ts)<=5) AS n FROM readings WHERE quality='VALID' GROUP BY 1),
p AS (SELECT avg(n/nullif(d,0)) FILTER (has_ev) AS ev, avg(n/nullif(d,0)) FILTER (NOT has_ev) AS nev, avg(d) FILTER (has_solar) AS so, avg(d) FILTER (NOT has_solar) AS nso FROM m JOIN pe ON pe.meter_id=m.meter_id)
SELECT '10_device_signatures' AS check_name, round(so/nso,4) AS solar_ratio, round(ev,4) AS ev_night_day_ratio, round(nev,4) AS no_ev_night_day_ratio, CASE WHEN so<nso AND ev>nev THEN 'PASS' ELSE 'FAIL' END AS result FROM p""")
def dq_device(g):
    return Q.device_signatures(g.readings, S.personas(classed(g)))


@register("dq_parity", """
WITH a AS (SELECT m.transformer_id, date_trunc('hour', reading_ts) AS h, sum(usage_kwh*4) AS kw FROM readings r JOIN meters m ON m.meter_id=r.meter_id GROUP BY 1,2)
SELECT '11_load_parity' AS check_name, count(*) AS rows_compared, 0.0::double AS max_delta_kw, 'PASS' AS result FROM a""")
def dq_parity(g):
    stored = L.transformer_hourly_load(g.readings, g.meters, g.transformers, g.weather)
    joined = g.readings.join(g.meters.select("meter_id", "transformer_id"), "meter_id")
    rebuilt = joined.groupBy("transformer_id", F.date_trunc("HOUR", "reading_ts").cast("timestamp_ntz").alias("load_hour")).agg(F.sum(F.col("usage_kwh") * 4.0).alias("load_kw"))
    return Q.load_parity(rebuilt, stored).withColumn("max_delta_kw", F.round("max_delta_kw", 3))


@register("dq_capacity", """
SELECT '12_capacity_sanity' AS check_name, count_if(load_factor_pct>110) AS overloaded_rows, round(count_if(load_factor_pct>110)::double*100/count(*),2) AS overload_pct, CASE WHEN count_if(load_factor_pct>110)*100.0/count(*)<5 THEN 'PASS' ELSE 'WARN' END AS result FROM hourly_load""")
def dq_capacity(g):
    return Q.capacity_sanity(g.hourly_load)


@register("dq_physics", f"""
WITH r AS (SELECT abs(usage_kwh*4-voltage_v*(5.0::double+20.0::double*{u("meter_id||'amp'")})*power_factor/1000) AS d FROM readings WHERE quality='VALID')
SELECT '13_physical_consistency' AS check_name, round(median(d),4) AS median_abs_delta_kw, round(avg(d),4) AS avg_abs_delta_kw, CASE WHEN median(d)<0.5 THEN 'PASS' ELSE 'FAIL' END AS result FROM r""")
def dq_physics(g):
    return Q.physics(g.readings.withColumn("current_a", F.lit(5.0) + 20.0 * keyed_uniform(F.col("meter_id"), "amp")))


@register("dq_total_rows", "SELECT '14_row_count' AS check_name, count(*) AS actual_rows, CASE WHEN count(*) BETWEEN 500 AND 200000 THEN 'PASS' ELSE 'FAIL' END AS result FROM readings")
def dq_total_rows(g):
    return Q.row_band(g.readings, 500, 200_000)


@register("dq_chart", f"""
WITH {QUINT} SELECT cast(reading_ts AS date) AS d, quintile, round(avg(usage_kwh)*96,6) AS avg_daily_kwh FROM readings r JOIN q ON q.meter_id=r.meter_id WHERE quality='VALID' GROUP BY 1,2""")
def dq_chart(g):
    return Q.chart_shape(g.readings, _base(g)).withColumn("avg_daily_kwh", F.round("avg_daily_kwh", 6))


@register("dq_duplicate_slots", "SELECT meter_id, time_bucket(INTERVAL 15 MINUTE, reading_ts) AS slot_ts, count(*) AS n FROM readings GROUP BY 1,2 HAVING count(*)>1")
def dq_duplicate_slots(g):
    return Q.duplicate_slots(g.readings)


def _shape(name, value, ok):
    return f"SELECT '{name}' AS check_name, 'readings' AS detail, round({value},4) AS measured, CASE WHEN {ok} THEN 'PASS' ELSE 'FAIL' END AS status"


def _counted(check, detail, n):
    return f"SELECT '{check}' AS check_name, '{detail}' AS detail, ({n})::double AS measured, CASE WHEN ({n})=0 THEN 'PASS' ELSE 'FAIL' END AS status"


PLACES = ("substations", "transformers", "poles", "meters")
OUT_OF_PLACE = "lat IS NULL OR lon IS NULL OR lat NOT BETWEEN 28 AND 31 OR lon NOT BETWEEN -97 AND -93.5"


@register("dq_report", f"""
WITH va AS (SELECT r.*, county FROM readings r LEFT JOIN meters m ON m.meter_id=r.meter_id WHERE quality='VALID'),
d AS (SELECT avg(usage_kwh) AS m FROM va GROUP BY cast(reading_ts AS date)), h AS (SELECT date_trunc('hour', reading_ts) AS hour, avg(usage_kwh) AS m FROM va GROUP BY 1),
c AS (SELECT avg(usage_kwh) AS m FROM va WHERE county IS NOT NULL GROUP BY county), o AS (SELECT extract(hour from reading_ts) AS k, avg(usage_kwh) AS m FROM va GROUP BY 1),
x AS (SELECT (SELECT (max(m)-min(m))/nullif(avg(m),0)*100 FROM d) AS dv, (SELECT corr(m, temperature_f) FROM h JOIN weather w ON w.hour=h.hour) AS tc, (SELECT stddev_samp(m)/nullif(avg(m),0)*100 FROM c) AS gc,
 (SELECT avg(m) FILTER (k BETWEEN 17 AND 20)/nullif(avg(m) FILTER (k BETWEEN 0 AND 3),0) FROM o) AS dr, (SELECT avg(usage_kwh) FILTER (dayofweek(reading_ts) IN (0,6))/nullif(avg(usage_kwh) FILTER (dayofweek(reading_ts) NOT IN (0,6)),0) FROM va) AS ws,
 (SELECT count(*)::double FROM readings WHERE quality='OUTAGE' AND usage_kwh<>0) AS oz)
{_shape('01_daily_variance', 'dv', 'round(dv,2) BETWEEN 5 AND 30')} FROM x UNION ALL {_shape('02_temp_corr', 'tc', 'tc>0.4')} FROM x UNION ALL {_shape('04_outage_zeros', 'oz', 'oz=0')} FROM x
UNION ALL {_shape('05_weekend_split', 'ws', 'ws BETWEEN 1.04 AND 1.15')} FROM x UNION ALL {_shape('08_geographic_variance', 'gc', 'gc>=3')} FROM x UNION ALL {_shape('09_diurnal_ratio', 'dr', 'dr>=1.8')} FROM x
UNION ALL {' UNION ALL '.join(_counted('coordinate_validity', t, f"SELECT count(*) FROM {t} WHERE {OUT_OF_PLACE}") for t in PLACES)}
UNION ALL {' UNION ALL '.join(_counted('referential_integrity', n, f"SELECT count(*) FROM {c} c WHERE NOT EXISTS (SELECT 1 FROM {p} p WHERE p.{k}=c.{k})") for n, c, p, k in RELATIONS)}
UNION ALL {_counted('capacity', 'hourly_load', "SELECT count(*) FROM hourly_load WHERE load_factor_pct>110")}""")
def dq_report(g):
    """All checks of all tables: each table is aggregated once, however many checks it has."""
    tables = {}
    for name in PLACES:
        tables[name] = Q.TableChecks(name, getattr(g, name)).position()
    for name, child, parent, key in RELATIONS:
        tables.setdefault(child, Q.TableChecks(child, getattr(g, child))).reference(name, getattr(g, parent), key, child == "outages")
    tables["hourly_load"] = Q.TableChecks("hourly_load", g.hourly_load).rule("capacity", "hourly_load", F.col("load_factor_pct") > 110)
    return Q.report(list(tables.values()), cut(Q.reading_profile(g.readings, g.meters)), g.weather)


# ---------------------------------------------------------------- learning

def pairs(g):
    return M.training_pairs(g.hourly_load, aged(g), (1, 3), (5, 7), g.meters)


PAIRS = """ea AS (SELECT transformer_id, cast(load_hour AS date) AS pair_date, avg(load_factor_pct) AS morning_load_pct, max(load_kw) AS morning_load_kw FROM hourly_load WHERE extract(hour from load_hour) BETWEEN 1 AND 3 GROUP BY 1,2),
 la AS (SELECT transformer_id, cast(load_hour AS date) AS pair_date, max(load_factor_pct) AS afternoon_load_pct FROM hourly_load WHERE extract(hour from load_hour) BETWEEN 5 AND 7 GROUP BY 1,2),
 hi AS (SELECT transformer_id, avg(load_factor_pct) AS hist FROM hourly_load GROUP BY 1),
 pr AS (SELECT ea.*, la.afternoon_load_pct, hist, age_years, rated_kva, (morning_load_pct-hist)/nullif(hist,0)*100 AS stress, CASE WHEN afternoon_load_pct>=100 THEN 1 ELSE 0 END AS label,
 (SELECT count(*) FROM meters m WHERE m.transformer_id=ea.transformer_id) AS active_meters FROM ea JOIN la ON la.transformer_id=ea.transformer_id AND la.pair_date=ea.pair_date JOIN hi ON hi.transformer_id=ea.transformer_id JOIN aged t ON t.transformer_id=ea.transformer_id)"""


@register("training_pairs", f"""
WITH {PAIRS} SELECT transformer_id, pair_date, round(morning_load_pct,8) AS morning_load_pct, morning_load_kw, round(afternoon_load_pct,8) AS afternoon_load_pct, round(hist,6) AS historical_avg_load, rated_kva, age_years, active_meters, round(stress,6) AS stress_vs_historical, label AS afternoon_is_high_risk FROM pr""")
def training_pairs(g):
    out = r8(pairs(g).drop("manufacturer"), "morning_load_pct", "afternoon_load_pct")
    return out.withColumns({c: F.round(c, 6) for c in ("historical_avg_load", "stress_vs_historical")})


@register("transition_table", f"""
WITH {PAIRS} SELECT CASE WHEN morning_load_pct>=100 THEN 'Already High-Risk' WHEN morning_load_pct>=90 THEN 'Borderline (90-100%)' WHEN morning_load_pct>=70 THEN 'Moderate (70-90%)' ELSE 'Low (<70%)' END AS morning_state,
 count(*) AS total, sum(label)::bigint AS became_high_risk, round(avg(label)*100,2) AS transition_rate_pct FROM pr GROUP BY 1""")
def transition_table(g):
    return M.transitions(pairs(g))


@register("rule_scoring", f"""
WITH {PAIRS}, n AS (SELECT *, row_number() OVER (PARTITION BY transformer_id ORDER BY pair_date DESC) AS rn FROM pr)
SELECT transformer_id, pair_date, round(least(1.0::double, morning_load_pct/100*(1+coalesce(stress,0)/100)*(1+age_years/50.0::double)),8) AS failure_probability,
 CASE WHEN least(1.0::double, morning_load_pct/100*(1+age_years/50.0::double))>=0.7 THEN 'CRITICAL' WHEN least(1.0::double, morning_load_pct/100*(1+age_years/50.0::double))>=0.5 THEN 'HIGH' WHEN least(1.0::double, morning_load_pct/100*(1+age_years/50.0::double))>=0.3 THEN 'MEDIUM' ELSE 'LOW' END AS risk_category,
 round(100-(morning_load_pct*0.5::double+age_years*0.5::double),8) AS health_estimate FROM n WHERE rn=1""")
def rule_scoring(g):
    return r8(A.rule_risk(pairs(g), aged(g)), "failure_probability", "health_estimate")


NUMBERS = {"morning_load_pct": "morning_load_pct", "morning_load_kw": "morning_load_kw::double", "historical_avg_load": "hist", "rated_kva": "rated_kva::double", "age_years": "age_years::double", "active_meters": "active_meters::double", "stress_vs_historical": "stress"}
TRAIN = f"{u("transformer_id||'42'")}<0.8"
SCALED = ", ".join(
    f"round((coalesce({x},{c}_a)-{c}_m)/nullif({c}_s,0),6) AS {c}" for c, x in NUMBERS.items()
)


@register("scale_encode", f"""
WITH {PAIRS}, t AS (SELECT pr.*, manufacturer FROM pr JOIN transformers x ON x.transformer_id=pr.transformer_id),
a AS (SELECT {', '.join(f"avg({x}) AS {c}_a" for c, x in NUMBERS.items())} FROM t WHERE {TRAIN}),
m AS (SELECT {', '.join(f"avg(coalesce({x},{c}_a)) AS {c}_m, stddev_samp(coalesce({x},{c}_a)) AS {c}_s" for c, x in NUMBERS.items())} FROM t, a WHERE {TRAIN}),
n AS (SELECT manufacturer, row_number() OVER (ORDER BY count(*) DESC, manufacturer)-1 AS category_index FROM t WHERE {TRAIN} GROUP BY 1)
SELECT t.transformer_id, pair_date, {SCALED}, coalesce(category_index, (SELECT count(*) FROM n))::int AS category_index FROM t LEFT JOIN n ON n.manufacturer=t.manufacturer, a, m""")
def scale_encode(g):
    """Every number imputed and scaled and the category's place, all from what the training rows gave."""
    from pyspark.ml.functions import vector_to_array

    rows = pairs(g)
    part = M.split_label("transformer_id")
    model = M.scale_encode(rows.where(part == "train"))
    out = model.transform(rows.withColumns({c: F.col(c).cast("double") for c in M.NUMERIC})).withColumn("_x", vector_to_array("numeric_scaled"))
    return out.select("transformer_id", "pair_date", *[F.round(F.col("_x")[i], 6).alias(c) for i, c in enumerate(M.NUMERIC)], F.col("category_index").cast("int").alias("category_index"))


def _fitted(g):
    """The model and all rows; it is fitted on the training part."""
    rows = M.stored(pairs(g))
    return M.train(rows.where(M.split_label("transformer_id") == "train"), "high_precision"), rows


def _by_both(model, rows):
    """Probabilities of the model itself and of its table of trees; rows are dealt out, as each walks all trees."""
    from pyspark.ml.functions import vector_to_array

    keys = ["transformer_id", "pair_date"]
    own = cut(M.score(model, dealt(rows)).select(*keys, "risk_probability", "prediction", vector_to_array("features").alias("f")))
    table = M.score_by_trees(own, "f", M.tree_table(model), keys)
    return own.drop("f").join(table.withColumnRenamed("risk_probability", "by_trees"), keys)


@register("boosted_classifier", f"""
WITH {PAIRS} SELECT transformer_id, pair_date, true AS same_probability, true AS same_prediction FROM pr WHERE NOT {TRAIN}""")
def boosted_classifier(g):
    """Held-out rows scored by the classifier and, through a join, by the table of its trees."""
    model, rows = _fitted(g)
    out = _by_both(model, rows.where(M.split_label("transformer_id") == "test"))
    same = F.abs(F.col("risk_probability") - F.col("by_trees")) < 1e-9
    return out.select("transformer_id", "pair_date", same.alias("same_probability"), ((F.col("by_trees") > 0.5) == (F.col("prediction") == 1)).alias("same_prediction"))


@register("batch_scoring", f"""
WITH {PAIRS} SELECT transformer_id, max(pair_date) AS pair_date, true AS same_probability, true AS in_range FROM pr GROUP BY 1""")
def batch_scoring(g):
    """The newest row of every transformer, scored from the table of trees."""
    model, rows = _fitted(g)
    out = _by_both(model, M.newest_pairs(rows))
    same = F.abs(F.col("risk_probability") - F.col("by_trees")) < 1e-9
    return out.select("transformer_id", "pair_date", same.alias("same_probability"), F.col("by_trees").between(0, 1).alias("in_range"))


@register("classifier_metrics", f"""
WITH {PAIRS}, p AS (SELECT label AS y, CASE WHEN morning_load_pct>=90 THEN 1 ELSE 0 END AS p FROM pr),
c AS (SELECT count_if(y=1 AND p=1) AS tp, count_if(y=0 AND p=1) AS fp, count_if(y=1 AND p=0) AS fn, count_if(y=0 AND p=0) AS tn FROM p)
SELECT *, round((tp+tn)/(tp+fp+fn+tn),8) AS accuracy, round(tp/nullif(tp+fp,0),8) AS precision, round(tp/nullif(tp+fn,0),8) AS recall, round(2*(tp/(tp+fp))*(tp/(tp+fn))/nullif(tp/(tp+fp)+tp/(tp+fn),0),8) AS f1 FROM c""")
def classifier_metrics(g):
    pred = pairs(g).withColumn("prediction", F.when(F.col("morning_load_pct") >= 90, 1).otherwise(0))
    return r8(M.confusion(pred, "afternoon_is_high_risk", "prediction"), "accuracy", "precision", "recall", "f1")


@register("model_selection", f"""
WITH {PAIRS}, c AS (SELECT t AS th, count_if(label=1 AND morning_load_pct>=t)::double AS tp, count_if(label=0 AND morning_load_pct>=t) AS fp, count_if(label=1 AND morning_load_pct<t) AS fn FROM pr CROSS JOIN (VALUES (60),(90),(120)) v(t) GROUP BY 1),
m AS (SELECT 'threshold_'||th AS run, tp/(tp+fp) AS pc, tp/(tp+fn) AS rc, 2*tp/(2*tp+fp+fn) AS f1 FROM c)
SELECT (SELECT run FROM m ORDER BY f1 DESC, run DESC LIMIT 1) AS best_f1, (SELECT run FROM m ORDER BY rc DESC, run DESC LIMIT 1) AS best_recall, (SELECT run FROM m ORDER BY pc DESC, run DESC LIMIT 1) AS best_precision""")
def model_selection(g):
    rows = pairs(g)
    runs = []
    for limit in (60, 90, 120):
        pred = rows.withColumn("prediction", F.when(F.col("morning_load_pct") >= limit, 1).otherwise(0))
        runs.append(M.confusion(pred, "afternoon_is_high_risk", "prediction").withColumn("run", F.lit(f"threshold_{limit}")))
    return M.compare_runs(Q.union(runs))


CLUSTER_COLS = ("mean_kwh", "sd_kwh", "evening_share")


def _lloyd_sql(k: int, rounds: int) -> str:
    z = ", ".join(f"({c}-avg({c}) OVER ())/coalesce(nullif(stddev_samp({c}) OVER (), 0), 1) AS z{i}" for i, c in enumerate(CLUSTER_COLS))
    far = "+".join(f"(z.z{i}-c.z{i})*(z.z{i}-c.z{i})" for i in range(3))
    steps = [
        f"f AS (SELECT meter_id, avg(usage_kwh) AS mean_kwh, coalesce(stddev_samp(usage_kwh),0) AS sd_kwh, avg(CASE WHEN extract(hour from reading_ts) BETWEEN 17 AND 21 THEN 1.0::double ELSE 0.0::double END) AS evening_share FROM readings GROUP BY 1)",
        f"z AS MATERIALIZED (SELECT meter_id, {z} FROM f)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY md5(meter_id), meter_id)-1 AS c, z0, z1, z2 FROM z QUALIFY c<{k})",
    ]
    for i in range(rounds + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT meter_id, z0, z1, z2, c FROM (SELECT z.*, c.c, row_number() OVER (PARTITION BY meter_id ORDER BY {far}, c.c) AS rn FROM z, c{i} c) WHERE rn=1)")
        if i < rounds:
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT c.c, coalesce(avg(a.z0), any_value(c.z0)) AS z0, coalesce(avg(a.z1), any_value(c.z1)) AS z1, coalesce(avg(a.z2), any_value(c.z2)) AS z2 FROM c{i} c LEFT JOIN a{i} a ON a.c=c.c GROUP BY 1)")
    return f"WITH {', '.join(steps)} SELECT meter_id, c::int AS cluster FROM a{rounds}"


@register("usage_clusters", _lloyd_sql(4, 10))
def usage_clusters(g):
    f = g.readings.groupBy("meter_id").agg(
        F.avg("usage_kwh").alias("mean_kwh"), F.coalesce(F.stddev_samp("usage_kwh"), F.lit(0.0)).alias("sd_kwh"), F.avg(F.when(F.hour("reading_ts").between(17, 21), 1.0).otherwise(0.0)).alias("evening_share")
    )
    return M.usage_clusters(f, "meter_id", list(CLUSTER_COLS), 4, 10).select("meter_id", "cluster")


def _substation_hours(g):
    per = g.readings.groupBy("meter_id", F.date_trunc("HOUR", "reading_ts").cast("timestamp_ntz").alias("hour")).agg(F.sum("usage_kwh").alias("v"))
    return per.join(g.meters.select("meter_id", "substation_id"), "meter_id").groupBy("substation_id", "hour").agg(F.sum("v").alias("value"))


HOURS = "sh AS (SELECT substation_id, date_trunc('hour', reading_ts)::timestamp AS hour, sum(usage_kwh) AS value FROM readings r JOIN meters m ON m.meter_id=r.meter_id GROUP BY 1,2)"


@register("hourly_forecast", f"""
WITH {HOURS}, x AS (SELECT max(hour) AS mx FROM sh) SELECT substation_id, hour+INTERVAL 168 HOUR AS hour, round(value,8) AS forecast FROM sh, x WHERE hour+INTERVAL 168 HOUR>mx AND hour+INTERVAL 168 HOUR<=mx+INTERVAL 168 HOUR""")
def hourly_forecast(g):
    return r8(M.seasonal_naive(_substation_hours(g), "substation_id"), "forecast")


def _fitted_sql() -> str:
    """Fitted values by regressing one column after the other on the ones before it, which needs no matrix."""
    steps = [
        f"{HOURS}",
        "x AS MATERIALIZED (SELECT a.substation_id, a.hour, a.value, b.value AS x0, sin(extract(hour from a.hour)*2.0::double*pi()/24.0::double) AS x1, cos(extract(hour from a.hour)*2.0::double*pi()/24.0::double) AS x2, "
        "(DOW)::double AS x3 FROM sh a JOIN sh b ON b.substation_id=a.substation_id AND b.hour=a.hour-INTERVAL 168 HOUR)".replace("DOW", "extract(dow from a.hour)"),
        "w0 AS MATERIALIZED (SELECT substation_id, hour, value, x0-avg(x0) OVER () AS z0, x1-avg(x1) OVER () AS z1, x2-avg(x2) OVER () AS z2, x3-avg(x3) OVER () AS z3 FROM x)",
    ]
    for i in range(3):
        later = ", ".join(f"z{j}-z{i}*(sum(z{j}*z{i}) OVER ())/nullif(sum(z{i}*z{i}) OVER (), 0) AS z{j}" for j in range(i + 1, 4))
        kept = ", ".join(f"z{j}" for j in range(i + 1))
        steps.append(f"w{i + 1} AS MATERIALIZED (SELECT substation_id, hour, value, {kept}, {later} FROM w{i})")
    fit = "+".join(f"z{j}*(sum(value*z{j}) OVER ())/nullif(sum(z{j}*z{j}) OVER (), 0)" for j in range(4))
    return f"WITH {', '.join(steps)} SELECT substation_id, hour, round(value,8) AS value, round((avg(value) OVER ())+{fit},6) AS forecast FROM w3"


@register("linear_forecast", _fitted_sql())
def linear_forecast(g):
    return r8(M.linear_forecast(_substation_hours(g), "substation_id"), "value").withColumn("forecast", F.round("forecast", 6))


FC = f"{HOURS}, fc AS (SELECT a.substation_id, a.hour, a.value, b.value AS forecast FROM sh a JOIN sh b ON b.substation_id=a.substation_id AND b.hour=a.hour-INTERVAL 168 HOUR)"


def _with_forecast(g):
    h = _substation_hours(g)
    past = h.select("substation_id", (F.col("hour") + F.expr("interval 168 hours")).cast("timestamp_ntz").alias("hour"), F.col("value").alias("forecast"))
    return h.join(past, ["substation_id", "hour"])


@register("forecast_error", f"WITH {FC} SELECT count(*) AS n, round(avg(abs(forecast-value)),8) AS mae, round(sqrt(avg((forecast-value)*(forecast-value))),8) AS rmse FROM fc")
def forecast_error(g):
    return r8(M.forecast_error(_with_forecast(g)), "mae", "rmse")


@register("forecast_accuracy", f"WITH {FC} SELECT substation_id, hour, round(value,8) AS value, round(forecast,8) AS forecast, round(abs(forecast-value)/nullif(value,0)*100,4) AS ape_pct FROM fc WHERE hour>=(SELECT max(hour) FROM fc)-INTERVAL 7 DAY")
def forecast_accuracy(g):
    out = M.forecast_accuracy(_with_forecast(g), "hour", "value", "forecast")
    return r8(out, "value", "forecast").withColumn("ape_pct", F.round("ape_pct", 4))


@register("registry_tables", f"""
WITH {PAIRS} SELECT 'rule' AS model_name, 'v1' AS model_version, transformer_id AS entity_id, round(least(1.0::double, morning_load_pct/100),8) AS risk_probability, CASE WHEN morning_load_pct>=90 THEN 1 ELSE 0 END AS predicted_label, timestamp '2024-02-01 00:00:00' AS predicted_at FROM pr""")
def registry_tables(g):
    scored = pairs(g).withColumns({"risk_probability": F.least(F.lit(1.0), F.col("morning_load_pct") / 100), "prediction": F.when(F.col("morning_load_pct") >= 90, 1).otherwise(0)})
    return r8(M.log_predictions(scored, "rule", "v1", "2024-02-01 00:00:00"), "risk_probability")


# ---------------------------------------------------------------- semantic layer

def frames(g):
    return {
        "readings": R.readings_final(g.readings), "customers": g.customers, "transformers": aged(g), "hourly_load": g.hourly_load, "substations": g.substations, "meters": g.meters, "outages": g.outages,
    }


def ask(g, dims, metrics, filters=()):
    return grid_model().query(frames(g), dims, metrics, filters)


@register("semantic_query", """
SELECT cause, count(DISTINCT outage_id) AS outage_count, sum(customers)::bigint AS total_customers_affected, round(avg(date_sub('minute', start_ts, end_ts)),8) AS avg_outage_duration FROM outages GROUP BY 1""")
def semantic_query(g):
    return r8(ask(g, ["CAUSE"], ["OUTAGE_COUNT", "TOTAL_CUSTOMERS_AFFECTED", "AVG_OUTAGE_DURATION"]), "avg_outage_duration")


@register("metric_registry", """
SELECT count(DISTINCT meter_id) AS active_meter_count, round(sum(usage_kwh_adjusted),6) AS total_consumption, round(avg(usage_kwh_adjusted),8) AS avg_consumption, max(usage_kwh_adjusted) AS peak_consumption, round(avg(voltage_v),8) AS avg_voltage, min(voltage_v) AS min_voltage,
 count(*) AS reading_count, count_if(voltage_v<114) AS low_voltage_count, count(voltage_event_id) AS voltage_sag_count, round(sum(usage_kwh-usage_kwh_adjusted),6) AS outage_impact_kwh, round(count_if(quality='VALID')::double*100/count(*),8) AS data_completeness FROM final""")
def metric_registry(g):
    out = ask(g, [], list(grid_model().tables["readings"].metrics))
    return r8(out, "avg_consumption", "avg_voltage", "data_completeness").withColumns({c: F.round(c, 6) for c in ("total_consumption", "outage_impact_kwh")})


@register("relationship_join", """
SELECT c.segment AS customer_segment, s.region_id, round(sum(usage_kwh_adjusted),6) AS total_consumption, count(*) AS reading_count FROM final f LEFT JOIN meters m ON m.meter_id=f.meter_id LEFT JOIN customers c ON c.meter_id=m.meter_id
LEFT JOIN transformers t ON t.transformer_id=m.transformer_id LEFT JOIN substations s ON s.substation_id=t.substation_id WHERE extract(hour from reading_ts) BETWEEN 14 AND 19 AND c.account_status='ACTIVE' GROUP BY 1,2""")
def relationship_join(g):
    out = ask(g, ["CUSTOMER_SEGMENT", "REGION_ID"], ["TOTAL_CONSUMPTION", "READING_COUNT"], ["PEAK_HOURS", "ACTIVE_CUSTOMERS"])
    return out.withColumn("total_consumption", F.round("total_consumption", 6))


@register("semantic_two_facts", """
WITH r AS (SELECT location_area, reading_ts::date AS day, round(sum(usage_kwh_adjusted),6) AS total_consumption, count(DISTINCT f.meter_id) AS active_meter_count FROM final f LEFT JOIN meters m ON m.meter_id=f.meter_id LEFT JOIN aged t ON t.transformer_id=m.transformer_id
 WHERE extract(hour from reading_ts) BETWEEN 14 AND 19 GROUP BY 1,2),
o AS (SELECT location_area, start_ts::date AS day, count(DISTINCT outage_id) AS outage_count, round(avg(date_sub('minute', start_ts, end_ts)),8) AS avg_outage_duration FROM outages o LEFT JOIN aged t ON t.transformer_id=o.transformer_id GROUP BY 1,2)
SELECT coalesce(r.location_area, o.location_area) AS location_area, coalesce(r.day, o.day) AS day, total_consumption, active_meter_count, outage_count, avg_outage_duration
FROM r FULL JOIN o ON r.location_area IS NOT DISTINCT FROM o.location_area AND r.day IS NOT DISTINCT FROM o.day""")
def semantic_two_facts(g):
    """Consumption in peak hours beside outages, by area and day; the filter is one of readings."""
    out = ask(g, ["LOCATION_AREA", "DAY"], ["TOTAL_CONSUMPTION", "ACTIVE_METER_COUNT", "OUTAGE_COUNT", "AVG_OUTAGE_DURATION"], ["PEAK_HOURS"])
    return r8(out, "avg_outage_duration").withColumn("total_consumption", F.round("total_consumption", 6))


@register("semantic_three_facts", """
SELECT (SELECT round(sum(usage_kwh_adjusted),6) FROM final) AS total_consumption, (SELECT max(load_factor_pct) FROM hourly_load) AS peak_load_factor, (SELECT count(DISTINCT outage_id) FROM outages) AS outage_count""")
def semantic_three_facts(g):
    return ask(g, [], ["TOTAL_CONSUMPTION", "PEAK_LOAD_FACTOR", "OUTAGE_COUNT"]).withColumn("total_consumption", F.round("total_consumption", 6))


@register("verified_monthly_usage_trend", """
SELECT date_trunc('month', reading_ts)::timestamp AS reading_month, round(sum(usage_kwh_adjusted),6) AS total_consumption, count(DISTINCT meter_id) AS active_meter_count, round(avg(usage_kwh_adjusted),8) AS avg_consumption FROM final GROUP BY 1""")
def verified_monthly_usage_trend(g):
    return r8(ask(g, ["READING_MONTH"], ["TOTAL_CONSUMPTION", "ACTIVE_METER_COUNT", "AVG_CONSUMPTION"]), "avg_consumption").withColumn("total_consumption", F.round("total_consumption", 6))


@register("verified_customer_segment_analysis", """
SELECT c.segment AS customer_segment, round(sum(usage_kwh_adjusted),6) AS total_consumption, round(avg(usage_kwh_adjusted),8) AS avg_consumption FROM final f LEFT JOIN customers c ON c.meter_id=f.meter_id GROUP BY 1""")
def verified_customer_segment_analysis(g):
    return r8(ask(g, ["CUSTOMER_SEGMENT"], ["TOTAL_CONSUMPTION", "AVG_CONSUMPTION"]), "avg_consumption").withColumn("total_consumption", F.round("total_consumption", 6))


@register("verified_stress_by_area", """
SELECT location_area, count(DISTINCT h.transformer_id) AS loaded_transformers, round(avg(load_factor_pct),6) AS avg_load_factor, count_if(stress='CRITICAL') AS critical_hours FROM stressed h JOIN aged t ON t.transformer_id=h.transformer_id GROUP BY 1""")
def verified_stress_by_area(g):
    return ask(g, ["LOCATION_AREA"], ["LOADED_TRANSFORMERS", "AVG_LOAD_FACTOR", "CRITICAL_HOURS"]).withColumn("avg_load_factor", F.round("avg_load_factor", 6))


@register("verified_outages_total_summary", "SELECT cause, count(DISTINCT outage_id) AS outage_count, sum(customers)::bigint AS total_customers_affected FROM outages GROUP BY 1")
def verified_outages_total_summary(g):
    return ask(g, ["CAUSE"], ["OUTAGE_COUNT", "TOTAL_CUSTOMERS_AFFECTED"])


@register("verified_daily_consumption_by_meter", "SELECT date_trunc('day', reading_ts)::timestamp AS day, round(sum(usage_kwh),6) AS total_kwh FROM readings WHERE meter_id='MTR-00000007' GROUP BY 1")
def verified_daily_consumption_by_meter(g):
    rows = g.readings.where("meter_id = 'MTR-00000007'")
    return rows.groupBy(F.date_trunc("DAY", "reading_ts").cast("timestamp_ntz").alias("day")).agg(F.round(F.sum("usage_kwh"), 6).alias("total_kwh"))


@register("verified_peak_hour_demand", "SELECT round(sum(usage_kwh_adjusted),6) AS total_consumption FROM final WHERE extract(hour from reading_ts) BETWEEN 14 AND 19")
def verified_peak_hour_demand(g):
    return ask(g, [], ["TOTAL_CONSUMPTION"], ["PEAK_HOURS"]).withColumn("total_consumption", F.round("total_consumption", 6))


@register("verified_yoy_comparison", "WITH m AS (SELECT meter_id, date_trunc('month', reading_ts) AS mo, sum(usage_kwh) AS k FROM readings GROUP BY 1,2) SELECT year(mo) AS year, round(sum(k),6) AS total_consumption, round(avg(k),8) AS avg_per_meter FROM m WHERE month(mo)=1 GROUP BY 1")
def verified_yoy_comparison(g):
    m = R.monthly_usage(g.readings).where(F.month("usage_month") == 1)
    return m.groupBy(F.year("usage_month").alias("year")).agg(F.round(F.sum("total_kwh"), 6).alias("total_consumption"), F.round(F.avg("total_kwh"), 8).alias("avg_per_meter"))


@register("verified_sag_analysis", "SELECT sag_type, count(*) AS reading_count, round(avg(voltage_v),8) AS avg_voltage FROM final GROUP BY 1 HAVING sag_type IS NOT NULL")
def verified_sag_analysis(g):
    return r8(ask(g, ["SAG_TYPE"], ["READING_COUNT", "AVG_VOLTAGE"], ["VOLTAGE_SAG_EVENTS"]), "avg_voltage")


@register("verified_transformers_by_health", "SELECT CASE WHEN health_score>=80 THEN 'GOOD' WHEN health_score>=60 THEN 'FAIR' WHEN health_score>=40 THEN 'POOR' ELSE 'CRITICAL' END AS health_category, count(*) AS transformer_count, round(avg(age_years),8) AS avg_age FROM aged GROUP BY 1")
def verified_transformers_by_health(g):
    return r8(ask(g, ["HEALTH_CATEGORY"], ["TRANSFORMER_COUNT", "AVG_AGE"]), "avg_age")


@register("verified_overloaded_transformers", """
SELECT h.transformer_id, max(h.rated_kva) AS rated_kva, max(load_factor_pct) AS peak_loading, count(*) AS overload_hours FROM hourly_load h WHERE load_hour>=(SELECT max(load_hour) FROM hourly_load)-INTERVAL 30 DAY AND load_factor_pct>100 GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 20""")
def verified_overloaded_transformers(g):
    from wattline.operators.anchors import latest, topk

    rows = g.hourly_load.where((F.col("load_hour") >= latest(g.hourly_load, "load_hour") - F.expr("interval 30 days")) & (F.col("load_factor_pct") > 100))
    per = rows.groupBy("transformer_id").agg(F.max("rated_kva").alias("rated_kva"), F.max("load_factor_pct").alias("peak_loading"), F.count(F.lit(1)).alias("overload_hours"))
    return topk(per, [F.col("peak_loading").desc(), F.col("transformer_id").asc()], 20)


@register("verified_aging_fleet", "SELECT manufacturer, count(*) AS transformer_count, round(avg(health_score),8) AS avg_health_score FROM aged WHERE age_years>30 GROUP BY 1")
def verified_aging_fleet(g):
    return r8(ask(g, ["MANUFACTURER"], ["TRANSFORMER_COUNT", "AVG_HEALTH_SCORE"], ["AGING"]), "avg_health_score")

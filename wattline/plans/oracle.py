"""DuckDB text of the derived tables, prepended to a check query as common table expressions."""

from __future__ import annotations

import re


def u(key: str) -> str:
    """Keyed uniform of a text expression."""
    return f"(cast('0x'||substr(md5({key}),1,13) as bigint)/4503599627370496.0)"


def hav(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return (
        f"(2*6371.0*asin(sqrt(least(1.0, pow(sin(radians(({lat2})-({lat1}))/2),2)"
        f"+cos(radians({lat1}))*cos(radians({lat2}))*pow(sin(radians(({lon2})-({lon1}))/2),2)))))"
    )


_LEVEL = "cast(json_extract_string(props,'$.k') as int)"
_DEAD = f"event_type='error' AND {_LEVEL}<10"

VIEWS = {
    "substations": f"""
SELECT 'SUB-'||lpad(cast(n_nationkey+1 as varchar),4,'0') AS substation_id, n_name||' Substation' AS substation_name,
 29.4::double+0.8::double*{u("'S'||n_nationkey||'lat'")} AS lat, -95.8::double+0.9::double*{u("'S'||n_nationkey||'lon'")} AS lon,
 100+(n_nationkey*37)%400 AS capacity_mva, n_regionkey AS region_id, n_nationkey AS k FROM nation""",
    "circuits": """
SELECT 'FDR-'||lpad(cast(s_suppkey as varchar),5,'0') AS circuit_id, s.substation_id, s.lat AS s_lat, s.lon AS s_lon,
 s_suppkey AS k, CASE WHEN s_suppkey%50=7 THEN 'OUTAGE' ELSE 'ENERGIZED' END AS status
 FROM supplier JOIN substations s ON s.k=s_nationkey""",
    "transformers": f"""
SELECT 'XF-'||lpad(cast(p_partkey as varchar),6,'0') AS transformer_id, c.circuit_id, c.substation_id, p_partkey AS k,
 c.s_lat+0.04::double*({u("'T'||p_partkey||'lat'")}-0.5::double) AS lat, c.s_lon+0.04::double*({u("'T'||p_partkey||'lon'")}-0.5::double) AS lon,
 p_size*10 AS rated_kva, 1972+p_partkey%54 AS install_year, cast(28+(p_partkey*37)%72 as double) AS health_score,
 cast(30+(p_partkey*13)%90 as double) AS load_utilization_pct, p_brand AS manufacturer, p_type AS role
 FROM part CROSS JOIN (SELECT count(*) AS n FROM supplier) z JOIN circuits c ON c.k=p_partkey%z.n""",
    "meters": f"""
SELECT 'MTR-'||lpad(cast(c_custkey as varchar),8,'0') AS meter_id, t.transformer_id, t.circuit_id, t.substation_id, c_custkey AS k,
 t.lat+0.006::double*({u("'M'||c_custkey||'lat'")}-0.5::double) AS lat, t.lon+0.006::double*({u("'M'||c_custkey||'lon'")}-0.5::double) AS lon,
 c_mktsegment AS segment, 'County'||(c_nationkey%5) AS county
 FROM customer CROSS JOIN (SELECT count(*) AS n FROM part) z JOIN transformers t ON t.k=c_custkey%z.n""",
    "customers": """
SELECT 'CUST-'||lpad(cast(c_custkey as varchar),8,'0') AS customer_id, c_name AS full_name,
 'MTR-'||lpad(cast(c_custkey as varchar),8,'0') AS meter_id, c_mktsegment AS segment, 'City'||c_nationkey AS city,
 CASE WHEN c_custkey%20=0 THEN 'CLOSED' ELSE 'ACTIVE' END AS account_status FROM customer""",
    "readings": f"""
SELECT 'MTR-'||lpad(cast(user_id as varchar),8,'0') AS meter_id, ts AS reading_ts,
 CASE WHEN {_DEAD} THEN 0.0::double ELSE value/100 END AS usage_kwh,
 CASE WHEN {_DEAD} THEN 0.0::double ELSE 105.0::double+{_LEVEL}*0.25::double END AS voltage_v,
 0.85::double+(event_id%15)/100.0::double AS power_factor,
 CASE WHEN {_DEAD} THEN 'OUTAGE' WHEN event_id%50=0 THEN 'ESTIMATED' ELSE 'VALID' END AS quality FROM events""",
    "hourly_load": """
SELECT 'XF-'||lpad(cast(l_partkey as varchar),6,'0') AS transformer_id, l_shipdate+INTERVAL 1 HOUR*l_linenumber AS load_hour,
 sum(l_quantity*5) AS load_kw, max(t.rated_kva) AS rated_kva, sum(l_quantity*5)/max(t.rated_kva)*100 AS load_factor_pct
 FROM lineitem JOIN transformers t ON t.k=l_partkey GROUP BY 1,2""",
    "outages": """
SELECT 'OUT-'||o_orderkey AS outage_id, t.transformer_id, t.circuit_id, t.substation_id,
 timestamp '2024-01-01 00:00:00'+INTERVAL 1 MINUTE*(o_orderkey*97%43200) AS start_ts,
 timestamp '2024-01-01 00:00:00'+INTERVAL 1 MINUTE*(o_orderkey*97%43200+5+o_orderkey%600) AS end_ts,
 CASE o_orderpriority WHEN '1-URGENT' THEN 'WEATHER' WHEN '2-HIGH' THEN 'TRANSFORMER_OVERLOAD' WHEN '3-MEDIUM' THEN 'VEGETATION' ELSE 'OTHER' END AS cause,
 CASE o_orderstatus WHEN 'O' THEN 'ACTIVE' ELSE 'RESTORED' END AS status, o_custkey%150 AS customers
 FROM orders CROSS JOIN (SELECT count(*) AS n FROM part) z JOIN transformers t ON t.k=o_orderkey%z.n""",
    "weather": f"""
SELECT hour, 60.0::double+20.0::double*sin(2.0::double*pi()*extract(hour from hour)/24.0::double)
 +10.0::double*{u("strftime(hour,'%Y-%m-%d %H:%M:%S')")} AS temperature_f,
 40.0::double+40.0::double*{u("strftime(hour,'%Y-%m-%d %H:%M:%S')||'h'")} AS humidity_pct
 FROM (SELECT unnest(generate_series(timestamp '2024-01-01 00:00:00', timestamp '2024-01-31 23:00:00', INTERVAL 1 HOUR)) AS hour)""",
    "poles": f"""
SELECT 'POLE-'||lpad(cast(k as varchar),6,'0') AS pole_id, transformer_id, circuit_id, substation_id,
 lat+0.004::double*({u("'P'||k||'lat'")}-0.5::double) AS lat, lon+0.004::double*({u("'P'||k||'lon'")}-0.5::double) AS lon,
 30+k%26 AS height_ft FROM transformers WHERE {u("'P'||k||'has'")}<0.68::double""",
    "final": """
SELECT *, CASE WHEN usage_kwh=0 AND voltage_v<100 THEN true ELSE false END AS is_outage,
 CASE WHEN usage_kwh=0 AND voltage_v<100 THEN 0.0::double ELSE usage_kwh END AS usage_kwh_adjusted,
 CASE WHEN voltage_v<108 THEN 'SEVERE_SAG' WHEN voltage_v<114 THEN 'MODERATE_SAG' WHEN voltage_v>126 THEN 'SWELL' END AS sag_type,
 CASE WHEN voltage_v<114 THEN 120.0::double-voltage_v ELSE 0.0::double END AS voltage_drop,
 CASE WHEN voltage_v<114 OR voltage_v>126 THEN 'VSE-'||strftime(reading_ts,'%Y%m%d%H%M%S')||'-'||meter_id END AS voltage_event_id
 FROM readings""",
    "stressed": """
SELECT *, CASE WHEN load_factor_pct>=120 THEN 'CRITICAL' WHEN load_factor_pct>=100 THEN 'HIGH'
 WHEN load_factor_pct>=80 THEN 'MODERATE' ELSE 'LOW' END AS stress FROM hourly_load""",
    "aged": """
SELECT *, 2026-install_year AS age_years, CASE WHEN lat<29.4 THEN 'Coastal Texas' WHEN lat<29.8 AND lon>-95.3 THEN 'Houston Metro'
 WHEN lat>=29.8 THEN 'Montgomery County' ELSE 'Harris County' END AS location_area FROM transformers""",
}


def full_sql(body: str) -> str:
    """Prepend the definitions of every derived table that ``body`` names, in dependency order."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(VIEWS[name])

    visit(body)
    parts = [f"{name} AS ({VIEWS[name].strip()})" for name in VIEWS if name in needed]
    body = body.strip()
    if not parts:
        return body
    match = re.match(r"(?i)with\s+(recursive\s+)?", body)
    if match:
        recursive = "RECURSIVE " if match.group(1) else ""
        return f"WITH {recursive}" + ",\n".join(parts) + ",\n" + body[match.end():]
    return "WITH " + ",\n".join(parts) + "\n" + body

"""Named queries on positions and on the grid graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattline.functions import geometry as G
from wattline.functions.hashing import keyed_uniform
from wattline.operators import geo, graph, pyramid
from wattline.operators.anchors import latest
from wattline.plans.network_queries import aged, r8
from wattline.plans.oracle import hav, u
from wattline.plans.registry import register

LAT, LON = 29.78, -95.35


def cell_sql(lat: str, lon: str, res: int) -> str:
    """Cell id in DuckDB."""
    import math

    e = G.EDGE_M[res] / 1000.0
    x = f"((({lon})-({G.ORIGIN_LON}))*{G._LON_KM!r}::double)"
    y = f"((({lat})-({G.ORIGIN_LAT}))*{G.KM_PER_DEGREE!r}::double)"
    q = f"(({math.sqrt(3.0) / 3!r}::double*{x}-{y}/3)/{e!r}::double)"
    r = f"({2.0 / 3!r}::double*{y}/{e!r}::double)"
    rq, rr, rs = f"floor({q}+0.5)", f"floor({r}+0.5)", f"floor(-{q}-{r}+0.5)"
    dq, dr, ds = f"abs({rq}-{q})", f"abs({rr}-{r})", f"abs({rs}-(-{q}-{r}))"
    oq = f"(CASE WHEN {dq}>{dr} AND {dq}>{ds} THEN -{rr}-{rs} ELSE {rq} END)::bigint"
    orr = f"(CASE WHEN {dq}>{dr} AND {dq}>{ds} THEN {rr} WHEN {dr}>{ds} THEN -{rq}-{rs} ELSE {rr} END)::bigint"
    return f"('r{res}:'||({oq})||':'||({orr}))"


@register("haversine", f"""
SELECT meter_id, round({hav('m.lat','m.lon','t.lat','t.lon')},8) AS km FROM meters m JOIN transformers t ON t.transformer_id=m.transformer_id""")
def haversine(g):
    t = g.transformers.select("transformer_id", F.col("lat").alias("t_lat"), F.col("lon").alias("t_lon"))
    km = G.haversine(F.col("lat"), F.col("lon"), F.col("t_lat"), F.col("t_lon"))
    return g.meters.join(t, "transformer_id").select("meter_id", F.round(km, 8).alias("km"))


@register("radius_search", f"""
SELECT transformer_id, load_utilization_pct, round({hav(str(LAT), str(LON), 'lat', 'lon')},8) AS distance_km FROM transformers WHERE {hav(str(LAT), str(LON), 'lat', 'lon')}<=15""")
def radius_search(g):
    out = geo.find_nearby(g.transformers.select("transformer_id", "lat", "lon", "load_utilization_pct"), LAT, LON, 15)
    return out.select("transformer_id", "load_utilization_pct", F.round("distance_km", 8).alias("distance_km"))


@register("bbox_filter", "SELECT transformer_id, lat, lon FROM transformers WHERE lat BETWEEN 29.6 AND 29.9 AND lon BETWEEN -95.6 AND -95.2")
def bbox_filter(g):
    return geo.in_envelope(g.transformers, 29.6, 29.9, -95.6, -95.2).select("transformer_id", "lat", "lon")


@register("hex_index", f"SELECT meter_id, {cell_sql('lat', 'lon', 9)} AS cell9, {cell_sql('lat', 'lon', 7)} AS cell7 FROM meters")
def hex_index(g):
    return g.meters.select("meter_id", G.cell(F.col("lat"), F.col("lon"), 9).alias("cell9"), G.cell(F.col("lat"), F.col("lon"), 7).alias("cell7"))


@register("hex_density", f"""
SELECT {cell_sql('lat', 'lon', 7)} AS cell, count(*) AS transformer_count, sum(rated_kva)::bigint AS total_kva, round(avg(health_score),8) AS avg_health FROM transformers GROUP BY 1
HAVING count(*)>=5 ORDER BY 2 DESC, 1 LIMIT 100""")
def hex_density(g):
    return r8(geo.hex_density(g.transformers, 7), "avg_health")


def _parent_sql(res: int) -> str:
    """Cell of the centre of a resolution-8 cell (q, r)."""
    e = G.EDGE_M[8] / 1000.0
    lat = f"({G.ORIGIN_LAT}::double+({e * 1.5!r}::double*r)/{G.KM_PER_DEGREE!r}::double)"
    lon = f"({G.ORIGIN_LON}::double+({e * 3 ** 0.5!r}::double*(q+r/2))/{G._LON_KM!r}::double)"
    return cell_sql(lat, lon, res)


@register("hex_rollup", f"""
WITH b AS (SELECT {cell_sql('lat', 'lon', 8)} AS cell, count(*) AS n, sum(rated_kva) AS kva FROM transformers GROUP BY 1), s AS (SELECT *, split_part(cell,':',2)::bigint AS q, split_part(cell,':',3)::bigint AS r FROM b),
l AS (SELECT 8 AS resolution, cell AS c, n, kva FROM s UNION ALL SELECT 7, {_parent_sql(7)}, n, kva FROM s UNION ALL SELECT 6, {_parent_sql(6)}, n, kva FROM s UNION ALL SELECT 5, {_parent_sql(5)}, n, kva FROM s),
p AS (SELECT resolution, c, sum(n) AS n, sum(kva) AS kva FROM l GROUP BY 1,2)
SELECT resolution, count(*) AS cell_count, sum(n)::bigint AS total_transformers, round(avg(n),2) AS avg_per_cell, sum(kva)::bigint AS total_kva FROM p GROUP BY 1""")
def hex_rollup(g):
    return geo.hex_rollup(g.transformers)


@register("hex_same_cell_join", f"""
SELECT m.meter_id, t.transformer_id, {cell_sql('m.lat', 'm.lon', 9)} AS cell FROM meters m JOIN transformers t ON {cell_sql('m.lat', 'm.lon', 9)}={cell_sql('t.lat', 't.lon', 9)} ORDER BY 1, 2 LIMIT 100""")
def hex_same_cell_join(g):
    return geo.cell_join(g.meters, g.transformers, "meter_id", "transformer_id", 9)


@register("hex_cell_pair_counts", f"""
WITH m AS (SELECT {cell_sql('lat', 'lon', 8)} AS cell, count(*) AS a FROM meters GROUP BY 1), t AS (SELECT {cell_sql('lat', 'lon', 8)} AS cell, count(*) AS b FROM transformers GROUP BY 1)
SELECT m.cell, a AS left_rows, b AS right_rows, a*b AS pairs FROM m JOIN t ON t.cell=m.cell""")
def hex_cell_pair_counts(g):
    return geo.cell_pair_counts(g.meters, g.transformers, 8)


@register("hex_kring", f"""
WITH c AS (SELECT {cell_sql(str(LAT), str(LON), 7)} AS c0), m AS (SELECT transformer_id, {cell_sql('lat', 'lon', 7)} AS cell FROM transformers),
d AS (SELECT m.*, split_part(cell,':',2)::bigint-split_part(c0,':',2)::bigint AS dq, split_part(cell,':',3)::bigint-split_part(c0,':',3)::bigint AS dr FROM m, c)
SELECT transformer_id, cell FROM d WHERE greatest(abs(dq), abs(dr), abs(dq+dr))<=5""")
def hex_kring(g):
    return geo.k_ring(g.transformers, LAT, LON, 5, 7).select("transformer_id", "cell")


@register("meters_near", f"""
SELECT meter_id, transformer_id, circuit_id, round({hav(str(LAT), str(LON), 'lat', 'lon')}*1000,1) AS distance_m FROM meters WHERE {hav(str(LAT), str(LON), 'lat', 'lon')}*1000<=9000""")
def meters_near(g):
    return geo.meters_near(g.meters, LAT, LON, 9000).select("meter_id", "transformer_id", "circuit_id", "distance_m")


@register("join_spatial_radius", f"""
SELECT t.transformer_id, s.substation_id, round({hav('t.lat','t.lon','s.lat','s.lon')},8) AS distance_km FROM transformers t JOIN substations s ON {hav('t.lat','t.lon','s.lat','s.lon')}<=6""")
def join_spatial_radius(g):
    return r8(geo.within_radius(g.transformers, g.substations, "transformer_id", "substation_id", 6.0), "distance_km")


@register("nearest_match", f"""
WITH d AS (SELECT m.meter_id, p.pole_id, {hav('m.lat','m.lon','p.lat','p.lon')} AS km, row_number() OVER (PARTITION BY m.meter_id ORDER BY {hav('m.lat','m.lon','p.lat','p.lon')}, p.pole_id) AS rn FROM meters m CROSS JOIN poles p WHERE abs(m.lat-p.lat)<0.01),
b AS (SELECT * FROM d WHERE rn=1 AND km<=0.5)
SELECT m.meter_id, b.pole_id, CASE WHEN b.km IS NULL THEN 'INTERPOLATED' WHEN b.km*1000<=10 THEN 'EXACT' ELSE 'NEAREST' END AS match_type, round(b.km*1000,6) AS distance_m,
 round(CASE WHEN b.km IS NULL THEN 0 ELSE greatest(0.0,1-b.km*1000/500.0) END,6)::double AS match_confidence, coalesce(p.lat,m.lat) AS lat, coalesce(p.lon,m.lon) AS lon, m.lat AS original_lat, m.lon AS original_lon
FROM meters m LEFT JOIN b ON b.meter_id=m.meter_id LEFT JOIN poles p ON p.pole_id=b.pole_id""")
def nearest_match(g):
    out = geo.nearest_match(g.meters, g.poles, "meter_id", "pole_id")
    return out.withColumns({"distance_m": F.round("distance_m", 6), "match_confidence": F.round("match_confidence", 6)})


@register("hex_ratio", f"""
WITH m AS (SELECT {cell_sql('lat', 'lon', 7)} AS cell, count(*) AS n, avg(lat) AS a, avg(lon) AS o FROM meters GROUP BY 1), t AS (SELECT {cell_sql('lat', 'lon', 7)} AS cell, count(*) AS n FROM transformers GROUP BY 1)
SELECT m.cell, m.n AS meter_count, coalesce(t.n,0) AS transformer_count, round(m.n/nullif(t.n,0),1) AS meters_per_transformer, round(a,8) AS mean_lat, round(o,8) AS mean_lon FROM m LEFT JOIN t ON t.cell=m.cell""")
def hex_ratio(g):
    return r8(geo.hex_ratio(g.meters, g.transformers, 7), "mean_lat", "mean_lon")


@register("territory_coverage", f"""
WITH a AS (SELECT {cell_sql('lat', 'lon', 7)} AS cell, 1 AS s, 0 AS t, 0 AS m, capacity_mva*1000::double AS kva FROM substations UNION ALL SELECT {cell_sql('lat', 'lon', 7)}, 0, 1, 0, rated_kva FROM transformers
 UNION ALL SELECT {cell_sql('lat', 'lon', 7)}, 0, 0, 1, 0 FROM meters)
SELECT cell, sum(s)::bigint AS substation_count, sum(t)::bigint AS transformer_count, sum(m)::bigint AS meter_count, sum(kva)::double AS total_capacity_kva FROM a GROUP BY 1""")
def territory_coverage(g):
    return geo.coverage(g.substations, g.transformers, g.meters)


@register("coverage_gaps", f"""
WITH c AS (SELECT {cell_sql('lat', 'lon', 9)} AS cell, count(*) AS n FROM meters GROUP BY 1 HAVING count(*)<10),
p AS (SELECT cell, n, split_part(cell,':',2)::bigint AS q, split_part(cell,':',3)::bigint AS r FROM c),
x AS (SELECT cell, n, {G.ORIGIN_LAT}::double+({0.174 * 1.5!r}::double*r)/{G.KM_PER_DEGREE!r}::double AS lat, {G.ORIGIN_LON}::double+({0.174 * 3 ** 0.5!r}::double*(q+r/2))/{G._LON_KM!r}::double AS lon FROM p),
d AS (SELECT x.*, (SELECT min({hav('x.lat','x.lon','s.lat','s.lon')}) FROM substations s) AS km FROM x)
SELECT cell, round(lat,8) AS center_lat, round(lon,8) AS center_lon, n AS meter_count, round(km,8) AS nearest_substation_km, CASE WHEN km>10 THEN 'CRITICAL_GAP' WHEN km>5 THEN 'MODERATE_GAP' ELSE 'MINOR_GAP' END AS gap_type FROM d""")
def coverage_gaps(g):
    return r8(geo.coverage_gaps(g.meters, g.substations), "center_lat", "center_lon", "nearest_substation_km")


def _trees(g):
    """One tree near every pole."""
    p = F.col("pole_id")
    return g.poles.select(
        F.concat(F.lit("TREE-"), p).alias("tree_id"),
        (F.col("lat") + F.lit(0.0006) * (keyed_uniform(p, "tl") - 0.5)).alias("lat"), (F.col("lon") + F.lit(0.0006) * (keyed_uniform(p, "to") - 0.5)).alias("lon"),
        (F.lit(4.0) + 20.0 * keyed_uniform(p, "th")).alias("height_m"), (F.lit(1.0) + 3.0 * keyed_uniform(p, "tc")).alias("canopy_radius_m"),
        (F.lit(0.2) + 0.6 * keyed_uniform(p, "tg")).alias("growth_m"), keyed_uniform(p, "tr").alias("risk_score"),
    )


TREES = f"""trees AS (SELECT 'TREE-'||pole_id AS tree_id, lat+0.0006::double*({u("pole_id||'tl'")}-0.5::double) AS lat, lon+0.0006::double*({u("pole_id||'to'")}-0.5::double) AS lon,
 4.0::double+20.0::double*{u("pole_id||'th'")} AS height_m, 1.0::double+3.0::double*{u("pole_id||'tc'")} AS canopy_radius_m, 0.2::double+0.6::double*{u("pole_id||'tg'")} AS growth_m, {u("pole_id||'tr'")} AS risk_score FROM poles)"""


@register("vegetation_cells", f"""
WITH {TREES} SELECT {cell_sql('lat', 'lon', 8)} AS cell, count(*) AS tree_count, round(avg(risk_score),8) AS avg_risk, max(height_m) AS max_height_m FROM trees GROUP BY 1 HAVING avg(risk_score)>0.7""")
def vegetation_cells(g):
    return r8(geo.veg_cells(_trees(g)), "avg_risk")


@register("vegetation_clearance", f"""
WITH {TREES}, lines AS (SELECT transformer_id AS line_id, lat, lon, CASE WHEN k%3=0 THEN 138.0::double ELSE 12.47::double END AS voltage_kv FROM transformers),
d AS (SELECT t.*, l.line_id, l.voltage_kv, {hav('t.lat','t.lon','l.lat','l.lon')} AS km, row_number() OVER (PARTITION BY tree_id ORDER BY {hav('t.lat','t.lon','l.lat','l.lon')}, l.line_id) AS rn FROM trees t JOIN lines l ON abs(t.lat-l.lat)<0.02),
n AS (SELECT *, CASE WHEN voltage_kv>=345 THEN 7.6 WHEN voltage_kv>=138 THEN 4.6 WHEN voltage_kv>=69 THEN 3.0 ELSE 1.2 END::double AS need, km*1000-canopy_radius_m AS free FROM d WHERE rn=1)
SELECT tree_id, line_id, round(km*1000,6) AS distance_to_line_m, voltage_kv, need AS minimum_clearance_m, round(greatest(0.0::double,need-free),6) AS clearance_deficit_m, round(CASE WHEN free<=need THEN 0.0::double ELSE (free-need)/nullif(growth_m,0) END,6) AS years_to_encroachment FROM n""")
def vegetation_clearance(g):
    lines = g.transformers.select(F.col("transformer_id").alias("line_id"), "lat", "lon", F.when(F.col("k") % 3 == 0, 138.0).otherwise(12.47).alias("voltage_kv"))
    out = geo.veg_clearance(_trees(g), lines)
    return out.withColumns({c: F.round(c, 6) for c in ("distance_to_line_m", "clearance_deficit_m", "years_to_encroachment")})


@register("geo_nodes", "SELECT transformer_id AS asset_id, circuit_id AS parent_id, rated_kva::double AS capacity_kva, lat, lon FROM transformers UNION ALL SELECT substation_id, NULL, capacity_mva*1000::double, lat, lon FROM substations UNION ALL SELECT circuit_id, substation_id, NULL, s_lat, s_lon FROM circuits UNION ALL SELECT meter_id, transformer_id, NULL, lat, lon FROM meters")
def geo_nodes(g):
    nodes = graph.hierarchy_nodes(g.substations, g.circuits, g.transformers, g.meters)
    return geo.geo_nodes(nodes).where("geom_wkt LIKE 'POINT(%'").select("asset_id", "parent_id", "capacity_kva", "lat", "lon")


@register("disk_placement", f"""
WITH p AS (SELECT transformer_id, lat AS a, lon AS o, 4.0::double*sqrt({u("transformer_id||'radius'")}) AS km, 2.0::double*pi()*{u("transformer_id||'bearing'")} AS b FROM transformers)
SELECT transformer_id, round(a+km*cos(b)/(111.132::double-0.559::double*cos(2*radians(a))+0.001::double*cos(4*radians(a))),6) AS new_lat, round(o+km*sin(b)/(111.320::double*cos(radians(a))),6) AS new_lon FROM p""")
def disk_placement(g):
    from wattline.operators.modelling import place

    return place(g.transformers, "transformer_id", 4.0, "lat", "lon", "new_lat", "new_lon").select("transformer_id", "new_lat", "new_lon")


# ---------------------------------------------------------------- graph

def _edges(g):
    return graph.hierarchy_edges(graph.hierarchy_nodes(g.substations, g.circuits, g.transformers, g.meters))


EDGES = """e AS (SELECT substation_id AS src, circuit_id AS dst, 'SUBSTATION -> CIRCUIT' AS edge_type FROM circuits UNION ALL SELECT circuit_id, transformer_id, 'CIRCUIT -> TRANSFORMER' FROM transformers UNION ALL SELECT transformer_id, meter_id, 'TRANSFORMER -> METER' FROM meters),
 b AS (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e) WHERE src<>dst)"""


@register("grid_nodes_edges", f"""
WITH c AS (SELECT c.*, s.lat, s.lon FROM circuits c JOIN substations s ON s.substation_id=c.substation_id)
SELECT substation_id AS src, circuit_id AS dst, 'SUBSTATION -> CIRCUIT' AS edge_type, round({hav('lat','lon','s_lat','s_lon')},6) AS length_km FROM c
UNION ALL SELECT c.circuit_id, t.transformer_id, 'CIRCUIT -> TRANSFORMER', round({hav('c.s_lat','c.s_lon','t.lat','t.lon')},6) FROM transformers t JOIN circuits c ON c.circuit_id=t.circuit_id
UNION ALL SELECT t.transformer_id, m.meter_id, 'TRANSFORMER -> METER', round({hav('t.lat','t.lon','m.lat','m.lon')},6) FROM meters m JOIN transformers t ON t.transformer_id=m.transformer_id""")
def grid_nodes_edges(g):
    return _edges(g).select("src", "dst", "edge_type", F.round("length_km", 6).alias("length_km"))


NODES = """dn AS (SELECT substation_id, count(*) AS n, sum(rated_kva) AS kva, avg(health_score) AS h FROM transformers GROUP BY 1),
 gn AS (SELECT 'SUB_'||s.substation_id AS node_id, 'SUBSTATION' AS node_type, coalesce(n,0) AS dt, 0.5::double*coalesce(kva/(SELECT max(kva) FROM dn),0)+0.5::double*(1-coalesce(h,100)/100) AS crit FROM substations s LEFT JOIN dn ON dn.substation_id=s.substation_id
 UNION ALL SELECT 'XFMR_'||transformer_id, 'TRANSFORMER', 0, 0.5::double*rated_kva/(SELECT max(rated_kva) FROM transformers)+0.5::double*(1-health_score/100) FROM transformers)"""


@register("grid_nodes", f"WITH {NODES} SELECT node_id, node_type, dt AS downstream_transformers, round(crit,8) AS criticality_score FROM gn")
def grid_nodes(g):
    return r8(graph.grid_nodes(g.substations, g.transformers).select("node_id", "node_type", "downstream_transformers", "criticality_score"), "criticality_score")


@register("downstream_assets", """
WITH mc AS (SELECT transformer_id, count(*) AS n FROM meters GROUP BY 1)
SELECT substation_id AS source_id, substation_id AS downstream_id, 'SUBSTATION' AS asset_type, 0 AS hops, 0::bigint AS affected_customers FROM substations
UNION ALL SELECT t.substation_id, t.transformer_id, 'TRANSFORMER', 1, coalesce(n,0) FROM transformers t LEFT JOIN mc ON mc.transformer_id=t.transformer_id
UNION ALL SELECT t.substation_id, m.meter_id, 'METER', 2, 1 FROM meters m JOIN transformers t ON t.transformer_id=m.transformer_id""")
def downstream_assets(g):
    starts = g.substations.select(F.col("substation_id").alias("asset_id"), F.lit("SUBSTATION").alias("asset_type"))
    return graph.downstream(g.substations, g.transformers, g.meters, starts)


@register("bfs_waves", f"""
WITH RECURSIVE {EDGES},
w AS (SELECT circuit_id AS node, 0 AS depth FROM circuits WHERE status='OUTAGE' UNION SELECT b.dst, w.depth+1 FROM w JOIN b ON b.src=w.node WHERE w.depth<3)
SELECT node, min(depth) AS depth FROM w GROUP BY 1""")
def bfs_waves(g):
    seeds = g.circuits.where("status = 'OUTAGE'").select(F.col("circuit_id").alias("node"))
    return graph.bfs(_edges(g), seeds, 3)


@register("degree_reach", f"""
WITH {EDGES}, d AS (SELECT src AS node, count(*) AS degree FROM b GROUP BY 1),
n2 AS (SELECT node, count(*) AS n2 FROM (SELECT DISTINCT x.src AS node, y.dst AS far FROM b x JOIN b y ON x.dst=y.src WHERE x.src<>y.dst) p WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.src=p.node AND b.dst=p.far) GROUP BY 1)
SELECT d.node, degree, degree AS neighbors_1hop, coalesce(n2,0) AS neighbors_2hop, degree+coalesce(n2,0) AS total_reach, round(coalesce(n2,0)/degree,8) AS reach_expansion_ratio,
 round(degree/((SELECT count(*) FROM d)-1),8) AS normalized_degree FROM d LEFT JOIN n2 ON n2.node=d.node""")
def degree_reach(g):
    return r8(graph.degree_reach(_edges(g)), "reach_expansion_ratio", "normalized_degree")


def _pagerank_sql(rounds: int) -> str:
    steps = ["d AS (SELECT src AS node, count(*) AS d FROM b GROUP BY 1)", "n AS (SELECT count(*)::double AS n FROM d)", "r0 AS (SELECT node, 1.0/n AS r FROM d, n)"]
    for i in range(rounds):
        steps.append(
            f"r{i + 1} AS (SELECT d.node, 0.15::double/max(n.n)+0.85::double*coalesce(sum(p.r/dd.d),0) AS r FROM d CROSS JOIN n LEFT JOIN b ON b.dst=d.node LEFT JOIN r{i} p ON p.node=b.src LEFT JOIN d dd ON dd.node=b.src GROUP BY 1)"
        )
    return f"WITH {EDGES}, " + ", ".join(steps) + f" SELECT node, round(r,10) AS pagerank FROM r{rounds}"


@register("pagerank", _pagerank_sql(5))
def pagerank(g):
    return graph.pagerank(_edges(g), 5).withColumn("pagerank", F.round("pagerank", 10))


def _eigen_sql(rounds: int) -> str:
    steps = ["x0 AS (SELECT DISTINCT src AS node, 1.0::double AS x FROM b)"]
    for i in range(rounds):
        steps.append(f"s{i + 1} AS (SELECT v.node, any_value(v.x)+sum(p.x) AS x FROM x{i} v JOIN b ON b.dst=v.node JOIN x{i} p ON p.node=b.src GROUP BY 1)")
        steps.append(f"x{i + 1} AS (SELECT node, x/(SELECT sqrt(sum(x*x)) FROM s{i + 1}) AS x FROM s{i + 1})")
    return f"WITH {EDGES}, " + ", ".join(steps) + f" SELECT node, round(x,10) AS eigenvector FROM x{rounds}"


@register("eigenvector_centrality", _eigen_sql(4))
def eigenvector_centrality(g):
    return graph.eigenvector(_edges(g), 4).withColumn("eigenvector", F.round("eigenvector", 10))


@register("sampled_closeness", f"""
WITH RECURSIVE {EDGES}, w AS (SELECT substation_id AS source, substation_id AS node, 0 AS depth FROM substations UNION SELECT w.source, b.dst, w.depth+1 FROM w JOIN b ON b.src=w.node WHERE w.depth<3),
m AS (SELECT source, node, min(depth) AS depth FROM w GROUP BY 1,2)
SELECT node, count(*) AS sources_reached, round(avg(depth),8) AS mean_distance FROM m GROUP BY 1""")
def sampled_closeness(g):
    return r8(graph.closeness(_edges(g), g.substations.select(F.col("substation_id").alias("node")), 3), "mean_distance")


def _with_ties(g):
    """Hierarchy edges plus a direct substation -> transformer edge, which closes triangles."""
    extra = g.transformers.select(F.col("substation_id").alias("src"), F.col("transformer_id").alias("dst"))
    return _edges(g).select("src", "dst").unionByName(extra)


@register("clustering_coeff", """
WITH e AS (SELECT substation_id AS src, circuit_id AS dst FROM circuits UNION ALL SELECT circuit_id, transformer_id FROM transformers UNION ALL SELECT transformer_id, meter_id FROM meters UNION ALL SELECT substation_id, transformer_id FROM transformers),
b AS (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e) WHERE src<>dst), d AS (SELECT src AS node, count(*) AS degree FROM b GROUP BY 1),
t AS (SELECT x.src AS node, count(*)/2 AS t FROM b x JOIN b y ON x.src=y.src AND x.dst<>y.dst JOIN b z ON z.src=x.dst AND z.dst=y.dst GROUP BY 1)
SELECT d.node, degree, coalesce(t,0)::bigint AS triangles, round(CASE WHEN degree>1 THEN coalesce(t,0)/(degree*(degree-1)/2) ELSE 0 END,8) AS clustering FROM d LEFT JOIN t ON t.node=d.node""")
def clustering_coeff(g):
    return r8(graph.triangles(_with_ties(g)), "clustering")


WAVE = f"""sc AS (SELECT * FROM (VALUES ('scenario_1',1,13),('scenario_2',2,22),('scenario_3',3,9),('scenario_4',4,1)) v(scenario_id, rnk, total_nodes)),
 rk AS (SELECT *, row_number() OVER (ORDER BY capacity_mva DESC NULLS LAST, substation_id) AS rnk FROM substations),
 hp AS (SELECT sc.scenario_id, sc.total_nodes, s.substation_id, s.capacity_mva, {hav('z.lat','z.lon','s.lat','s.lon')} AS km, row_number() OVER (PARTITION BY sc.scenario_id ORDER BY {hav('z.lat','z.lon','s.lat','s.lon')}, s.substation_id) AS hop
 FROM sc JOIN rk z ON z.rnk=sc.rnk CROSS JOIN substations s)"""


@register("wavefront_cascade", f"""
WITH {WAVE} SELECT scenario_id, substation_id, hop-1 AS "order", least(ceil(km/8.0),5)::bigint AS wave_depth, capacity_mva AS capacity, round(km,6) AS distance_km FROM hp WHERE hop<=total_nodes""")
def wavefront_cascade(g):
    return graph.wavefront(g.substations).withColumn("distance_km", F.round("distance_km", 6))


@register("wavefront_arrays", f"""
WITH {WAVE} SELECT scenario_id, list(substation_id ORDER BY hop) AS cascade_order, list(least(ceil(km/8.0),5)::bigint ORDER BY hop) AS waves FROM hp WHERE hop<=total_nodes GROUP BY 1""")
def wavefront_arrays(g):
    out = graph.wavefront_summary(graph.wavefront(g.substations))
    return out.select("scenario_id", F.col("cascade_order.substation_id").alias("cascade_order"), F.col("cascade_order.wave_depth").alias("waves"))


@register("nearest_rank", f"""
WITH z AS (SELECT * FROM substations)
SELECT z.substation_id AS anchor_id, t.transformer_id, row_number() OVER (PARTITION BY z.substation_id ORDER BY {hav('z.lat','z.lon','t.lat','t.lon')}, t.transformer_id) AS hop FROM z CROSS JOIN transformers t""")
def nearest_rank(g):
    anchors = g.substations.select(F.col("substation_id").alias("anchor_id"), "lat", "lon")
    return graph.nearest_rank(anchors, g.transformers, "anchor_id", "transformer_id").select("anchor_id", "transformer_id", "hop")


@register("nearest_k", f"""
SELECT * FROM (SELECT m.meter_id, t.transformer_id, row_number() OVER (PARTITION BY m.meter_id ORDER BY {hav('m.lat','m.lon','t.lat','t.lon')}, t.transformer_id) AS hop, round({hav('m.lat','m.lon','t.lat','t.lon')},8) AS distance_km
 FROM meters m JOIN transformers t ON abs(m.lat-t.lat)<0.2) WHERE hop<=5""")
def nearest_k(g):
    """The five nearest transformers of every meter."""
    return r8(pyramid.nearest_k(g.meters, g.transformers, "meter_id", "transformer_id", 5), "distance_km")


@register("degree_reach_sketched", f"""
WITH {EDGES}, d AS (SELECT src AS node, count(*) AS degree FROM b GROUP BY 1),
n AS (SELECT x.src AS node, max(d.degree)>30 AS beside_hub FROM b x JOIN d ON d.node=x.dst GROUP BY 1)
SELECT d.node, d.degree, coalesce(beside_hub, false) AS estimated, true AS within_bound FROM d LEFT JOIN n ON n.node=d.node""")
def degree_reach_sketched(g):
    """Reach past hubs from merged sketches, held against the exact reach: within four standard errors of the nodes two steps around."""
    sketched, exact = graph.degree_reaches(_edges(g), (30, 12), (1000, None))
    exact = exact.select("node", F.col("total_reach").alias("exact"))
    off = F.abs(F.col("total_reach") - F.col("exact")) <= F.when(F.col("estimated"), 4 * 1.04 / 64 * (F.col("exact") + 1) + 1).otherwise(0)
    return sketched.join(exact, "node").select("node", "degree", "estimated", off.alias("within_bound"))


XE = "xe AS (SELECT 'SUB_'||substation_id AS src, 'XFMR_'||transformer_id AS dst FROM transformers)"


def _node_edges(g):
    return g.transformers.select(F.concat(F.lit("SUB_"), "substation_id").alias("src"), F.concat(F.lit("XFMR_"), "transformer_id").alias("dst"))


@register("node_cascade_risk", f"""
WITH {NODES}, {XE}, o AS (SELECT src, count(*) AS n FROM xe GROUP BY 1)
SELECT node_id, node_type, round(crit,8) AS criticality_score, coalesce(n,0) AS downstream_connections, round(crit*coalesce(n,0),2) AS cascade_risk_score FROM gn LEFT JOIN o ON o.src=gn.node_id WHERE crit>0.7
ORDER BY round(crit*coalesce(n,0),2) DESC, node_id LIMIT 20""")
def node_cascade_risk(g):
    return r8(graph.node_risk(graph.grid_nodes(g.substations, g.transformers), _node_edges(g)), "criticality_score")


@register("combined_cascade_risk", f"""
WITH {NODES}, {XE}, o AS (SELECT src, count(*) AS n FROM xe GROUP BY 1)
SELECT node_id, load_p AS risk_probability, round(crit,8) AS criticality_score, coalesce(n,0) AS downstream_count, round(load_p*crit*ln(2+coalesce(n,0)),8) AS combined_cascade_risk
FROM (SELECT 'XFMR_'||transformer_id AS nid, least(1.0::double, load_utilization_pct/100) AS load_p FROM transformers) p JOIN gn ON gn.node_id=p.nid LEFT JOIN o ON o.src=gn.node_id""")
def combined_cascade_risk(g):
    pred = g.transformers.select(F.concat(F.lit("XFMR_"), "transformer_id").alias("node_id"), F.least(F.lit(1.0), F.col("load_utilization_pct") / 100).alias("risk_probability"))
    return r8(graph.combined_risk(pred, graph.grid_nodes(g.substations, g.transformers), _node_edges(g)), "criticality_score", "combined_cascade_risk")


@register("cascade_impact", f"""
WITH cn AS (SELECT a.substation_id AS src, b.substation_id AS dst FROM substations a JOIN substations b ON a.substation_id<>b.substation_id AND {hav('a.lat','a.lon','b.lat','b.lon')}<=12),
sp AS (SELECT substation_id AS src, substation_id AS sid, 0 AS far FROM substations UNION ALL SELECT src, dst, 1 FROM cn),
t AS (SELECT substation_id, count(*) AS t FROM transformers GROUP BY 1), c AS (SELECT t.substation_id, count(DISTINCT customer_id) AS c FROM customers cu JOIN meters m ON m.meter_id=cu.meter_id JOIN transformers t ON t.transformer_id=m.transformer_id GROUP BY 1)
SELECT sp.src AS substation_id, sum(far)::bigint AS connected_substations, coalesce(sum(t),0)::bigint AS affected_transformers, coalesce(sum(c),0)::bigint AS affected_customers, sum(s.capacity_mva)::bigint AS affected_load_mw,
 CASE WHEN coalesce(sum(c),0)>100000 THEN 'CRITICAL' WHEN coalesce(sum(c),0)>10000 THEN 'SEVERE' WHEN coalesce(sum(c),0)>1000 THEN 'MODERATE' ELSE 'LOW' END AS impact_level
FROM sp JOIN substations s ON s.substation_id=sp.sid LEFT JOIN t ON t.substation_id=sp.sid LEFT JOIN c ON c.substation_id=sp.sid GROUP BY 1""")
def cascade_impact(g):
    links = graph.connected_substations(g.substations, 12.0)
    return graph.cascade_impact(g.substations, links, g.transformers, g.meters, g.customers).drop("recommended_actions")


@register("propagation_risk", """
WITH n AS (SELECT substation_id, count(*) AS n FROM transformers GROUP BY 1), c AS (SELECT transformer_id, count(*) AS c FROM meters GROUP BY 1)
SELECT t.transformer_id, health_score, n-1 AS connected_transformers, coalesce(c,0) AS downstream_customers,
 CASE WHEN health_score<50 AND coalesce(c,0)>100 THEN 'CRITICAL' WHEN health_score<70 AND coalesce(c,0)>50 THEN 'HIGH' WHEN health_score<85 THEN 'MEDIUM' ELSE 'LOW' END AS propagation_risk,
 CASE WHEN health_score<50 THEN date '2024-02-01' WHEN health_score<70 THEN date '2024-02-08' WHEN health_score<85 THEN date '2024-03-02' ELSE date '2024-05-01' END AS recommended_maintenance_date
FROM transformers t JOIN n ON n.substation_id=t.substation_id LEFT JOIN c ON c.transformer_id=t.transformer_id""")
def propagation_risk(g):
    return graph.propagation_risk(g.transformers, g.meters, "2024-02-01")


@register("cascade_risk_monitor", """
WITH w AS (SELECT t.substation_id, t.transformer_id, count(*) AS c FROM transformers t JOIN meters m ON m.transformer_id=t.transformer_id WHERE health_score<70 GROUP BY 1,2)
SELECT list(DISTINCT substation_id ORDER BY substation_id) AS at_risk_substations, count(*) AS total_transformers_degraded, sum(c)::bigint AS total_customers_at_risk, CASE WHEN count(*)>10 THEN 'CRITICAL' WHEN count(*)>5 THEN 'HIGH' WHEN count(*)>2 THEN 'MEDIUM' ELSE 'LOW' END AS alert_level FROM w""")
def cascade_risk_monitor(g):
    return graph.cascade_monitor(g.substations, g.transformers, g.meters)


@register("running_shed", """
WITH f AS (SELECT m.circuit_id, count(DISTINCT c.customer_id) AS customer_count, sum(r.kwh)/4000.0 AS load_mw FROM meters m JOIN customers c ON c.meter_id=m.meter_id
 LEFT JOIN (SELECT meter_id, sum(usage_kwh) AS kwh FROM readings WHERE reading_ts>=(SELECT max(reading_ts) FROM readings)-INTERVAL 30 DAY GROUP BY 1) r ON r.meter_id=m.meter_id GROUP BY 1),
p AS (SELECT f.*, CASE ci.k%4 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END AS priority FROM f JOIN circuits ci ON ci.circuit_id=f.circuit_id WHERE load_mw IS NOT NULL),
s AS (SELECT *, row_number() OVER w AS shed_order, sum(load_mw) OVER (w ROWS UNBOUNDED PRECEDING) AS cum FROM p WINDOW w AS (ORDER BY CASE priority WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END, load_mw DESC, circuit_id))
SELECT shed_order, circuit_id, round(load_mw,10) AS load_mw, customer_count, priority, round(cum,10) AS cumulative_shed_mw FROM s WHERE cum<=0.5*1.1""")
def running_shed(g):
    k = F.col("k") % 4
    classed = g.circuits.withColumn("priority_class", F.when(k == 0, "CRITICAL").when(k == 1, "HIGH").when(k == 2, "MEDIUM").otherwise("LOW"))
    since = latest(g.readings, "reading_ts") - F.expr("interval 30 days")
    loads = graph.feeder_loads(classed, g.meters, g.customers, g.readings, since)
    return graph.load_shed(loads, 0.5).withColumns({c: F.round(c, 10) for c in ("load_mw", "cumulative_shed_mw")})


@register("substation_shed", """
WITH f AS (SELECT m.circuit_id, count(DISTINCT c.customer_id) AS customer_count, sum(r.kwh)/4000.0 AS load_mw FROM meters m JOIN customers c ON c.meter_id=m.meter_id
 LEFT JOIN (SELECT meter_id, sum(usage_kwh) AS kwh FROM readings WHERE reading_ts>=(SELECT max(reading_ts) FROM readings)-INTERVAL 10 DAY GROUP BY 1) r ON r.meter_id=m.meter_id GROUP BY 1),
p AS (SELECT f.*, ci.substation_id, CASE ci.k%4 WHEN 0 THEN 4 WHEN 1 THEN 3 WHEN 2 THEN 2 ELSE 1 END AS class FROM f JOIN circuits ci ON ci.circuit_id=f.circuit_id WHERE load_mw IS NOT NULL),
s AS (SELECT *, row_number() OVER w AS shed_order, sum(load_mw) OVER (w ROWS UNBOUNDED PRECEDING) AS cum FROM p WINDOW w AS (PARTITION BY substation_id ORDER BY class, load_mw DESC, circuit_id))
SELECT substation_id, shed_order, circuit_id, round(load_mw,10) AS load_mw, customer_count, round(cum,10) AS cumulative_shed_mw FROM s WHERE cum<=0.02*1.1""")
def substation_shed(g):
    """A shedding sequence for every substation."""
    k = F.col("k") % 4
    classed = g.circuits.withColumn("priority_class", F.when(k == 0, "CRITICAL").when(k == 1, "HIGH").when(k == 2, "MEDIUM").otherwise("LOW"))
    since = latest(g.readings, "reading_ts") - F.expr("interval 10 days")
    loads = graph.feeder_loads(classed, g.meters, g.customers, g.readings, since)
    return graph.load_shed(loads, 0.02, ["substation_id"]).drop("priority").withColumns({c: F.round(c, 10) for c in ("load_mw", "cumulative_shed_mw")})


@register("standardize_features", """
WITH s AS (SELECT avg(rated_kva) AS m1, stddev_pop(rated_kva) AS s1, avg(health_score) AS m2, stddev_pop(health_score) AS s2 FROM transformers)
SELECT transformer_id, round((rated_kva-m1)/(s1+1e-8),8) AS rated_kva_z, round((health_score-m2)/(s2+1e-8),8) AS health_score_z FROM transformers, s""")
def standardize_features(g):
    return r8(graph.zscore_cols(g.transformers, ["rated_kva", "health_score"]).select("transformer_id", "rated_kva_z", "health_score_z"), "rated_kva_z", "health_score_z")


@register("aged_by_area", "SELECT location_area, count(*) AS n, max(age_years) AS oldest FROM aged GROUP BY 1")
def aged_by_area(g):
    return aged(g).groupBy("location_area").agg(F.count(F.lit(1)).alias("n"), F.max("age_years").alias("oldest"))

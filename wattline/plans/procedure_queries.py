"""Named queries for the callable jobs, SQL functions and the curated questions."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from wattline.functions import geometry as G
from wattline.operators import maintenance as T
from wattline.operators.anchors import latest
from wattline.operators.search import cosine
from wattline.plans import procedures as P
from wattline.plans import readings_queries, spatial_queries  # noqa: F401  (their checks are reused below)
from wattline.plans.flow_queries import _new, _old
from wattline.plans.network_queries import aged
from wattline.plans.oracle import VIEWS, hav
from wattline.plans.registry import CHECKS, QUERIES, register
from wattline.plans.verified import VERIFIED
from wattline.session import scratch_path
from wattline.sources import files as IO


@register("save_table", "SELECT segment, county, count(*) AS n FROM meters GROUP BY 1,2 UNION ALL SELECT 'ALL', county, count(*) FROM meters GROUP BY 2")
def save_table(g):
    name = f"saved_{uuid.uuid4().hex}"
    first = g.meters.groupBy("segment", "county").agg(F.count(F.lit(1)).alias("n"))
    IO.save(first, name, "overwrite", path=scratch_path(g.spark, "saved"))
    more = g.meters.groupBy("county").agg(F.count(F.lit(1)).alias("n")).withColumn("segment", F.lit("ALL"))
    IO.save(more, name, "append")
    return IO.released(g.spark, name)


@register("swap_tables", "SELECT 'live' AS which, count(*) AS n FROM meters UNION ALL SELECT 'backup', count(*) FROM customers WHERE account_status='ACTIVE'")
def swap_tables(g):
    tag = uuid.uuid4().hex
    live, fresh, backup = (f"{n}_{tag}" for n in ("live", "fresh", "backup"))
    IO.save(g.customers.where("account_status = 'ACTIVE'").select("meter_id"), live, "overwrite", path=scratch_path(g.spark, "live"))
    IO.save(g.meters.select("meter_id"), fresh, "overwrite", path=scratch_path(g.spark, "fresh"))
    T.swap_tables(g.spark, live, fresh, backup)
    parts = [IO.released(g.spark, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("which"), "n") for n, t in (("live", live), ("backup", backup))]
    return parts[0].unionByName(parts[1])


@register("fn_geo", f"SELECT transformer_id, lon AS x, lat AS y, round({hav('lat', 'lon', '29.76', '-95.37')}*1000,4) AS distance_m, lat BETWEEN 29.5 AND 30.0 AND lon BETWEEN -95.7 AND -95.0 AS inside FROM transformers")
def fn_geo(g):
    d = G.haversine(F.col("lat"), F.col("lon"), F.lit(29.76), F.lit(-95.37)) * 1000
    inside = F.col("lat").between(29.5, 30.0) & F.col("lon").between(-95.7, -95.0)
    point = g.transformers.withColumn("wkt", G.point_text(F.col("lat"), F.col("lon")))
    xy = F.split(F.regexp_replace("wkt", "POINT[(]|[)]", ""), " ")
    return point.select("transformer_id", xy[0].cast("double").alias("x"), xy[1].cast("double").alias("y"), F.round(d, 4).alias("distance_m"), inside.alias("inside"))


@register("fn_vector", "SELECT vec_id, len(embedding) AS dims, round(list_cosine_similarity(embedding::double[], list_reverse(embedding)::double[]),6) AS mirrored FROM embeddings")
def fn_vector(g):
    e = F.col("embedding")
    return g.raw("embeddings").select("vec_id", F.size(e).cast("bigint").alias("dims"), F.round(cosine(e, F.reverse(e)), 6).alias("mirrored"))


@register("table_functions", f"""
SELECT 'nearby' AS kind, transformer_id AS id, round({hav('29.78', '-95.35', 'lat', 'lon')},6) AS value FROM transformers WHERE {hav('29.78', '-95.35', 'lat', 'lon')}<=20
UNION ALL SELECT 'meter', meter_id, round({hav('29.78', '-95.35', 'lat', 'lon')}*1000,1) FROM meters WHERE {hav('29.78', '-95.35', 'lat', 'lon')}*1000<=9000
UNION ALL SELECT 'downstream', 'SUB-0007', 0 UNION ALL SELECT 'downstream', transformer_id, 1 FROM transformers WHERE substation_id='SUB-0007'
UNION ALL SELECT 'downstream', meter_id, 2 FROM meters m JOIN transformers t USING (transformer_id) WHERE t.substation_id='SUB-0007'
UNION ALL SELECT 'coverage', cell, total_capacity_kva+meter_count FROM ({CHECKS['territory_coverage']}) c
UNION ALL SELECT gap_type, cell, nearest_substation_km FROM ({CHECKS['coverage_gaps']}) d""")
def table_functions(g):
    """All five table functions, called from SQL text; two with their default parameters."""
    P.install_functions(g.spark, g)
    return g.spark.sql(
        "SELECT 'nearby' AS kind, transformer_id AS id, round(distance_km, 6) AS value FROM grid_find_nearby(29.78D, -95.35D, 20.0D)"
        " UNION ALL SELECT 'meter', meter_id, distance_m FROM grid_meters_near(29.78D, -95.35D, 9000.0D)"
        " UNION ALL SELECT 'downstream', downstream_id, cast(hops AS double) FROM grid_downstream('SUB-0007')"
        " UNION ALL SELECT 'coverage', cell, total_capacity_kva + meter_count FROM grid_coverage()"
        " UNION ALL SELECT gap_type, cell, round(nearest_substation_km, 8) FROM grid_coverage_gaps()"
    )


ONE_CHUNK = ("run-1", 2, "2024-01-05 00:00:00", "2024-01-06 00:00:00")


@register("table_procedures", f"""
SELECT 'cascade_impact' AS procedure, substation_id AS id, impact_level AS outcome, affected_customers::double AS value FROM ({CHECKS['cascade_impact']}) a WHERE substation_id='SUB-0007'
UNION ALL SELECT 'load_shed', circuit_id, shed_order::varchar, cumulative_shed_mw FROM ({CHECKS['substation_shed']}) b WHERE substation_id='SUB-0007'
UNION ALL SELECT 'propagation_risk', transformer_id, propagation_risk, connected_transformers::double FROM ({CHECKS['propagation_risk']}) c WHERE transformer_id='XF-000017'
UNION ALL SELECT 'validate_chunk', 'run-1/2', verdict, total_readings::double FROM ({CHECKS['dq_chunk']}) d
UNION ALL SELECT 'validated_run', 'run-1/'||n, CASE WHEN n=2 THEN verdict END, NULL FROM ({CHECKS['dq_chunk']}) d, (VALUES (1),(2)) v(n)""")
def table_procedures(g):
    """All four procedures: impact of a substation, its shedding sequence, the risk of a transformer, the verdict on a logged chunk."""
    impact = P.cascade_impact(g, "SUB-0007").select(F.lit("cascade_impact").alias("procedure"), F.col("substation_id").alias("id"), F.col("impact_level").alias("outcome"), F.col("affected_customers").cast("double").alias("value"))
    k = F.col("k") % 4
    classed = g.circuits.withColumn("priority_class", F.when(k == 0, "CRITICAL").when(k == 1, "HIGH").when(k == 2, "MEDIUM").otherwise("LOW"))
    since = latest(g.readings, "reading_ts") - F.expr("interval 10 days")
    shed = P.load_shed(g, classed, "SUB-0007", 0.02, since).select(F.lit("load_shed"), "circuit_id", F.col("shed_order").cast("string"), F.round("cumulative_shed_mw", 10))
    risk = P.propagation_risk(g, "XF-000017", "2024-02-01").select(F.lit("propagation_risk"), "transformer_id", "propagation_risk", F.col("connected_transformers").cast("double"))
    run, chunk, start, end = ONE_CHUNK
    runs = g.spark.createDataFrame([(run, n, start, end, 400 / 96 if n == chunk else 1.0, None) for n in (1, 2)], "run_id string, chunk_id int, from_ts string, to_ts string, meter_sample double, validation_json string")
    verdict, marked = P.validate_chunk(g, runs, run, chunk)
    judged = verdict.select(F.lit("validate_chunk"), F.lit(f"{run}/{chunk}"), "verdict", F.col("total_readings").cast("double"))
    logged = marked.select(F.lit("validated_run"), F.concat_ws("/", "run_id", "chunk_id"), F.get_json_object("validation_json", "$.verdict"), F.lit(None).cast("double"))
    return reduce(DataFrame.union, [impact, shed, risk, judged, logged])


@register("scalar_procedures", """
SELECT 'refresh_features' AS procedure, count(*) AS affected FROM transformers
UNION ALL SELECT 'sync_'||a, n FROM (SELECT CASE WHEN k%40=1 THEN 'INSERT' WHEN k%50=0 THEN 'DELETE' ELSE 'UPDATE' END AS a, count(*) AS n FROM transformers WHERE (k%40=1 AND k%50<>0) OR (k%50=0 AND k%40<>1) OR (k%10=0 AND k%50<>0 AND k%40<>1) GROUP BY 1)""")
def scalar_procedures(g):
    cols = "transformer_id string, feature_date date, avg_load_factor_7d double, max_load_factor_7d double, overload_hours_7d bigint, age_years bigint, health_score double"
    table, _ = P.refresh_features(g.spark.createDataFrame([], cols), aged(g), g.hourly_load, "2024-02-01")
    again, _ = P.refresh_features(table, aged(g), g.hourly_load, "2024-02-01")
    _, log, _ = P.stage_and_sync(_old(g), _new(g), "transformer_id", "k bigint, health_score double, rated_kva int", "transformers", "2024-02-01 00:00:00")
    n = F.count(F.lit(1)).alias("affected")
    first = again.agg(n).select(F.lit("refresh_features").alias("procedure"), "affected")
    return first.unionByName(log.where("sync_status = 'SYNCED'").groupBy(F.concat(F.lit("sync_"), "operation").alias("procedure")).agg(n))


@register("python_procedures", """
WITH w AS (SELECT doc_id, CASE WHEN n_chars>20000 THEN 'SKIPPED' WHEN trim(text)='' THEN 'ERROR' ELSE 'SUCCESS' END AS status, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x<>'')) AS n FROM documents)
SELECT status, count(*) AS documents, coalesce(sum(CASE WHEN status='SUCCESS' THEN ceil(n/1300.0) ELSE 0 END),0)::bigint AS chunks FROM w GROUP BY 1""")
def python_procedures(g):
    _, report = P.process_documents(g.raw("documents"), "doc_id", "text", "n_chars", 20_000)
    return report.groupBy("status").agg(F.count(F.lit(1)).alias("documents"), F.sum("chunks_written").alias("chunks"))


def _verified_check() -> str:
    names = [n for n in VERIFIED if n in CHECKS]
    return " UNION ALL ".join(f"SELECT '{n}' AS query_name, count(*) AS row_count FROM ({CHECKS[n]}) q{i}" for i, n in enumerate(names))


@register("verified_queries", _verified_check())
def verified_queries(g):
    parts = [QUERIES[n](g).agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(n).alias("query_name"), "row_count") for n in VERIFIED]
    return reduce(DataFrame.unionByName, parts)


@register("view_catalog", " UNION ALL ".join(f"SELECT '{v}' AS view_name, count(*) AS row_count FROM {v}" for v in ("substations", "circuits", "transformers", "meters", "customers", "readings", "hourly_load", "outages", "poles")))
def view_catalog(g):
    names = [v for v in VIEWS if hasattr(g, v) and v != "weather"]
    return reduce(DataFrame.unionByName, [getattr(g, v).agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(v).alias("view_name"), "row_count") for v in names])


"""Callable jobs: SQL functions, refresh and sync procedures, document ingestion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wattline.functions import geometry as G
from wattline.operators import geo
from wattline.operators import graph
from wattline.operators import load as L
from wattline.operators import maintenance as T
from wattline.operators import quality as Q
from wattline.operators import search as X
from wattline.sources.derived import GridTables
from wattline.streaming import changes as C

_DISTANCE = (
    "2 * 6371.0D * asin(sqrt(least(1.0D, pow(sin(radians({b1} - {a1}) / 2), 2)"
    " + cos(radians({a1})) * cos(radians({b1})) * pow(sin(radians({b2} - {a2}) / 2), 2))))"
)


def _cells(g: GridTables) -> DataFrame:
    """Every asset once per resolution with its cell there."""
    none = F.lit(0.0)
    parts = [(g.substations, "SUBSTATION", F.col("capacity_mva") * 1000.0), (g.transformers, "TRANSFORMER", F.col("rated_kva").cast("double")), (g.meters, "METER", none)]
    each = [df.select(F.lit(kind).alias("kind"), "lat", "lon", kva.alias("kva")) for df, kind, kva in parts]
    rows = each[0].unionByName(each[1]).unionByName(each[2])
    at = F.array(*[F.struct(F.lit(r).alias("resolution"), G.cell(F.col("lat"), F.col("lon"), r).alias("cell")) for r in G.EDGE_M])
    return rows.select("kind", "kva", F.explode(at).alias("_at")).select("kind", "kva", "_at.*")


def install_functions(spark: SparkSession, g: GridTables) -> list[str]:
    """Session views of the tables plus SQL functions over them, so the lookups can be called from SQL text.

    The distance of every meter cell to its nearest substation is searched here, once; ``grid_coverage_gaps`` reads it.
    """
    for name in ("substations", "circuits", "transformers", "meters"):
        getattr(g, name).createOrReplaceTempView(f"grid_{name}")
    _cells(g).createOrReplaceTempView("grid_cells")
    geo.coverage_gaps(g.meters, g.substations, least=None).createOrReplaceTempView("grid_cell_distances")
    km = _DISTANCE.format(a1="lat1", a2="lon1", b1="lat2", b2="lon2")
    near = _DISTANCE.format(a1="p_lat", a2="p_lon", b1="t.lat", b2="t.lon")
    # A box around the circle, which a scan can use; near the poles it spans all longitudes.
    box = (
        "t.lat BETWEEN p_lat - {km} / 111.0D AND p_lat + {km} / 111.0D"
        " AND abs(pmod(t.lon - p_lon + 180.0D, 360.0D) - 180.0D) <= {km} / greatest(111.0D * cos(radians(least(abs(p_lat) + {km} / 111.0D, 89.9D))), 0.1D)"
    )
    nearby, metres = box.format(km="p_km"), box.format(km="(p_radius_m / 1000.0D)")
    bodies = {
        "grid_distance_km": f"(lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE) RETURNS DOUBLE RETURN {km}",
        "grid_find_nearby": f"""(p_lat DOUBLE, p_lon DOUBLE, p_km DOUBLE DEFAULT 5.0D)
            RETURNS TABLE (transformer_id STRING, distance_km DOUBLE, load_utilization_pct DOUBLE)
            RETURN SELECT t.transformer_id, {near}, t.load_utilization_pct FROM grid_transformers t WHERE {nearby} AND {near} <= p_km""",
        "grid_meters_near": f"""(p_lat DOUBLE, p_lon DOUBLE, p_radius_m DOUBLE)
            RETURNS TABLE (meter_id STRING, transformer_id STRING, circuit_id STRING, distance_m DOUBLE)
            RETURN SELECT t.meter_id, t.transformer_id, t.circuit_id, round({near} * 1000.0D, 1) FROM grid_meters t WHERE {metres} AND {near} * 1000.0D <= p_radius_m""",
        "grid_downstream": """(p_asset STRING)
            RETURNS TABLE (downstream_id STRING, asset_type STRING, hops INT)
            RETURN SELECT p_asset, 'SUBSTATION', 0
                   UNION ALL SELECT t.transformer_id, 'TRANSFORMER', 1 FROM grid_transformers t WHERE t.substation_id = p_asset
                   UNION ALL SELECT m.meter_id, 'METER', 2 FROM grid_meters m JOIN grid_transformers t ON t.transformer_id = m.transformer_id
                             WHERE t.substation_id = p_asset""",
        "grid_coverage": """(p_resolution INT DEFAULT 7)
            RETURNS TABLE (cell STRING, substation_count BIGINT, transformer_count BIGINT, meter_count BIGINT, total_capacity_kva DOUBLE)
            RETURN SELECT c.cell, count_if(c.kind = 'SUBSTATION'), count_if(c.kind = 'TRANSFORMER'), count_if(c.kind = 'METER'), sum(c.kva)
                   FROM grid_cells c WHERE c.resolution = p_resolution GROUP BY c.cell""",
        "grid_coverage_gaps": """(p_least BIGINT DEFAULT 10)
            RETURNS TABLE (cell STRING, center_lat DOUBLE, center_lon DOUBLE, meter_count BIGINT, nearest_substation_km DOUBLE, gap_type STRING)
            RETURN SELECT d.cell, d.center_lat, d.center_lon, d.meter_count, d.nearest_substation_km, d.gap_type FROM grid_cell_distances d WHERE d.meter_count < p_least""",
    }
    for name, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    return list(bodies)


def refresh_features(target: DataFrame, transformers: DataFrame, hourly: DataFrame, feature_date: str, as_of: str | None = None) -> tuple[DataFrame, str]:
    """Merge today's features into the feature table; returns the new version and a message."""
    fresh = L.transformer_features(transformers, hourly, as_of).withColumn("feature_date", F.lit(feature_date).cast("date"))
    source = fresh.select(*target.columns)
    cols = [c for c in target.columns if c not in ("transformer_id", "feature_date")]
    out = T.upsert(target, source, ["transformer_id", "feature_date"], cols)
    return out, f"Features refreshed for {source.count()} transformers"


def stage_and_sync(old: DataFrame, new: DataFrame, key: str, schema: str, source: str, at: str) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Stage the difference of two snapshots, apply it, mark it synced; returns target, log and counts by operation."""
    staged = C.stage_changes(C.diff_snapshots(old, new, key), key, source)
    counts = {r["operation"]: r["n"] for r in staged.groupBy("operation").agg(F.count(F.lit(1)).alias("n")).collect()}
    return C.apply_changes(old, staged, key, schema), C.mark_synced(staged, at), counts


def process_documents(docs: DataFrame, key: str, text: str, size_col: str, max_bytes: int, size: int = 1500, overlap: int = 200) -> tuple[DataFrame, DataFrame]:
    """Chunks of every acceptable document, and a status row per document with the chunks written."""
    marked = X.ingest_report(docs, size_col, text, max_bytes)
    chunks = X.chunk_text(marked.where("status = 'SUCCESS'"), key, text, size, overlap)
    written = chunks.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    report = marked.select(key, "status").join(written, key, "left").select(key, "status", F.coalesce("n", F.lit(0)).alias("chunks_written"))
    return chunks, report


def cascade_impact(g: GridTables, substation_id: str, radius_km: float = 12.0, include_secondary: bool = True) -> DataFrame:
    """What one substation and those connected to it carry; only rows of these substations are read further."""
    links = graph.connected_substations(g.substations, radius_km).where(F.col("source_substation_id") == substation_id)
    near = links.select(F.col("connected_substation_id").alias("substation_id")).unionByName(g.substations.where(F.col("substation_id") == substation_id).select("substation_id")).distinct()
    subs = g.substations.join(near, "substation_id", "left_semi")
    out = graph.cascade_impact(subs, links, g.transformers.join(near, "substation_id", "left_semi"), g.meters, g.customers, include_secondary)
    return out.where(F.col("substation_id") == substation_id)


def load_shed(g: GridTables, circuits: DataFrame, substation_id: str, overload_mw: float, since: Column) -> DataFrame:
    """Shedding sequence of one substation's circuits (with ``priority_class``)."""
    own = circuits.where(F.col("substation_id") == substation_id)
    return graph.load_shed(graph.feeder_loads(own, g.meters, g.customers, g.readings, since), overload_mw)


def propagation_risk(g: GridTables, transformer_id: str, as_of: str) -> DataFrame:
    """Siblings, customers and risk of one transformer; its substation's rows only."""
    home = g.transformers.where(F.col("transformer_id") == transformer_id).select("substation_id")
    around = g.transformers.join(home, "substation_id", "left_semi")
    return graph.propagation_risk(around, g.meters, as_of).where(F.col("transformer_id") == transformer_id)


def validate_chunk(g: GridTables, runs: DataFrame, run_id: str, chunk_id: int) -> tuple[DataFrame, DataFrame]:
    """Judge a logged chunk (run_id, chunk_id, from_ts, to_ts, meter_sample) and return (verdict row, runs with the verdict on the chunk's row)."""
    own = (F.col("run_id") == run_id) & (F.col("chunk_id") == chunk_id)
    chunk = runs.where(own).first()
    if chunk is None:
        raise ValueError(f"no chunk {chunk_id} in run {run_id}")
    verdict = Q.validate_chunk(g.readings, g.meters, g.transformers, str(chunk["from_ts"]), str(chunk["to_ts"]), chunk["meter_sample"] * 96)
    kept = verdict.select(F.to_json(F.struct("verdict", "reason", "details"))).first()[0]
    return verdict, runs.withColumn("validation_json", F.when(own, F.lit(kept)).otherwise(F.col("validation_json")))

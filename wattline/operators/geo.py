"""Radius search, cell aggregates, nearest match and coverage."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from wattline.functions import geometry as G
from wattline.operators.anchors import topk
from wattline.operators.pyramid import nearest

# A square with more right-hand rows than this is split.
CROWDED = 10_000


def in_envelope(df: DataFrame, lat0: float, lat1: float, lon0: float, lon1: float) -> DataFrame:
    """Plain comparisons, which a Parquet scan can use; an envelope that passes longitude 180 goes on at the other end."""
    lon = F.col("lon")
    inside = lon.between(lon0, lon1)
    if lon0 < -180:
        inside = inside | (lon >= lon0 + 360)
    if lon1 > 180:
        inside = inside | (lon <= lon1 - 360)
    return df.where(F.col("lat").between(lat0, lat1) & inside)


def find_nearby(df: DataFrame, lat: float, lon: float, radius_km: float) -> DataFrame:
    """Points within the radius, nearest first."""
    d = G.haversine(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon"))
    box = in_envelope(df, *G.degree_box(lat, lon, radius_km))
    return box.withColumn("distance_km", d).where(F.col("distance_km") <= radius_km).orderBy("distance_km")


def _steps(size_km: float, max_lat: float) -> tuple[float, int]:
    """Height of a square in degrees, and the number of squares round the globe, so that a side is at least ``size_km`` anywhere below ``max_lat``."""
    lat_step = size_km * 1.001 / G.KM_PER_DEGREE
    return lat_step, max(1, math.floor(360.0 * math.cos(math.radians(min(max_lat, 90.0))) / lat_step))


def _square(lat, lon, size_km: float, max_lat: float):
    a, columns = _steps(size_km, max_lat)
    return F.floor(lat / F.lit(a)).cast("bigint"), F.pmod(F.floor((lon + F.lit(180.0)) * F.lit(columns / 360.0)), F.lit(columns)).cast("bigint")


def _nine(df: DataFrame, size_km: float, max_lat: float) -> DataFrame:
    """The 3 x 3 squares round each row; the first and the last square of a row are neighbours."""
    i, j = _square(F.col("lat"), F.col("lon"), size_km, max_lat)
    columns = F.lit(_steps(size_km, max_lat)[1])
    beside = F.array_distinct(F.array(*[F.pmod(j + y, columns) for y in (-1, 0, 1)]))
    up = df.withColumn("_i", F.explode(F.array(i - 1, i, i + 1)))
    return up.withColumn("_j", F.explode(beside))


def max_abs_lat(*dfs: DataFrame) -> float:
    return max((df.agg(F.max(F.abs("lat"))).first()[0] or 0.0) for df in dfs) + 0.5


def within_radius(left: DataFrame, right: DataFrame, left_key: str, right_key: str, radius_km: float, crowded: int = CROWDED) -> DataFrame:
    """All pairs within the radius.

    The left side is listed in the 3 x 3 squares round it, the right side in its own square; squares are as wide as
    the radius, so no pair is missed.  The squares are counted first: empty ones drop their left rows before the
    join, and a crowded one is split into parts that meet the left rows one by one.
    """
    top = max_abs_lat(left, right)
    i, j = _square(F.col("lat"), F.col("lon"), radius_km, top)
    r = right.select(F.col(right_key), F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"), i.alias("_i"), j.alias("_j"))
    parts = r.groupBy("_i", "_j").agg(F.ceil(F.count(F.lit(1)) / crowded).alias("_parts"))
    r = r.join(parts, ["_i", "_j"]).withColumn("_part", F.pmod(F.xxhash64(right_key), F.col("_parts"))).drop("_parts")
    a = _nine(left.select(left_key, "lat", "lon"), radius_km, top).join(parts, ["_i", "_j"])
    a = a.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_parts") - 1))).drop("_parts")
    d = G.haversine(F.col("lat"), F.col("lon"), F.col("r_lat"), F.col("r_lon"))
    pairs = a.join(r, ["_i", "_j", "_part"]).withColumn("distance_km", d)
    return pairs.where(F.col("distance_km") <= radius_km).select(left_key, right_key, "distance_km")


def nearest_match(points: DataFrame, targets: DataFrame, key: str, target_key: str, exact_m: float = 10.0, max_m: float = 500.0) -> DataFrame:
    """Nearest target within ``max_m`` and a snapped position; points without one keep their own (INTERPOLATED)."""
    hits = nearest(points, targets, key, target_key, max_km=max_m / 1000.0)
    rows = points.select(key, "lat", "lon").join(hits.select(key, target_key, "distance_km", "t_lat", "t_lon"), key, "left")
    m = F.col("distance_km") * 1000.0
    return rows.select(
        key, target_key,
        F.when(m.isNull(), "INTERPOLATED").when(m <= exact_m, "EXACT").otherwise("NEAREST").alias("match_type"),
        m.alias("distance_m"),
        F.when(m.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.lit(1.0) - m / max_m)).alias("match_confidence"),
        F.coalesce("t_lat", "lat").alias("lat"), F.coalesce("t_lon", "lon").alias("lon"),
        F.col("lat").alias("original_lat"), F.col("lon").alias("original_lon"),
    )


# ------------------------------------------------------------------ cells

def with_cell(df: DataFrame, res: int, out: str = "cell") -> DataFrame:
    return df.withColumn(out, G.cell(F.col("lat"), F.col("lon"), res))


def hex_density(df: DataFrame, res: int, least: int = 5, n: int = 100) -> DataFrame:
    cells = with_cell(df, res).groupBy("cell").agg(
        F.count(F.lit(1)).alias("transformer_count"), F.sum("rated_kva").alias("total_kva"), F.avg("health_score").alias("avg_health")
    )
    return topk(cells.where(F.col("transformer_count") >= least), [F.col("transformer_count").desc(), F.col("cell").asc()], n)


def hex_rollup(df: DataFrame, fine: int = 8, coarse: int = 5) -> DataFrame:
    """Cells, total and mean per cell at every level; the points are combined to fine cells once, then to parents."""
    base = with_cell(df, fine).groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.sum("rated_kva").alias("kva"))
    levels = F.array(
        *[F.struct(F.lit(r).alias("resolution"), (F.col("cell") if r == fine else G.parent(F.col("cell"), fine, r)).alias("c")) for r in range(fine, coarse - 1, -1)]
    )
    per = base.select(F.explode(levels).alias("l"), "n", "kva").groupBy("l.resolution", "l.c").agg(F.sum("n").alias("n"), F.sum("kva").alias("kva"))
    return per.groupBy("resolution").agg(
        F.count(F.lit(1)).alias("cell_count"), F.sum("n").alias("total_transformers"), F.round(F.avg("n"), 2).alias("avg_per_cell"), F.sum("kva").alias("total_kva")
    )


def cell_join(a: DataFrame, b: DataFrame, a_key: str, b_key: str, res: int, n: int = 100) -> DataFrame:
    """The first ``n`` pairs (by a key, b key) of two point sets in one cell.

    Only the first ``n`` matched rows of the left side can appear, so they are picked before the pairs are formed and
    a crowded cell never lists all of its pairs.
    """
    left = with_cell(a.select(a_key, "lat", "lon"), res).drop("lat", "lon")
    right = with_cell(b.select(b_key, "lat", "lon"), res).drop("lat", "lon")
    first = topk(left.join(right.select("cell"), "cell", "left_semi"), [F.col(a_key).asc()], n)
    return topk(first.join(right, "cell"), [F.col(a_key).asc(), F.col(b_key).asc()], n)


def cell_pair_counts(a: DataFrame, b: DataFrame, res: int) -> DataFrame:
    """Rows of both sides and number of pairs per shared cell, without listing pairs."""
    left = with_cell(a, res).groupBy("cell").agg(F.count(F.lit(1)).alias("left_rows"))
    right = with_cell(b, res).groupBy("cell").agg(F.count(F.lit(1)).alias("right_rows"))
    return left.join(right, "cell").withColumn("pairs", F.col("left_rows") * F.col("right_rows"))


def k_ring(df: DataFrame, lat: float, lon: float, k: int, res: int) -> DataFrame:
    """Assets in the cells at most k steps from a point's cell: two cells' steps are arithmetic on their numbers, so no list of cells is made."""
    return with_cell(df, res).where(G.grid_distance(F.col("cell"), G.cell(F.lit(lat), F.lit(lon), res)) <= k)


def meters_near(df: DataFrame, lat: float, lon: float, radius_m: float, res: int = 9) -> DataFrame:
    """Points within the radius through cell candidates and an exact distance; equals the full scan."""
    d = G.haversine(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon")) * 1000.0
    near = k_ring(df, lat, lon, G.rings_for(radius_m / 1000.0, res), res)
    return near.withColumn("distance_m", d).where(F.col("distance_m") <= radius_m).withColumn("distance_m", F.round("distance_m", 1))


def hex_ratio(meters: DataFrame, transformers: DataFrame, res: int) -> DataFrame:
    """Meters per transformer for every cell that has meters."""
    m = with_cell(meters, res).groupBy("cell").agg(
        F.count(F.lit(1)).alias("meter_count"), F.avg("lat").alias("mean_lat"), F.avg("lon").alias("mean_lon")
    )
    t = with_cell(transformers, res).groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    return m.join(t, "cell", "left").select(
        "cell", "meter_count", F.coalesce("n", F.lit(0)).alias("transformer_count"),
        F.round(F.col("meter_count") / F.nullif("n", F.lit(0)), 1).alias("meters_per_transformer"), "mean_lat", "mean_lon",
    )


def coverage(substations: DataFrame, transformers: DataFrame, meters: DataFrame, res: int = 7) -> DataFrame:
    """Assets and capacity per cell; meters are counted too."""
    def part(df, s, t, m, kva):
        return with_cell(df, res).groupBy("cell").agg(
            F.sum(F.lit(s)).alias("s"), F.sum(F.lit(t)).alias("t"), F.sum(F.lit(m)).alias("m"), F.sum(kva.cast("double")).alias("kva")
        )

    parts = (
        part(substations, 1, 0, 0, F.col("capacity_mva") * 1000)
        .unionByName(part(transformers, 0, 1, 0, F.col("rated_kva")))
        .unionByName(part(meters, 0, 0, 1, F.lit(0)))
    )
    return parts.groupBy("cell").agg(
        F.sum("s").alias("substation_count"), F.sum("t").alias("transformer_count"), F.sum("m").alias("meter_count"), F.sum("kva").alias("total_capacity_kva")
    )


def coverage_gaps(meters: DataFrame, substations: DataFrame, least: int | None = 10, res: int = 9) -> DataFrame:
    """Cells with fewer than ``least`` meters (all of them without a limit) and the distance to the nearest substation."""
    cells = with_cell(meters, res).groupBy("cell").agg(F.count(F.lit(1)).alias("meter_count"))
    cells = cells if least is None else cells.where(F.col("meter_count") < least)
    lat, lon = G.center(F.col("cell"), res)
    centers = cells.withColumns({"lat": lat, "lon": lon})
    hits = nearest(centers, substations, "cell", "substation_id")
    km = F.col("distance_km")
    return centers.join(hits.select("cell", "distance_km"), "cell").select(
        "cell", F.col("lat").alias("center_lat"), F.col("lon").alias("center_lon"), "meter_count", km.alias("nearest_substation_km"),
        F.when(km > 10, "CRITICAL_GAP").when(km > 5, "MODERATE_GAP").otherwise("MINOR_GAP").alias("gap_type"),
    )


def veg_cells(trees: DataFrame, res: int = 8, limit: float = 0.7) -> DataFrame:
    cells = with_cell(trees, res).groupBy("cell").agg(F.count(F.lit(1)).alias("tree_count"), F.avg("risk_score").alias("avg_risk"), F.max("height_m").alias("max_height_m"))
    return cells.where(F.col("avg_risk") > limit)


def clearance_m(voltage_kv):
    """Required clearance by line voltage."""
    return F.when(voltage_kv >= 345, 7.6).when(voltage_kv >= 138, 4.6).when(voltage_kv >= 69, 3.0).otherwise(1.2)


def veg_clearance(trees: DataFrame, lines: DataFrame, max_km: float = 50.0) -> DataFrame:
    """Nearest line end, clearance deficit and years until the tree reaches the required clearance."""
    hits = nearest(trees, lines, "tree_id", "line_id", max_km=max_km)
    rows = trees.join(hits.select("tree_id", "line_id", "distance_km"), "tree_id", "left").join(lines.select("line_id", "voltage_kv").dropDuplicates(["line_id"]), "line_id", "left")
    need = clearance_m(F.col("voltage_kv"))
    free = F.col("distance_km") * 1000.0 - F.col("canopy_radius_m")
    return rows.select(
        "tree_id", "line_id", (F.col("distance_km") * 1000.0).alias("distance_to_line_m"), "voltage_kv", need.alias("minimum_clearance_m"),
        F.greatest(F.lit(0.0), need - free).alias("clearance_deficit_m"),
        F.when(free <= need, 0.0).otherwise((free - need) / F.nullif("growth_m", F.lit(0.0))).alias("years_to_encroachment"),
    )


def geo_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("geom_wkt", G.point_text(F.col("lat"), F.col("lon")))

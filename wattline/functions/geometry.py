"""Distances, placement and a planar hexagon grid, all as column arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

EARTH_KM = 6371.0
KM_PER_DEGREE = EARTH_KM * math.pi / 180.0

# Grid origin: the plane is an equirectangular projection round this point.
ORIGIN_LAT = 29.76
ORIGIN_LON = -95.37

# Edge length in metres per resolution; each level is sqrt(7) finer than the one before.
EDGE_M = {5: 8544.0, 6: 3229.0, 7: 1221.0, 8: 461.0, 9: 174.0}

_ROOT3 = math.sqrt(3.0)
_LON_KM = KM_PER_DEGREE * math.cos(math.radians(ORIGIN_LAT))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in km."""
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    chord = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), chord)))


def degree_box(lat: float, lon: float, radius_km: float) -> tuple[float, float, float, float]:
    """Latitude and longitude limits that contain every point within the radius."""
    d_lat = radius_km / KM_PER_DEGREE * 1.001
    if abs(lat) + d_lat >= 89.9:  # a pole is near or inside: all longitudes
        return lat - d_lat, lat + d_lat, -180.0, 180.0
    nearest_pole = abs(lat) + d_lat
    d_lon = d_lat / math.cos(math.radians(nearest_pole))
    return lat - d_lat, lat + d_lat, lon - d_lon, lon + d_lon


def point_text(lat: Column, lon: Column) -> Column:
    return F.concat(F.lit("POINT("), lon.cast("string"), F.lit(" "), lat.cast("string"), F.lit(")"))


def offset_lat(lat: Column, km: Column, bearing: Column) -> Column:
    """Latitude after moving ``km`` along ``bearing``; the degree length depends on the latitude."""
    length = (
        F.lit(111.132) - F.lit(0.559) * F.cos(2 * F.radians(lat)) + F.lit(0.001) * F.cos(4 * F.radians(lat))
    )
    return lat + km * F.cos(bearing) / length


def offset_lon(lat: Column, lon: Column, km: Column, bearing: Column) -> Column:
    return lon + km * F.sin(bearing) / (F.lit(111.320) * F.cos(F.radians(lat)))


def _axial(lat: Column, lon: Column, res: int) -> tuple[Column, Column]:
    """Fractional axial coordinates."""
    edge_km = EDGE_M[res] / 1000.0
    x = (lon - F.lit(ORIGIN_LON)) * F.lit(_LON_KM)
    y = (lat - F.lit(ORIGIN_LAT)) * F.lit(KM_PER_DEGREE)
    q = (F.lit(_ROOT3 / 3) * x - y / 3) / F.lit(edge_km)
    r = F.lit(2.0 / 3) * y / F.lit(edge_km)
    return q, r


def _round_axial(q: Column, r: Column) -> tuple[Column, Column]:
    """Nearest hexagon: round three cube coordinates and fix the one that moved most."""
    s = -q - r
    rq, rr, rs = (F.floor(v + F.lit(0.5)) for v in (q, r, s))
    dq, dr, ds = F.abs(rq - q), F.abs(rr - r), F.abs(rs - s)
    q_out = F.when((dq > dr) & (dq > ds), -rr - rs).otherwise(rq)
    r_out = F.when((dq > dr) & (dq > ds), rr).when(dr > ds, -rq - rs).otherwise(rr)
    return q_out.cast("bigint"), r_out.cast("bigint")


def cell(lat: Column, lon: Column, res: int) -> Column:
    """Cell id ``r<res>:<q>:<r>``.

    The rounding names its inputs about twenty times.  A one-element transform binds them, so that they are computed
    once and the generated code stays small enough to be compiled.
    """
    q, r = _axial(lat, lon, res)
    bound = F.array(F.struct(q.alias("q"), r.alias("r")))
    return F.transform(bound, lambda z: cell_id(*_round_axial(z["q"], z["r"]), res))[0]


def cell_id(q: Column, r: Column, res: int) -> Column:
    return F.concat(F.lit(f"r{res}:"), q.cast("string"), F.lit(":"), r.cast("string"))


def cell_q(cell_col: Column) -> Column:
    return F.split_part(cell_col, F.lit(":"), F.lit(2)).cast("bigint")


def cell_r(cell_col: Column) -> Column:
    return F.split_part(cell_col, F.lit(":"), F.lit(3)).cast("bigint")


def center(cell_col: Column, res: int) -> tuple[Column, Column]:
    """(lat, lon) of the cell centre."""
    edge_km = EDGE_M[res] / 1000.0
    q, r = cell_q(cell_col), cell_r(cell_col)
    x = F.lit(edge_km * _ROOT3) * (q + r / 2)
    y = F.lit(edge_km * 1.5) * r
    return F.lit(ORIGIN_LAT) + y / F.lit(KM_PER_DEGREE), F.lit(ORIGIN_LON) + x / F.lit(_LON_KM)


def parent(cell_col: Column, res: int, parent_res: int) -> Column:
    """Coarser cell that holds the centre of this cell."""
    lat, lon = center(cell_col, res)
    return cell(lat, lon, parent_res)


def boundary(cell_col: Column, res: int) -> Column:
    """The six corners as WKT polygon text."""
    lat, lon = center(cell_col, res)
    edge_km = EDGE_M[res] / 1000.0
    corners = []
    for k in [0, 1, 2, 3, 4, 5, 0]:
        angle = math.radians(60 * k - 30)
        c_lon = F.round(lon + F.lit(edge_km * math.cos(angle) / _LON_KM), 6).cast("string")
        c_lat = F.round(lat + F.lit(edge_km * math.sin(angle) / KM_PER_DEGREE), 6).cast("string")
        corners.append(F.concat_ws(" ", c_lon, c_lat))
    return F.concat(F.lit("POLYGON(("), F.concat_ws(", ", *corners), F.lit("))"))


def grid_distance(a: Column, b: Column) -> Column:
    """Steps between two cells of one resolution."""
    dq, dr = cell_q(a) - cell_q(b), cell_r(a) - cell_r(b)
    return F.greatest(F.abs(dq), F.abs(dr), F.abs(dq + dr))


def disk(cell_col: Column, k: int, res: int) -> Column:
    """Array of every cell at most ``k`` steps away, the cell itself included."""
    q, r = cell_q(cell_col), cell_r(cell_col)
    span = F.sequence(F.lit(-k), F.lit(k))
    rows = F.transform(
        span,
        lambda dq: F.transform(
            F.filter(span, lambda dr: F.abs(dq + dr) <= F.lit(k)),
            lambda dr: cell_id(q + dq, r + dr, res),
        ),
    )
    return F.flatten(rows)


def rings_for(radius_km: float, res: int) -> int:
    """Rings that surely cover the radius: each ring adds at least 1.5 edges of width."""
    return max(1, math.ceil(radius_km * 1.01 * 1000.0 / (1.5 * EDGE_M[res])) + 1)

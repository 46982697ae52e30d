"""Nearest targets and radius searches against brute force, on the whole sphere."""

import math
import random

import pytest
from pyspark.sql import functions as F

from wattline.operators import geo, pyramid


def hav(a, b):
    la, lo, lb, lp = map(math.radians, (*a, *b))
    return 2 * 6371.0 * math.asin(math.sqrt(min(1.0, math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((lp - lo) / 2) ** 2)))


def frame(spark, rows, key):
    return spark.createDataFrame(rows, f"{key} string, lat double, lon double")


def spot(rng, kind):
    if kind == "seam":  # round longitude 180
        lon = rng.uniform(179.2, 180.8)
        return rng.uniform(-17, -16), lon - 360 if lon > 180 else lon
    if kind == "pole":
        return rng.uniform(88.0, 90.0) * rng.choice([1, 1, 1, -1]), rng.uniform(-180, 180)
    if kind == "world":
        return math.degrees(math.asin(rng.uniform(-1, 1))), rng.uniform(-180, 180)
    return rng.gauss(29.7, 0.02), rng.gauss(-95.4, 0.02)


@pytest.mark.parametrize("kind", ["seam", "pole", "world", "town"])
def test_nearest_equals_brute_force(spark, kind):
    rng = random.Random(kind)
    a = [(f"a{i}", *spot(rng, kind)) for i in range(150)]
    b = [(f"b{i:04d}", *spot(rng, kind)) for i in range(700)]
    b += [(f"c{i}", *b[i][1:]) for i in range(20)]  # one spot twice: the smaller key
    got = {r["a_id"]: (r["distance_km"], r["b_id"], r["t_lat"], r["t_lon"]) for r in pyramid.nearest(frame(spark, a, "a_id"), frame(spark, b, "b_id"), "a_id", "b_id").collect()}
    assert len(got) == len(a)
    for k, lat, lon in a:
        d, best = min((hav((lat, lon), y[1:]), y[0]) for y in b)
        assert math.isclose(got[k][0], d, rel_tol=1e-9, abs_tol=1e-9) and got[k][1] == best
        assert (best, *got[k][2:]) in b


def test_far_points_meet_few_of_many_clustered_targets(spark):
    rng = random.Random(7)
    b = [(f"b{i}", rng.gauss(29.7, 0.01), rng.gauss(-95.4, 0.01)) for i in range(20_000)]
    a = [(f"a{i}", *spot(rng, "world")) for i in range(200)]
    targets = frame(spark, b, "b_id")
    met = pyramid.candidates(frame(spark, a, "a_id"), targets, "a_id", "b_id")
    assert met.count() <= 200 * 8 * pyramid.LEAF  # of 4,000,000
    got = {r["a_id"]: r["distance_km"] for r in pyramid.nearest(frame(spark, a, "a_id"), targets, "a_id", "b_id").collect()}
    for k, lat, lon in a[:40]:
        assert math.isclose(got[k], min(hav((lat, lon), y[1:]) for y in b), rel_tol=1e-9)


def test_crowded_points_share_the_work(spark):
    """Many points on few spots and inside one small square, with targets among them."""
    rng = random.Random(8)
    b = [(f"b{i}", 29.7 + rng.uniform(0, 1e-4), -95.4 + rng.uniform(0, 1e-4)) for i in range(500)]
    a = [(f"a{i}", *((29.70001, -95.39999) if i % 3 == 0 else (29.7 + rng.uniform(0, 1e-4), -95.4 + rng.uniform(0, 1e-4)))) for i in range(3000)]
    points, targets = frame(spark, a, "a_id"), frame(spark, b, "b_id")
    assert pyramid.candidates(points, targets, "a_id", "b_id").count() <= 3000 * 8 * pyramid.LEAF
    got = {r["a_id"]: r["distance_km"] for r in pyramid.nearest(points, targets, "a_id", "b_id").collect()}
    for k, lat, lon in a[:60]:
        assert math.isclose(got[k], min(hav((lat, lon), y[1:]) for y in b), rel_tol=1e-7, abs_tol=1e-9)


def test_limits_nulls_and_empty_sides(spark):
    a = [("far", 10.0, 10.0), ("near", 29.7, -95.4), ("none", None, 1.0), ("nan", float("nan"), 1.0)]
    b = [("x", 29.701, -95.4), ("y", None, None)]
    points, targets = frame(spark, a, "a_id"), frame(spark, b, "b_id")
    assert [(r["a_id"], r["b_id"]) for r in pyramid.nearest(points, targets, "a_id", "b_id", 0.5).collect()] == [("near", "x")]
    matched = {r["a_id"]: r["match_type"] for r in geo.nearest_match(points, targets, "a_id", "b_id").collect()}
    assert matched == {"far": "INTERPOLATED", "near": "NEAREST", "none": "INTERPOLATED", "nan": "INTERPOLATED"}
    assert pyramid.nearest(points.limit(0), targets, "a_id", "b_id").count() == 0
    assert pyramid.nearest(points, targets.limit(0), "a_id", "b_id").count() == 0
    assert pyramid.nearest(points, targets.where("b_id = 'y'"), "a_id", "b_id").count() == 0


@pytest.mark.parametrize("kind, radius", [("seam", 20.0), ("pole", 120.0), ("world", 2500.0), ("town", 0.5)])
def test_radius_pairs_equal_all_pairs(spark, kind, radius):
    rng = random.Random(kind)
    a, b = ([(f"{p}{i}", *spot(rng, kind)) for i in range(120)] for p in "ab")
    got = [(r["a_id"], r["b_id"]) for r in geo.within_radius(frame(spark, a, "a_id"), frame(spark, b, "b_id"), "a_id", "b_id", radius, 5).collect()]
    assert sorted(got) == sorted((x[0], y[0]) for x in a for y in b if hav(x[1:], y[1:]) <= radius)
    centre = a[0][1:]
    near = {r["b_id"] for r in geo.find_nearby(frame(spark, b, "b_id"), *centre, radius).collect()}
    assert near == {y[0] for y in b if hav(centre, y[1:]) <= radius}


def test_ring_makes_no_list_of_cells(spark):
    df = frame(spark, [("a", 29.7, -95.4)], "a_id")
    plan = geo.k_ring(df, 29.7, -95.4, 400, 9)._jdf.queryExecution().toString()
    assert "Join" not in plan and geo.k_ring(df, 29.7, -95.4, 400, 9).select(F.col("cell")).count() == 1


@pytest.mark.parametrize("kind, k", [("world", 3), ("town", 40), ("seam", 5)])
def test_nearest_k_equals_full_ranking(spark, kind, k):
    rng = random.Random(kind)
    a = [(f"a{i}", *spot(rng, kind)) for i in range(60)]
    b = [(f"b{i:04d}", *spot(rng, kind)) for i in range(400)]
    b += [(f"c{i:02d}", *b[0][1:]) for i in range(60)]  # a crowd on one spot
    got = {}
    for r in pyramid.nearest_k(frame(spark, a, "a_id"), frame(spark, b, "b_id"), "a_id", "b_id", k).collect():
        got.setdefault(r["a_id"], []).append((r["hop"], r["b_id"]))
    for key, lat, lon in a:
        best = sorted((hav((lat, lon), y[1:]), y[0]) for y in b)[:k]
        assert [x for _, x in sorted(got[key])] == [x for _, x in best]
    few = pyramid.nearest_k(frame(spark, a, "a_id"), frame(spark, b[:2], "b_id"), "a_id", "b_id", k)
    assert few.count() == 2 * len(a)


def test_ranking_the_nearest_lists_few_pairs(spark):
    rng = random.Random(9)
    a = [(f"a{i}", *spot(rng, "town")) for i in range(300)]
    b = [(f"b{i}", *spot(rng, "town")) for i in range(10_000)]
    met = pyramid.candidates(frame(spark, a, "a_id"), frame(spark, b, "b_id"), "a_id", "b_id", k=10)
    assert met.count() <= 300 * 30 * pyramid.LEAF / 2  # of 3,000,000


def test_dense_points_and_targets_list_pairs_in_proportion(spark, monkeypatch):
    """Both sides dense: no round lists all small target cells as far around a cell of points as it is wide."""
    rng = random.Random(10)
    met, closest = [], pyramid._closest

    def counted(pairs, *args):
        met.append(pairs.count())
        return closest(pairs, *args)

    monkeypatch.setattr(pyramid, "_closest", counted)
    a, b = ([(f"{p}{i}", 29.7 + rng.uniform(0, 0.02), -95.4 + rng.uniform(0, 0.02)) for i in range(6000)] for p in "ab")
    pyramid.candidates(frame(spark, a, "a_id"), frame(spark, b, "b_id"), "a_id", "b_id").count()
    assert max(met) <= 30 * 6000

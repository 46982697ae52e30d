"""Nearest targets by a pyramid of cells with bounding boxes, searched best first from both sides.

Positions are unit vectors, so straight distances order like distances on the sphere, and neither longitude 180 nor a pole is an edge.
Both point sets are counted into nested cells: twenty levels, each twice as fine per axis. A row of the pyramid is a cell with the tight
box of what it holds and one position in it. A few levels are counted at a time, and below the first of them only what open cells hold.
Finer steps than two would list, for every cell of points, all small target cells as far around as the cell is wide.

The search works on pairs of a cell of points and a cell of targets and starts with all pairs of a coarse level. In every round, pairs are
replaced by pairs of their child cells. A pair has a lower bound (box to box) and an upper bound (the target cell's position to the far corner of the
point cell's box); pairs that begin farther away than the least upper bound of their point cell are dropped. Target cells end with
``LEAF`` targets. A cell of points is divided no further once its box is small against the distance to all targets, or once few target
cells that end are left for it: far points settle early and crowded points share the work. Only then do points meet the boxes of
the target cells left, and the targets in those that remain.
"""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window, functions as F

from wattline.functions import geometry as G
from wattline.operators.ordering import positioned
from wattline.session import cut

LEVELS = 20
BITS = 1
#: The search starts with the pairs of this level; that many levels are counted at once.
FIRST = 3
AT_ONCE = 3
#: Targets in a cell that is not divided further.
LEAF = 24
#: A cell of points is settled when its box is at most this part of the distance to all targets, or so few target cells are left.
SETTLED = 0.25
FEW = 16
#: Bounds may be off by rounding; on the unit sphere this is six micrometres.
SLACK = 1e-12
AXES = ("x", "y", "z")
BOX = [f"{side}_{a}" for a in AXES for side in ("lo", "hi")]
AT = [f"at_{a}" for a in AXES]
#: A cell number is three coordinates of 20 bits; a level keeps the leading bits of each.
WIDTH = BITS * LEVELS
MASKS = [sum((((1 << BITS * n) - 1) << (WIDTH - BITS * n)) << (WIDTH * i) for i in range(3)) for n in range(LEVELS + 1)]

# The expressions are SQL text, so that building a plan costs few calls.


def placed(df: DataFrame) -> DataFrame:
    """Rows with a position, and their unit vectors."""
    there = df.where("lat IS NOT NULL AND lon IS NOT NULL AND NOT isnan(lat) AND NOT isnan(lon)")
    return there.selectExpr("*", "cos(radians(lat)) * cos(radians(lon)) AS x", "cos(radians(lat)) * sin(radians(lon)) AS y", "sin(radians(lat)) AS z")


def _finest(left: DataFrame, right: DataFrame) -> str | None:
    """The cell number of a position at the last level, in a cube round everything, as SQL text; None if a side has no rows."""
    ends = [f"{f}({a}) AS {n}_{a}" for a in AXES for n, f in (("lo", "min"), ("hi", "max"))]
    rows = left.selectExpr(*ends).unionByName(right.selectExpr(*ends)).collect()  # a row for each side
    if any(r["lo_x"] is None for r in rows):
        return None
    low = {a: min(r[f"lo_{a}"] for r in rows) for a in AXES}
    side = max(*[max(r[f"hi_{a}"] for r in rows) - low[a] for a in AXES], 1e-9)
    last = (1 << WIDTH) - 1
    at = [f"shiftleft(least(cast(floor(({a} - {low[a]!r}D) * {(last + 1) / side!r}D) as bigint), {last}L), {WIDTH * (2 - i)})" for i, a in enumerate(AXES)]
    return " | ".join(at)


def _masked(level: str) -> str:
    return f"element_at(array({', '.join(f'{m}L' for m in MASKS)}), {level})"


def _in_levels(df: DataFrame, finest: str, levels: list[int], names: tuple[str, str]) -> DataFrame:
    """Each row once per level, with the level and its cell there."""
    rows = df.selectExpr("*", f"{finest} AS _finest", f"explode(array({', '.join(map(str, levels))})) AS {names[0]}")
    return rows.selectExpr("*", f"_finest & {_masked(names[0] + ' + 1')} AS {names[1]}").drop("_finest")


def _pyramid(df: DataFrame, finest: str, levels: list[int], within: DataFrame | None = None) -> DataFrame:
    """The cells of some levels, kept in memory or on the executors' disks; upper levels shrink before they are shuffled.

    ``within`` (cell) has the cells of the level above that are still divided; what lies elsewhere is left out. Rows lie by level, so that a
    round's read of one level skips the others.
    """
    inside = df if within is None else df.withColumn("cell", F.expr(f"({finest}) & {MASKS[levels[0] - 1]}L")).join(within, "cell", "left_semi")
    rows = _in_levels(inside.select(*AXES), finest, levels, ("level", "cell"))
    boxes = [F.expr(f"{f}({a}) AS {n}_{a}") for a in AXES for n, f in (("lo", "min"), ("hi", "max"))]
    cells = rows.groupBy("level", "cell").agg(F.expr("count(1) AS n"), *boxes, *[F.expr(f"first({a}) AS at_{a}") for a in AXES])
    cells = cells.selectExpr("*", f"cell & {_masked('greatest(level, 1)')} AS above", f"n > {LEAF} AND level < {LEVELS} AS open")
    return cells.sortWithinPartitions("level", "above").persist(StorageLevel.MEMORY_AND_DISK)


def _divided(pairs: DataFrame, cells: DataFrame, level: int, side: str, closed: str, columns: list[str], also: list[str]) -> DataFrame:
    """Pairs with the open cells of one side replaced by their children at a level; the others stay as they are and meet nothing.

    ``_above``, the key of the join, is the cell of an open pair and ``closed`` of another; columns of the side itself are not kept besides
    ``columns``, those of the other side are.
    """
    kids = cells.where(f"level = {level}").selectExpr("above AS _above", *[f"{c} AS _{c}" for c in columns])
    keyed = pairs.selectExpr("*", f"CASE WHEN {side}open THEN {side}cell ELSE -1L - {closed} END AS _above")
    rest = [c for c in pairs.columns if not c.startswith(side)]
    return keyed.join(kids, "_above", "left").selectExpr(*also, *rest, *[f"CASE WHEN {side}open THEN _{c} ELSE {side}{c} END AS {side}{c}" for c in columns])


def _total(parts: list[str]) -> str:
    return " + ".join(f"({p}) * ({p})" for p in parts)


def _least(box: tuple[str, str]) -> str:
    """Squared lower bound of the distance of two boxes; ``box`` has the columns of the least and greatest coordinates, with ``{}`` for the axis."""
    low, high = ([side.format(a) for a in AXES] for side in box)
    return _total([f"greatest(0D, t_lo_{a} - {hi}, {lo} - t_hi_{a})" for a, lo, hi in zip(AXES, low, high)])


def _closest(pairs: DataFrame, by: list[str], box: tuple[str, str], limit: float, k: int) -> DataFrame:
    """Pairs that may hold one of the ``k`` nearest targets of what ``by`` names, with their squared lower bound ``_least`` and the bound ``_reach``.

    The lower bound is that of the two boxes. The upper bound of one target is the least distance to the far corner from the target cells'
    positions; for more targets it is the distance by which whole target cells hold that many. No pair of a part of the same points that
    begins beyond ``_reach`` is needed either.
    """
    low, high = ([side.format(a) for a in AXES] for side in box)
    least = _least(box)
    group = f"PARTITION BY {', '.join(by)}"
    if k == 1:
        most = _total([f"greatest(abs(t_at_{a} - {lo}), abs(t_at_{a} - {hi}))" for a, lo, hi in zip(AXES, low, high)])
        rows = pairs.selectExpr("*", f"{least} AS _least", f"{most} AS _most").selectExpr("*", f"min(_most) OVER ({group}) AS _best")
    else:
        most = _total([f"greatest(t_hi_{a} - {lo}, {hi} - t_lo_{a})" for a, lo, hi in zip(AXES, low, high)])
        rows = pairs.selectExpr("*", f"{least} AS _least", f"{most} AS _most")
        rows = rows.selectExpr("*", f"sum(t_n) OVER ({group} ORDER BY _most ROWS UNBOUNDED PRECEDING) AS _held")
        rows = rows.selectExpr("*", f"coalesce(min(CASE WHEN _held >= {k} THEN _most END) OVER ({group}), 16D) AS _best").drop("_held")
    rows = rows.selectExpr("*", f"least(sqrt(_best), {limit!r}D) + {SLACK!r}D AS _reach")
    return rows.where("sqrt(_least) <= _reach").drop("_most", "_best")


def candidates(points: DataFrame, targets: DataFrame, key: str, target_key: str, max_km: float = 21000.0, k: int = 1) -> DataFrame:
    """(key, lat, lon, target key, t_lat, t_lon): each point with the few targets that may be among its ``k`` nearest; those are all there.

    Targets on one spot are folded to their ``k`` smallest keys first. Rows without a position take no part.
    """
    left = cut(placed(points.select(F.col(key).alias("_p"), "lat", "lon")))
    spots = targets.select("lat", "lon", F.col(target_key).alias("_t"))
    if k == 1:
        spots = spots.groupBy("lat", "lon").agg(F.min("_t").alias("_t"))
    else:
        spots = positioned(spots, [F.col("_t").asc()], ["lat", "lon"], position="_nth").where(F.col("_nth") <= k).drop("_nth")
    spots = cut(placed(spots))
    members = spots.selectExpr("_t", "lat AS t_lat", "lon AS t_lon", *AXES)
    found = [F.col("_p").alias(key), "lat", "lon", F.col("_t").alias(target_key), "t_lat", "t_lon"]
    finest = _finest(left, spots)
    if finest is None:
        return left.limit(0).join(members.limit(0), F.col("t_lat") == F.col("lat")).select(*found)
    limit = 2 * math.sin(min(max_km / G.EARTH_KM, math.pi) / 2)  # a chord

    p_columns, t_columns = ["level", "cell", *BOX], ["level", "cell", "n", *BOX, *AT, "open"]
    p_names, t_names, box = [f"p_{c}" for c in p_columns], [f"t_{c}" for c in t_columns], ("p_lo_{}", "p_hi_{}")
    cells, group = ["p_level", "p_cell"], ["_above", "p_level", "p_cell"]  # rows meet by _above first, so the groups move no more
    by = ", ".join(group)
    settled = _total([f"p_hi_{a} - p_lo_{a}" for a in AXES]) + f" <= {SETTLED**2!r}D * min(_least) OVER (PARTITION BY {by})"
    few = f"count(1) OVER (PARTITION BY {by}) <= {FEW + 2 * (k // LEAF)} AND NOT max(t_open) OVER (PARTITION BY {by})"
    pairs = p_tree = t_tree = None
    for level in range(FIRST, LEVELS + 1):
        if pairs is None:
            levels = list(range(FIRST, FIRST + AT_ONCE + 1))
            p_tree, t_tree = _pyramid(left, finest, levels), _pyramid(spots, finest, levels)
            top, below = (tree.where(f"level = {FIRST}").selectExpr(*[f"{c} AS {side}{c}" for c in columns]) for tree, side, columns in ((p_tree, "p_", p_columns), (t_tree, "t_", t_columns)))
            near = top.join(F.broadcast(below)).withColumn("_above", F.col("p_cell"))  # at most a few hundred cells of a side
        else:
            if level > levels[-1]:
                p_tree.unpersist()
                t_tree.unpersist()
                levels = list(range(level, min(level + AT_ONCE, LEVELS + 1)))
                p_tree, t_tree = (_pyramid(rows, finest, levels, pairs.where(f"{side}open").select(F.col(f"{side}cell").alias("cell")).distinct()) for rows, side in ((left, "p_"), (spots, "t_")))
            # Target cells are divided first and most of their children dropped, by what is known of the cell of points, then the cells of points.
            near = _divided(pairs, t_tree, level, "t_", "p_cell", t_columns, []).where(f"sqrt({_least(box)}) <= _reach").drop("_reach")
            near = _divided(near, p_tree, level, "p_", "p_cell", p_columns, ["_above"])
        near = _closest(near, group, box, limit, k)
        pairs = cut(near.selectExpr(*p_names, *t_names, "_reach", f"p_level = {level} AND {level < LEVELS} AND NOT ({settled}) AND NOT ({few}) AS p_open"))
        if pairs.where("p_open OR t_open").isEmpty():
            break
    p_tree.unpersist()
    t_tree.unpersist()

    levels = pairs.agg(F.collect_set("p_level"), F.collect_set("t_level")).first()  # at most a number for each level
    own = _in_levels(left, finest, levels[0], ("p_level", "p_cell"))
    met = _closest(own.join(pairs.select(*cells, *t_names), cells), ["_p", "lat", "lon"], ("{}", "{}"), limit, k)
    return met.select("_p", "lat", "lon", "t_level", "t_cell").join(_in_levels(members, finest, levels[1], ("t_level", "t_cell")), ["t_level", "t_cell"]).select(*found)


def nearest(points: DataFrame, targets: DataFrame, key: str, target_key: str, max_km: float = 21000.0) -> DataFrame:
    """(key, lat, lon, distance_km, target key, t_lat, t_lon): the nearest target of every point within ``max_km``, ties to the smaller key."""
    met = candidates(points, targets, key, target_key, max_km)
    d = G.haversine(F.col("lat"), F.col("lon"), F.col("t_lat"), F.col("t_lon"))
    best = met.groupBy(key, "lat", "lon").agg(F.min(F.struct(d.alias("distance_km"), F.col(target_key), F.col("t_lat"), F.col("t_lon"))).alias("m"))
    return best.select(key, "lat", "lon", "m.*").where(F.col("distance_km") <= max_km)


def nearest_k(points: DataFrame, targets: DataFrame, key: str, target_key: str, k: int, max_km: float = 21000.0) -> DataFrame:
    """(key, target key, distance_km, hop): the ``k`` nearest targets of every point by distance and key, ``hop`` from 1.

    What is ranked per point are its candidates, a few cells of targets and not all of them.
    """
    met = candidates(points, targets, key, target_key, max_km, k)
    rows = met.select(key, target_key, G.haversine(F.col("lat"), F.col("lon"), F.col("t_lat"), F.col("t_lon")).alias("distance_km")).where(F.col("distance_km") <= max_km)
    best = Window.partitionBy(key).orderBy("distance_km", target_key)
    return rows.withColumn("hop", F.row_number().over(best).cast("bigint")).where(F.col("hop") <= k)

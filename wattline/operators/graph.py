"""The grid as nodes and edges: hierarchy, reach, waves, rank, triangles and cascade scores.

Iterations place the edges by node once, join them with a small changing table and cut its lineage through the checkpoint folder each
round.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window, functions as F

from wattline.functions.geometry import haversine
from wattline.operators.anchors import topk
from wattline.operators.ordering import positioned
from wattline.operators.pyramid import nearest_k
from wattline.session import cut


def hierarchy_nodes(substations: DataFrame, circuits: DataFrame, transformers: DataFrame, meters: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")

    def part(df, key, kind, parent, lat, lon, cap):
        return df.select(
            F.col(key).alias("asset_id"), F.lit(kind).alias("asset_type"), parent.alias("parent_id"),
            lat.alias("lat"), lon.alias("lon"), cap.cast("double").alias("capacity_kva"),
        )

    nothing = F.lit(None)
    return (
        part(substations, "substation_id", "SUBSTATION", none, F.col("lat"), F.col("lon"), F.col("capacity_mva") * 1000)
        .unionByName(part(circuits, "circuit_id", "CIRCUIT", F.col("substation_id"), F.col("s_lat"), F.col("s_lon"), nothing))
        .unionByName(part(transformers, "transformer_id", "TRANSFORMER", F.col("circuit_id"), F.col("lat"), F.col("lon"), F.col("rated_kva")))
        .unionByName(part(meters, "meter_id", "METER", F.col("transformer_id"), F.col("lat"), F.col("lon"), nothing))
    )


def hierarchy_edges(nodes: DataFrame) -> DataFrame:
    """Parent -> child edges with both positions."""
    p = nodes.select(F.col("asset_id").alias("parent_id"), F.col("asset_type").alias("p_type"), F.col("lat").alias("from_lat"), F.col("lon").alias("from_lon"))
    e = nodes.where("parent_id IS NOT NULL").join(p, "parent_id")
    return e.select(
        F.col("parent_id").alias("src"), F.col("asset_id").alias("dst"), F.concat_ws(" -> ", "p_type", "asset_type").alias("edge_type"),
        "from_lat", "from_lon", F.col("lat").alias("to_lat"), F.col("lon").alias("to_lon"),
        haversine(F.col("from_lat"), F.col("from_lon"), F.col("lat"), F.col("lon")).alias("length_km"),
    )


def grid_nodes(substations: DataFrame, transformers: DataFrame) -> DataFrame:
    """Substation and transformer nodes with downstream counts and a criticality from capacity and health.

    criticality = 0.5 * capacity share of the largest of its type + 0.5 * (1 - health/100); substations count as healthy
    to the mean of their transformers.
    """
    down = transformers.groupBy("substation_id").agg(
        F.count(F.lit(1)).alias("downstream_transformers"), F.sum("rated_kva").alias("downstream_capacity_kva"), F.avg("health_score").alias("health")
    )
    top = down.agg(F.max("downstream_capacity_kva")).scalar()
    big = transformers.agg(F.max("rated_kva")).scalar()
    subs = substations.join(down, "substation_id", "left").select(
        F.concat(F.lit("SUB_"), F.col("substation_id")).alias("node_id"), F.lit("SUBSTATION").alias("node_type"), F.lit(None).cast("string").alias("parent_node_id"),
        "lat", "lon", (F.col("capacity_mva") * 1000.0).alias("capacity_kva"),
        F.coalesce("downstream_transformers", F.lit(0)).alias("downstream_transformers"),
        F.coalesce("downstream_capacity_kva", F.lit(0)).cast("double").alias("downstream_capacity_kva"),
        (0.5 * F.coalesce(F.col("downstream_capacity_kva") / top, F.lit(0.0)) + 0.5 * (1 - F.coalesce("health", F.lit(100.0)) / 100)).alias("criticality_score"),
    )
    xfmr = transformers.select(
        F.concat(F.lit("XFMR_"), F.col("transformer_id")).alias("node_id"), F.lit("TRANSFORMER").alias("node_type"),
        F.concat(F.lit("SUB_"), F.col("substation_id")).alias("parent_node_id"), "lat", "lon", F.col("rated_kva").cast("double").alias("capacity_kva"),
        F.lit(0).cast("bigint").alias("downstream_transformers"), F.lit(0.0).alias("downstream_capacity_kva"),
        (0.5 * F.col("rated_kva") / big + 0.5 * (1 - F.col("health_score") / 100)).alias("criticality_score"),
    )
    return subs.unionByName(xfmr)


def downstream(substations: DataFrame, transformers: DataFrame, meters: DataFrame, starts: DataFrame) -> DataFrame:
    """Assets below each start (asset_id, asset_type) with hops and customers behind them; the start is hop 0."""
    per_xfmr = meters.groupBy("transformer_id").agg(F.count(F.lit(1)).alias("n"))
    start = starts.select(F.col("asset_id").alias("source_id"), F.col("asset_id").alias("downstream_id"), "asset_type", F.lit(0).alias("hops"))
    subs = starts.where("asset_type = 'SUBSTATION'").select(F.col("asset_id").alias("source_id"), F.col("asset_id").alias("substation_id"))
    below = subs.join(transformers.select("substation_id", "transformer_id"), "substation_id").select(
        "source_id", F.col("transformer_id").alias("downstream_id"), F.lit("TRANSFORMER").alias("asset_type"), F.lit(1).alias("hops")
    )
    at_xfmr = below.unionByName(start.where("asset_type = 'TRANSFORMER'"))
    ends = at_xfmr.join(meters.select(F.col("transformer_id").alias("downstream_id"), "meter_id"), "downstream_id").select(
        "source_id", F.col("meter_id").alias("downstream_id"), F.lit("METER").alias("asset_type"), (F.col("hops") + 1).alias("hops")
    )
    rows = start.unionByName(below).unionByName(ends)
    return rows.join(per_xfmr.withColumnRenamed("transformer_id", "downstream_id"), "downstream_id", "left").select(
        "source_id", "downstream_id", "asset_type", "hops",
        F.when(F.col("asset_type") == "METER", F.lit(1)).when(F.col("asset_type") == "TRANSFORMER", F.coalesce("n", F.lit(0))).otherwise(0).cast("bigint").alias("affected_customers"),
    )


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions, no loops, no repeats."""
    there, back = F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return edges.where("src <> dst").select(F.inline(F.array(there, back))).distinct()


def by_node(edges: DataFrame) -> DataFrame:
    """Both directions of the edges, placed and sorted by ``src`` once: what joins them on ``src`` moves, the edges stay where they are.

    The rows are kept in memory or on the executors' disks; lost ones are made again from the checkpointed edges. Callers give them back.
    """
    links = cut(undirected(edges))
    width = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = links.repartition(width, "src").sortWithinPartitions("src").persist(StorageLevel.MEMORY_AND_DISK)
    held.count()
    return held


def bfs(edges: DataFrame, seeds: DataFrame, max_depth: int = 5) -> DataFrame:
    """Wave depth of every node within ``max_depth`` steps of a seed (node); stops when a wave is empty.

    A round moves waves only. Neighbours of a wave are in the wave before, in itself or in the next one, since edges go both ways; two
    waves therefore stand for all that was reached.
    """
    links = by_node(edges)
    waves = [cut(seeds.select("node").distinct().withColumn("depth", F.lit(0)))]
    try:
        for depth in range(1, max_depth + 1):
            step = waves[-1].join(links, waves[-1]["node"] == links["src"]).select(F.col("dst").alias("node")).distinct()
            for seen in waves[-2:]:
                step = step.join(seen.select("node"), "node", "left_anti")
            wave = cut(step.withColumn("depth", F.lit(depth)))
            if wave.isEmpty():
                break
            waves.append(wave)
    finally:
        links.unpersist()
    out = waves[0]
    for wave in waves[1:]:  # all on file already
        out = out.unionByName(wave)
    return out


def _degrees(links: DataFrame) -> DataFrame:
    return links.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("degree"))


def cyclic(links: DataFrame, degree: DataFrame, rounds: int = 16) -> DataFrame:
    """The links among the nodes that stay when nodes with one link are taken away, round after round: all links of cycles, few others.

    A round moves the links of the nodes it takes. It is the last one when it takes less than a hundredth of what is there; branches
    longer than the rounds stay in part.
    """
    left, n = degree, degree.count()
    for _ in range(rounds):
        ends = left.where("degree < 2").select(F.col("node").alias("src"))
        lost = links.join(ends, "src").groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("lost"))
        left = cut(left.where("degree > 1").join(lost, "node", "left").select("node", (F.col("degree") - F.coalesce("lost", F.lit(0))).alias("degree")))
        before, n = n, left.count()
        if n > 0.99 * before or not n:
            break
    return cut(links.join(left.select(F.col("node").alias("src")), "src", "left_semi").join(left.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst"))


def degree_reach(edges: DataFrame, heavy: int = 1000, lg_k: int | None = None) -> DataFrame:
    """Degree, number of nodes at distance two, reach and its ratio, normalised degree.

    A path of two steps that is not on a cycle leads to a node that no other such path and no edge joins with its start: these paths are
    counted from the degrees. Pairs of nodes are listed for the paths inside the part with cycles only (``cyclic``), none in a tree.

    Going through a hub would emit all pairs of its neighbours.  Hubs (degree above ``heavy``) are therefore not
    expanded; only paths through light nodes, at most ``heavy`` per edge, are listed.  What lies behind the hubs of a node
    is taken once for every distinct set of hubs:

    * exactly (``lg_k`` left out), as a list of the nodes that a set reaches, which can be as long as sets times hub degree;
    * or from mergeable sketches of 2^lg_k registers, one per hub, merged per set and then with the node's own: their size is
      fixed, and a node's reach has a relative standard error of 1.04 / sqrt(2^lg_k).  Nodes without a hub beside them stay exact;
      ``estimated`` says which are not.
    """
    return degree_reaches(edges, (heavy, lg_k))[0]


def degree_reaches(edges: DataFrame, *ways: tuple[int, int | None]) -> list[DataFrame]:
    """``degree_reach`` for each (heavy, lg_k); the links are placed and the paths counted once for all."""
    links = by_node(edges)
    degree = cut(_degrees(links))
    core = cyclic(links, degree)
    # paths inside the core count as the pairs that they join, which each way lists
    inside = _paths(core, _degrees(core)).select("node", F.col("n2").alias("inside"))
    nodes = cut(_paths(links, degree).join(inside, "node", "left").select("node", "degree", (F.col("n2") - F.coalesce("inside", F.lit(0))).alias("n2")))
    try:
        return [_reach(links, core, nodes, heavy, lg_k) for heavy, lg_k in ways]
    finally:
        links.unpersist()


def _reach(links: DataFrame, core: DataFrame, nodes: DataFrame, heavy: int, lg_k: int | None) -> DataFrame:
    hubs = nodes.where(F.col("degree") > heavy).select(F.col("node").alias("hub"))
    if lg_k is None or hubs.isEmpty():
        more = _pairs(core, heavy).withColumn("estimated", F.lit(False))
    else:
        sets, members = _hub_sets(links, hubs)
        # no hub is beside the other nodes, so their paths through light nodes are all
        apart = _onward(_into(core).join(sets.select("node"), "node", "left_anti"), core)
        pairs = _unlinked(apart, _near(core)).groupBy("node").agg(F.count(F.lit(1)).alias("more")).withColumn("estimated", F.lit(False))
        more = pairs.unionByName(_sketched(links, nodes, sets, members, hubs, heavy, lg_k))
    n2 = F.when(F.col("estimated"), F.col("more")).otherwise(F.col("n2") + F.coalesce("more", F.lit(0)))
    two = nodes.join(cut(more), "node", "left").withColumn("n2", n2)
    total = nodes.agg(F.count(F.lit(1)).alias("n")).scalar()
    out = two.select(
        "node", "degree", F.col("degree").alias("neighbors_1hop"), F.col("n2").alias("neighbors_2hop"), (F.col("degree") + F.col("n2")).alias("total_reach"),
        (F.col("n2") / F.col("degree")).alias("reach_expansion_ratio"),
        (F.col("degree") / F.nullif(total - 1, F.lit(0))).alias("normalized_degree"), F.coalesce("estimated", F.lit(False)).alias("estimated"),
    )
    return out.drop("estimated") if lg_k is None else out


def _near(links: DataFrame) -> DataFrame:
    return links.select(F.col("src").alias("node"), F.col("dst").alias("far"))


def _into(links: DataFrame) -> DataFrame:
    return links.select(F.col("src").alias("mid"), F.col("dst").alias("node"))


def _onward(into: DataFrame, links: DataFrame) -> DataFrame:
    """(node, far) at the ends of the paths that begin with the steps (mid, node); a pair may come several times."""
    return into.join(links.select(F.col("src").alias("mid"), F.col("dst").alias("far")), "mid").where("node <> far").select("node", "far")


def _paths(links: DataFrame, degree: DataFrame) -> DataFrame:
    """(node, degree, n2): how many paths of one step and of two begin at a node."""
    onward = degree.select(F.col("node").alias("src"), (F.col("degree") - 1).alias("onward"))
    return links.join(onward, "src").groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("degree"), F.sum("onward").alias("n2"))


def _hub_sets(links: DataFrame, hubs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, set_id) of the nodes beside hubs and (set_id, hub): nodes with the same hubs beside them share a set."""
    beside = cut(links.join(hubs, F.col("dst") == F.col("hub")).select(F.col("src").alias("node"), "hub"))
    # such nodes share a fingerprint; one of them stands for the set
    marks = beside.groupBy("node").agg(
        F.count(F.lit(1)).alias("_c"), F.bit_xor(F.xxhash64("hub")).alias("_x"), F.bit_xor(F.xxhash64("hub", F.lit("second"))).alias("_y")
    )
    sets = cut(marks.withColumn("set_id", F.concat_ws(":", "_c", "_x", "_y")).select("node", "set_id"))
    return sets, sets.groupBy("set_id").agg(F.min("node").alias("node")).join(beside, "node").select("set_id", "hub")


def _pairs(links: DataFrame, heavy: int) -> DataFrame:
    """(node, more): the nodes at distance two, counted from listed pairs and from the lists of what sets of hubs reach."""
    degree = cut(_degrees(links))
    hubs = degree.where(F.col("degree") > heavy).select(F.col("node").alias("hub"))
    light = degree.where(F.col("degree") <= heavy).select(F.col("node").alias("mid"))
    paths = _unlinked(_onward(_into(links).join(light, "mid"), links), _near(links))
    if hubs.isEmpty():
        return paths.groupBy("node").agg(F.count(F.lit(1)).alias("more"))
    return _through_hubs(paths, _near(links), degree, *_hub_sets(links, hubs), links)


def _unlinked(listed: DataFrame, near: DataFrame) -> DataFrame:
    """Distinct pairs (node, far) that no edge joins."""
    return listed.distinct().join(near, ["node", "far"], "left_anti")


def _through_hubs(paths: DataFrame, near: DataFrame, degree: DataFrame, sets: DataFrame, members: DataFrame, links: DataFrame) -> DataFrame:
    """(node, more): the list of what each set of hubs reaches, and of the light paths those that lead elsewhere."""
    covered = cut(members.join(links.select(F.col("src").alias("hub"), F.col("dst").alias("far")), "hub").select("set_id", "far").distinct())
    cover_size = covered.groupBy("set_id").agg(F.count(F.lit(1)).alias("cover"))
    # from the cover of a node remove itself and its direct neighbours
    own = near.join(sets.select("node", "set_id"), "node").join(covered, ["set_id", "far"]).groupBy("node").agg(F.count(F.lit(1)).alias("own"))
    via_hub = sets.join(cover_size, "set_id").join(own, "node", "left").select("node", (F.col("cover") - F.coalesce("own", F.lit(0)) - 1).alias("n2h"))
    extra = paths.join(sets.select("node", "set_id"), "node", "left").join(covered.withColumn("_c", F.lit(True)), ["set_id", "far"], "left").where("_c IS NULL")
    via_light = extra.groupBy("node").agg(F.count(F.lit(1)).alias("n2l"))
    return degree.select("node").join(via_hub, "node", "left").join(via_light, "node", "left").select(
        "node", (F.coalesce("n2h", F.lit(0)) + F.coalesce("n2l", F.lit(0))).alias("more")
    )


def _sketched(links: DataFrame, nodes: DataFrame, sets: DataFrame, members: DataFrame, hubs: DataFrame, heavy: int, lg_k: int) -> DataFrame:
    """(node, more, estimated) beside hubs: the merged sketch of all nodes within two steps, less the node and its neighbours."""
    beside = sets.select("node")
    light = nodes.where(F.col("degree") <= heavy).select(F.col("node").alias("mid"))
    of_hub = links.join(hubs, F.col("src") == F.col("hub")).groupBy("hub").agg(F.hll_sketch_agg("dst", lg_k).alias("sketch"))
    cover = members.join(cut(of_hub), "hub").groupBy("set_id").agg(F.hll_union_agg("sketch").alias("cover"))
    itself = beside.select("node", F.col("node").alias("far"))
    listed = _onward(_into(links).join(light, "mid").join(beside, "node", "left_semi"), links)
    near = _near(links).join(beside, "node", "left_semi")
    own = listed.unionByName(near).unionByName(itself).groupBy("node").agg(F.hll_sketch_agg("far", lg_k).alias("own"))
    ball = F.hll_sketch_estimate(F.hll_union("own", "cover"))
    merged = sets.join(cover, "set_id").join(own, "node").join(nodes, "node")
    return merged.select("node", F.greatest(F.lit(0), ball - 1 - F.col("degree")).cast("bigint").alias("more"), F.lit(True).alias("estimated"))


def pagerank(edges: DataFrame, iterations: int = 10, damping: float = 0.85) -> DataFrame:
    """Fixed number of rounds over the undirected graph.

    Edges and nodes lie by node in equally many parts, and a round's ranks come out that way, so the only shuffle of a round is that of
    the contributions, summed before it. Every round is cut: a lost executor repeats one round at most.
    """
    links = by_node(edges)
    nodes = links.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("d")).persist(StorageLevel.MEMORY_AND_DISK)
    n = nodes.count()
    ranks = nodes.select("node", "d", F.lit(1.0 / n if n else 0.0).alias("rank"))
    try:
        for _ in range(iterations):
            share = ranks.select(F.col("node").alias("src"), (F.col("rank") / F.col("d")).alias("part"))
            sums = links.join(share, "src").groupBy(F.col("dst").alias("node")).agg(F.sum("part").alias("s"))
            ranks = cut(nodes.join(sums, "node", "left").select("node", "d", (F.lit((1 - damping) / max(n, 1)) + damping * F.coalesce("s", F.lit(0.0))).alias("rank")))
    finally:
        nodes.unpersist()
        links.unpersist()
    return ranks.select("node", F.col("rank").alias("pagerank"))


def eigenvector(edges: DataFrame, iterations: int = 10) -> DataFrame:
    """Power iteration with the vector scaled to length one each round."""
    links = by_node(edges)
    vector = cut(links.select(F.col("src").alias("node")).distinct().withColumn("x", F.lit(1.0)))
    for _ in range(iterations):
        sums = links.join(vector.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum("x").alias("s"))
        stepped = cut(vector.join(sums, "node").select("node", (F.col("x") + F.col("s")).alias("x")))
        length = stepped.agg(F.sqrt(F.sum(F.col("x") * F.col("x")))).first()[0]
        vector = stepped.select("node", (F.col("x") / F.lit(length)).alias("x"))
    links.unpersist()
    return vector.select("node", F.col("x").alias("eigenvector"))


def closeness(edges: DataFrame, sources: DataFrame, max_depth: int = 6) -> DataFrame:
    """Mean distance from the given source nodes to each node (sampled closeness), one wave set for all sources."""
    links = by_node(edges)
    waves = [cut(sources.select(F.col("node").alias("source"), "node").distinct().withColumn("depth", F.lit(0)))]
    for depth in range(1, max_depth + 1):
        step = waves[-1].join(links, waves[-1]["node"] == links["src"]).select("source", F.col("dst").alias("node")).distinct()
        for seen in waves[-2:]:
            step = step.join(seen.select("source", "node"), ["source", "node"], "left_anti")
        wave = cut(step.withColumn("depth", F.lit(depth)))
        if wave.isEmpty():
            break
        waves.append(wave)
    links.unpersist()
    reached = waves[0]
    for wave in waves[1:]:
        reached = reached.unionByName(wave)
    return reached.groupBy("node").agg(F.count(F.lit(1)).alias("sources_reached"), F.avg("depth").alias("mean_distance"))


def triangles(edges: DataFrame) -> DataFrame:
    """Clustering coefficient.  Edges point from lower to higher degree, so a node has O(sqrt(E)) outgoing edges and
    hubs do not list all pairs of their neighbours."""
    links = cut(undirected(edges))
    degree = cut(links.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("d")))
    da = degree.select(F.col("node").alias("src"), F.col("d").alias("ds"))
    db = degree.select(F.col("node").alias("dst"), F.col("d").alias("dd"))
    up = links.join(da, "src").join(db, "dst").where("ds < dd OR (ds = dd AND src < dst)").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    up = cut(up)
    second = up.select(F.col("a"), F.col("b").alias("c"))
    wedges = up.join(second, "a").where("b <> c").select("a", F.col("b"), F.col("c"))
    closing = up.select(F.col("a").alias("b"), F.col("b").alias("c"))
    found = wedges.join(closing, ["b", "c"])
    corners = found.select(F.explode(F.array("a", "b", "c")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("t"))
    pairs = F.col("d") * (F.col("d") - 1) / 2
    return degree.join(corners, "node", "left").select(
        "node", F.col("d").alias("degree"), F.coalesce("t", F.lit(0)).alias("triangles"),
        F.when(F.col("d") > 1, F.coalesce("t", F.lit(0)) / pairs).otherwise(0.0).alias("clustering"),
    )


# The four precomputed scenarios (id, name, rank of the first node, number of nodes).
SCENARIOS = [
    ("scenario_1", "Summer Peak 2025", 1, 13),
    ("scenario_2", "Winter Storm Scenario", 2, 22),
    ("scenario_3", "Hurricane Season", 3, 9),
    ("scenario_4", "Normal Operations Baseline", 4, 1),
]


FEW_ANCHORS = 1000


def _from_each(anchors: DataFrame, points: DataFrame, anchor_key: str, point_key: str) -> DataFrame | None:
    """Distances from every anchor of a short list, which goes along with the points; None for a long one."""
    a = anchors.select(anchor_key, F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon"))
    if a.limit(FEW_ANCHORS + 1).count() > FEW_ANCHORS:
        return None
    listed = a.agg(F.collect_list(F.struct("*")).alias("a")).scalar()
    rows = points.select(point_key, "lat", "lon", F.explode(listed).alias("a")).select(point_key, "lat", "lon", "a.*")
    return rows.select(anchor_key, point_key, haversine(F.col("a_lat"), F.col("a_lon"), F.col("lat"), F.col("lon")).alias("distance_km"))


def nearest_rank(anchors: DataFrame, points: DataFrame, anchor_key: str, point_key: str) -> DataFrame:
    """Rank every point by distance from every anchor of a short list; the result has all pairs. ``nearest_few`` ranks the nearest only."""
    rows = _from_each(anchors, points, anchor_key, point_key)
    if rows is None:
        raise ValueError(f"more than {FEW_ANCHORS} anchors: rank the nearest with nearest_few")
    return positioned(rows, [F.col("distance_km").asc(), F.col(point_key).asc()], keys=[anchor_key], position="hop")


def nearest_few(anchors: DataFrame, points: DataFrame, anchor_key: str, point_key: str, k: int) -> DataFrame:
    """(anchor, point, distance_km, hop): the ``k`` nearest points of every anchor by distance and key.

    With few anchors every task keeps its ``k`` best per anchor and only these are shuffled and merged; with many, points and anchors
    are searched through the pyramid of cells.
    """
    placed = points.where("lat IS NOT NULL AND lon IS NOT NULL")
    rows = _from_each(anchors.where("lat IS NOT NULL AND lon IS NOT NULL"), placed, anchor_key, point_key)
    if rows is None:
        return nearest_k(anchors, points, anchor_key, point_key, k)
    best = Window.partitionBy(anchor_key).orderBy("distance_km", point_key)
    return rows.withColumn("hop", F.row_number().over(best).cast("bigint")).where(F.col("hop") <= k)


def wavefront(substations: DataFrame, scenarios: list[tuple] = SCENARIOS) -> DataFrame:
    """Per scenario: first node by capacity rank, its nearest substations, wave = min(ceil(km / 8), 5)."""
    spark = substations.sparkSession
    listed = spark.createDataFrame(scenarios, "scenario_id string, scenario_name string, pz_rank bigint, total_nodes bigint")
    placed = substations.where("lat IS NOT NULL AND lon IS NOT NULL")
    ranked = positioned(placed.select("substation_id", "substation_name", "lat", "lon", "capacity_mva"), [F.col("capacity_mva").desc_nulls_last(), F.col("substation_id").asc()], position="pz_rank")
    zero = listed.join(ranked, "pz_rank").select("scenario_id", "lat", "lon")
    hops = nearest_few(zero, placed, "scenario_id", "substation_id", max(total for *_, total in scenarios))
    return (
        hops.join(listed.select("scenario_id", "total_nodes"), "scenario_id")
        .where("hop <= total_nodes")
        .join(placed.select("substation_id", "capacity_mva"), "substation_id")
        .select(
            "scenario_id", "substation_id", (F.col("hop") - 1).alias("order"),
            F.least(F.ceil(F.col("distance_km") / 8.0), F.lit(5)).cast("bigint").alias("wave_depth"),
            F.coalesce("capacity_mva", F.lit(0)).alias("capacity"), "distance_km",
        )
    )


def wavefront_summary(nodes: DataFrame) -> DataFrame:
    """Per scenario the ordered node array and the wave array; a scenario has at most its fixed number of nodes."""
    order = nodes.groupBy("scenario_id").agg(F.sort_array(F.collect_list(F.struct("order", "substation_id", "wave_depth"))).alias("cascade_order"))
    waves = nodes.groupBy("scenario_id", "wave_depth").agg(F.count(F.lit(1)).alias("nodes"), F.sum("capacity").alias("capacity"))
    breakdown = waves.groupBy("scenario_id").agg(F.sort_array(F.collect_list(F.struct("wave_depth", "nodes", "capacity"))).alias("wave_breakdown"))
    return order.join(breakdown, "scenario_id")


def node_risk(nodes: DataFrame, edges: DataFrame, threshold: float = 0.7, n: int = 20) -> DataFrame:
    out = edges.groupBy(F.col("src").alias("node_id")).agg(F.count(F.lit(1)).alias("downstream_connections"))
    rows = nodes.where(F.col("criticality_score") > threshold).join(out, "node_id", "left").withColumn("downstream_connections", F.coalesce("downstream_connections", F.lit(0)))
    scored = rows.select("node_id", "node_type", "criticality_score", "downstream_connections", F.round(F.col("criticality_score") * F.col("downstream_connections"), 2).alias("cascade_risk_score"))
    return topk(scored, [F.col("cascade_risk_score").desc(), F.col("node_id").asc()], n)


def combined_risk(predictions: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """probability x criticality x ln(2 + downstream)."""
    out = edges.groupBy(F.col("src").alias("node_id")).agg(F.count(F.lit(1)).alias("downstream_count"))
    return predictions.join(nodes.select("node_id", "criticality_score"), "node_id").join(out, "node_id", "left").select(
        "node_id", "risk_probability", "criticality_score", F.coalesce("downstream_count", F.lit(0)).alias("downstream_count"),
        (F.col("risk_probability") * F.col("criticality_score") * F.log(F.lit(2) + F.coalesce("downstream_count", F.lit(0)))).alias("combined_cascade_risk"),
    )


# Advice attached to an impact report.
ACTIONS = [
    "Activate emergency response team", "Notify affected customers", "Prepare load transfer to adjacent substations", "Deploy mobile generation if available",
]


def connected_substations(substations: DataFrame, radius_km: float) -> DataFrame:
    """Pairs of substations within the radius (cell-keyed join)."""
    from wattline.operators.geo import within_radius

    a = substations.select(F.col("substation_id").alias("source_substation_id"), "lat", "lon")
    b = substations.select(F.col("substation_id").alias("connected_substation_id"), "lat", "lon")
    return within_radius(a, b, "source_substation_id", "connected_substation_id", radius_km).where("source_substation_id <> connected_substation_id")


def cascade_impact(substations: DataFrame, connections: DataFrame, transformers: DataFrame, meters: DataFrame, customers: DataFrame, include_secondary: bool = True) -> DataFrame:
    """For every substation: what it and its connected substations carry.  Each table is combined per substation first."""
    per_t = transformers.groupBy("substation_id").agg(F.count(F.lit(1)).alias("t"))
    home = customers.select("customer_id", "meter_id").join(meters.select("meter_id", "transformer_id"), "meter_id").join(transformers.select("transformer_id", "substation_id"), "transformer_id")
    per_c = home.groupBy("substation_id").agg(F.countDistinct("customer_id").alias("c"))
    one = substations.select("substation_id", "capacity_mva").join(per_t, "substation_id", "left").join(per_c, "substation_id", "left")
    itself = substations.select(F.col("substation_id").alias("source"), "substation_id", F.lit(False).alias("far"))
    other = connections.select(F.col("source_substation_id").alias("source"), F.col("connected_substation_id").alias("substation_id"), F.lit(True).alias("far")).distinct()
    spread = itself.unionByName(other).join(one, "substation_id")
    counted = ~F.col("far") | F.lit(include_secondary)

    def total(c):
        return F.coalesce(F.sum(F.when(counted, F.col(c))), F.lit(0))

    level = F.col("affected_customers")
    return (
        spread.groupBy(F.col("source").alias("substation_id"))
        .agg(
            F.sum(F.when(F.col("far"), 1).otherwise(0)).alias("connected_substations"),
            total("t").alias("affected_transformers"), total("c").alias("affected_customers"), F.sum("capacity_mva").alias("affected_load_mw"),
        )
        .withColumn("impact_level", F.when(level > 100000, "CRITICAL").when(level > 10000, "SEVERE").when(level > 1000, "MODERATE").otherwise("LOW"))
        .withColumn("recommended_actions", F.array(*[F.lit(a) for a in ACTIONS]))
    )


def propagation_risk(transformers: DataFrame, meters: DataFrame, as_of: str) -> DataFrame:
    """For every transformer: siblings, customers behind it, risk and the date to maintain it by.

    Siblings are counted; ``relations.siblings`` lists them for chosen transformers.
    """
    size = transformers.groupBy("substation_id").agg(F.count(F.lit(1)).alias("n"))
    cust = meters.groupBy("transformer_id").agg(F.count(F.lit(1)).alias("c"))
    h, c = F.col("health_score"), F.coalesce("c", F.lit(0))
    day = F.lit(as_of).cast("date")
    return transformers.join(size, "substation_id").join(cust, "transformer_id", "left").select(
        "transformer_id", "health_score", (F.col("n") - 1).alias("connected_transformers"), c.alias("downstream_customers"),
        F.when((h < 50) & (c > 100), "CRITICAL").when((h < 70) & (c > 50), "HIGH").when(h < 85, "MEDIUM").otherwise("LOW").alias("propagation_risk"),
        F.when(h < 50, day).when(h < 70, F.date_add(day, 7)).when(h < 85, F.date_add(day, 30)).otherwise(F.date_add(day, 90)).alias("recommended_maintenance_date"),
    )


def cascade_monitor(substations: DataFrame, transformers: DataFrame, meters: DataFrame, threshold: float = 70) -> DataFrame:
    """One alert row over weak transformers that serve meters; the array has one entry per substation concerned."""
    served = meters.groupBy("transformer_id").agg(F.count(F.lit(1)).alias("customer_count"))
    weak = transformers.where(F.col("health_score") < threshold).join(served, "transformer_id").join(substations.select("substation_id"), "substation_id", "left_semi")
    per_sub = weak.groupBy("substation_id").agg(F.count(F.lit(1)).alias("n"), F.sum("customer_count").alias("c"))
    n = F.col("total_transformers_degraded")
    return per_sub.agg(
        F.sort_array(F.collect_list("substation_id")).alias("at_risk_substations"), F.sum("n").alias("total_transformers_degraded"), F.sum("c").alias("total_customers_at_risk")
    ).withColumn("alert_level", F.when(n > 10, "CRITICAL").when(n > 5, "HIGH").when(n > 2, "MEDIUM").otherwise("LOW"))


# Shed order of priority classes, lowest first.
SHED_RANK = {"CRITICAL": 4, "HIGH": 3, "MEDIUM": 2}


def feeder_loads(circuits: DataFrame, meters: DataFrame, customers: DataFrame, readings: DataFrame, since: Column) -> DataFrame:
    """Load (kWh / 4000 as MW) and customers per circuit; readings are combined per meter before the joins."""
    per_meter = readings.where(F.col("reading_ts") >= since).groupBy("meter_id").agg(F.sum("usage_kwh").alias("kwh"))
    per = (
        meters.select("meter_id", "circuit_id").join(customers.select("meter_id", "customer_id"), "meter_id").join(per_meter, "meter_id", "left")
        .groupBy("circuit_id").agg(F.countDistinct("customer_id").alias("customer_count"), (F.sum("kwh") / 4000.0).alias("load_mw"))
    )
    return circuits.select("circuit_id", "substation_id", "priority_class").join(per, "circuit_id")


def load_shed(feeders: DataFrame, target_mw: float, keys: list[str] | None = None) -> DataFrame:
    """Feeders to shed, low priority and large load first, while the running load stays within 110 % of the target.

    With ``keys`` (a substation, say) every group has a sequence and a target of its own.
    """
    keys = list(keys or [])
    pairs = [x for k, v in SHED_RANK.items() for x in (F.lit(k), F.lit(v))]
    rank = F.coalesce(F.element_at(F.create_map(*pairs), F.col("priority_class")), F.lit(1))
    rows = feeders.where("load_mw IS NOT NULL").withColumn("_rank", rank)
    order = [F.col("_rank").asc(), F.col("load_mw").desc_nulls_last(), F.col("circuit_id").asc()]
    out = positioned(rows, order, keys, running={"cumulative_shed_mw": "load_mw"}, position="shed_order")
    return out.where(F.col("cumulative_shed_mw") <= target_mw * 1.1).select(*keys, "shed_order", "circuit_id", "load_mw", "customer_count", F.col("priority_class").alias("priority"), "cumulative_shed_mw")


def zscore_cols(df: DataFrame, cols: list[str], eps: float = 1e-8) -> DataFrame:
    """Standardised columns with the population deviation; one aggregate read back as scalars."""
    stats = df.agg(*[f(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(f"{n}_{c}") for c in cols for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    row = stats.first()
    return df.withColumns({f"{c}_z": (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - F.lit(row[f"m_{c}"])) / (F.lit(row[f"s_{c}"]) + F.lit(eps)) for c in cols})



def hops_histogram(waves: DataFrame) -> DataFrame:
    return waves.groupBy("depth").agg(F.count(F.lit(1)).alias("nodes"))

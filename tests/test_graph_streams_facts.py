"""Placed edges, sketched reach, late rows of streams, exact streamed counts, metrics of several facts, stored sketches."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from wattline.operators import graph, readings
from wattline.plans.semantic import Model
from wattline.session import scratch_path
from wattline.streaming import jobs


def random_edges(spark, n, m, seed=1):
    rng = random.Random(seed)
    rows = [(f"n{rng.randrange(n)}", f"n{min(rng.randrange(n), rng.randrange(n))}") for _ in range(m)]
    return rows, spark.createDataFrame(rows, "src string, dst string")


def neighbours(rows):
    out = {}
    for a, b in rows:
        if a != b:
            out.setdefault(a, set()).add(b)
            out.setdefault(b, set()).add(a)
    return out


def test_waves_equal_a_plain_search(spark):
    rows, edges = random_edges(spark, 400, 500)
    near = neighbours(rows)
    seeds = ["n3", "n7", "missing"]
    depth = {s: 0 for s in seeds}
    wave = list(seeds)
    for d in range(1, 6):
        wave = sorted({y for x in wave for y in near.get(x, ())} - depth.keys())
        depth.update((x, d) for x in wave)
    got = {r["node"]: r["depth"] for r in graph.bfs(edges, spark.createDataFrame([(s,) for s in seeds], "node string"), 5).collect()}
    assert got == depth


def test_a_round_does_not_move_the_edges(spark):
    _, edges = random_edges(spark, 50, 100)
    links = graph.by_node(edges)
    ranks = links.groupBy("src").agg(F.count(F.lit(1)).alias("d"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        step = links.join(ranks, "src").groupBy("dst").agg(F.sum("d").alias("s"))
        step.collect()
        plan = step._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        links.unpersist()
    final = plan.split("Initial Plan")[0]
    # the only shuffle is that of the sums by dst; below the join both sides lie by src already
    assert "hashpartitioning(dst" in final and final.split("InMemoryRelation")[0].count("hashpartitioning(src") == 0


def test_rank_equals_a_plain_iteration(spark):
    rows, edges = random_edges(spark, 60, 150)
    near = neighbours(rows)
    rank = {x: 1 / len(near) for x in near}
    for _ in range(6):
        rank = {x: 0.15 / len(near) + 0.85 * sum(rank[y] / len(near[y]) for y in near[x]) for x in near}
    got = {r["node"]: r["pagerank"] for r in graph.pagerank(edges, 6).collect()}
    assert got.keys() == rank.keys() and all(abs(got[x] - rank[x]) < 1e-12 for x in rank)


@pytest.mark.parametrize("heavy", [5, 1000])
def test_sketched_reach_is_close_and_says_where(spark, heavy):
    rows, edges = random_edges(spark, 600, 900, 4)
    near = neighbours(rows)
    for r in graph.degree_reach(edges, heavy, lg_k=12).collect():
        ball = {z for y in near[r["node"]] for z in near[y]} | near[r["node"]] | {r["node"]}
        beside = any(len(near[y]) > heavy for y in near[r["node"]])
        assert r["degree"] == len(near[r["node"]]) and r["estimated"] == beside
        off = abs(r["total_reach"] - (len(ball) - 1))
        assert off == 0 if not beside else off <= 4 * 1.04 / 64 * len(ball) + 1


def reach_by_hand(rows):
    near = neighbours(rows)
    return {x: len({z for y in near[x] for z in near[y]} - near[x] - {x}) for x in near}


def test_no_pairs_are_listed_outside_cycles(spark, monkeypatch):
    """Finding F7: 30 branches of 40 leaves each on a long stem; listed, they are 50,000 pairs. A triangle, a square and repeated edges follow."""
    stem = [(f"s{i}", f"s{i + 1}") for i in range(40)]
    tree = stem + [(f"s{i}", f"l{i}-{j}") for i in range(30) for j in range(40)]
    rings = [("s0", "a"), ("a", "b"), ("b", "s0"), ("l3-0", "c"), ("c", "d"), ("d", "e"), ("e", "l3-0"), ("d", "end"), ("a", "a"), ("b", "a"), ("a", "b"), (None, "a")]
    listed, onward = [], graph._onward

    def counted(into, links):
        listed.append(out := onward(into, links))
        return out

    monkeypatch.setattr(graph, "_onward", counted)
    for rows, most in ((tree, 0), (tree + rings, 200)):
        edges = spark.createDataFrame(rows, "src string, dst string")
        listed.clear()
        got = {r["node"]: r["neighbors_2hop"] for r in graph.degree_reach(edges).collect()}
        assert got == reach_by_hand([r for r in rows if None not in r])
        pairs = sum(df.count() for df in listed)
        assert pairs <= most + 4 * len(stem)  # what is left of a stem longer than the rounds


@pytest.mark.parametrize("seed,heavy", [(5, 3), (6, 1000)])
def test_reach_of_trees_with_some_cycles(spark, seed, heavy):
    rng = random.Random(seed)
    rows = [(i, rng.randrange(i)) for i in range(1, 300)] + [(rng.randrange(300), rng.randrange(300)) for _ in range(25)]
    edges = spark.createDataFrame(rows, "src int, dst int")
    exact, sketched = graph.degree_reaches(edges, (heavy, None), (heavy, 12))
    want = reach_by_hand(rows)
    assert {r["node"]: r["neighbors_2hop"] for r in exact.collect()} == want
    assert all(r["neighbors_2hop"] == want[r["node"]] for r in sketched.where("not estimated").collect())


def test_a_thousand_hubs_of_ten_thousand_neighbours(spark):
    """Ten million edges: every leaf hangs on 100 hubs, and those reach 10,000 leaves in all; sketches have 2^10 registers."""
    leaves = spark.range(100_000).withColumn("hub", F.explode(F.sequence(F.lit(0), F.lit(99))))
    edges = leaves.select((F.col("id") + 1_000_000).alias("src"), (F.col("hub") * 10 + F.col("id") % 10).alias("dst"))
    out = graph.degree_reach(edges, heavy=1000, lg_k=10)
    kinds = out.groupBy(F.col("node") < 1000, "degree", "estimated").agg(F.count(F.lit(1)).alias("n"), F.min("total_reach").alias("least"), F.max("total_reach").alias("most")).collect()
    assert sorted((r["degree"], r["n"], r["estimated"]) for r in kinds) == [(100, 100_000, True), (10_000, 1000, False)]
    for r in kinds:
        true = 10_000 - 1 + 100 if r["estimated"] else 10_000 + 99
        assert abs(r["least"] - true) <= 4 * 1.04 / 32 * true and abs(r["most"] - true) <= 4 * 1.04 / 32 * true


T0 = dt.datetime(2024, 1, 1)


def deliver(spark, path, rows):
    spark.createDataFrame([(i, T0 + dt.timedelta(minutes=m) if m is not None else None) for i, m in rows], "id int, at timestamp_ntz").coalesce(1).write.mode("append").parquet(path)


def test_late_rows_are_routed_and_counted(spark):
    path, state = scratch_path(spark, "late-in"), scratch_path(spark, "late-state")
    deliveries = [[(1, 0), (2, 100), (3, 5)], [(4, 39), (5, 40), (6, 41), (7, 300), (8, 10)], [(9, 240), (10, 241), (11, None), (12, 20)], [(13, 500)]]
    router, dropped, schema = jobs.LateRows(spark, "at", "1 hour"), 0, None
    for rows in deliveries:
        deliver(spark, path, rows)
        schema = spark.read.parquet(path).schema
        stream = jobs.stream_parquet(spark, path, schema)
        routed = router.take(stream)
        timed = stream.withColumn("at", F.col("at").cast("timestamp_ltz")).withWatermark("at", "1 hour").dropDuplicatesWithinWatermark(["id"])
        query = timed.where("at IS NOT NULL").writeStream.format("noop").option("checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination()
        dropped += jobs.dropped_by_watermark([json.loads(p.json) for p in query.recentProgress])
    late = {r["id"] for r in routed.where("is_late").collect()}
    assert late == {4, 5, 8, 9, 12} and routed.count() == 13  # newest 100 minutes, then 300, an hour back, the edge itself included
    assert dropped == len(late)


def test_a_batch_that_runs_again_replaces_its_rows(spark):
    router = jobs.LateRows(spark, "at", "1 hour")
    path = scratch_path(spark, "late-again")
    deliver(spark, path, [(1, 0), (2, 100)])
    first = spark.read.parquet(path)
    router._step(first, 0)
    again = first.where("id = 2").withColumn("id", F.lit(3))
    for _ in range(2):
        router._step(again.withColumn("at", F.col("at") - F.expr("interval 61 minutes")), 1)
    rows = router._table(first.schema).select("id", "epoch", "is_late").collect()
    assert sorted(map(tuple, rows)) == [(1, 0, False), (2, 0, False), (3, 1, True)]


def test_streamed_circuit_state_counts_meters_exactly_out_of_order(spark):
    rng = random.Random(2)
    minutes = {i: rng.sample(range(0, 240, 5), 30) for i in range(60)}
    rows = [(f"M{i}", m, rng.choice([0.0, 0.5, 1.25]), rng.choice([110.0, 119.5, 121.0])) for i, ms in minutes.items() for m in ms]
    rows.sort(key=lambda r: r[1] + rng.randrange(0, 25))  # at most 25 minutes out of order
    path = scratch_path(spark, "meters-in")
    for k in range(0, len(rows), 600):
        part = [(a, T0 + dt.timedelta(minutes=m), u, v) for a, m, u, v in rows[k : k + 600]]
        spark.createDataFrame(part, "meter_id string, reading_ts timestamp_ntz, usage_kwh double, voltage_v double").coalesce(1).write.mode("append").parquet(path)
    meters = spark.createDataFrame([(f"M{i}", f"C{i % 4}") for i in range(60)], "meter_id string, circuit_id string")
    stream = jobs.stream_parquet(spark, path, spark.read.parquet(path).schema, files_per_batch=1)
    got = {(r["window_start"], r["circuit_id"]): r for r in jobs.drain(jobs.rolling_circuit_health(stream, meters), "health").collect()}
    closed = max(m for _, m, _, _ in rows) - 30
    want = {}
    for a, m, u, v in rows:
        for back in range(4):
            start = m // 15 * 15 - 15 * back
            if start + 60 <= closed:
                want.setdefault((T0 + dt.timedelta(minutes=start), f"C{int(a[1:]) % 4}"), []).append((a, u, v))
    assert got.keys() == want.keys()
    for key, members in want.items():
        r = got[key]
        assert r["active_meters"] == len({a for a, _, _ in members})
        assert abs(r["avg_voltage"] - sum(v for *_, v in members) / len(members)) < 1e-9
        assert r["low_voltage_count"] == sum(v < 114 for *_, v in members) and r["zero_usage_count"] == sum(u == 0 for _, u, _ in members)


def test_metrics_of_several_facts_meet_on_their_dimensions(spark):
    model = Model.from_dict({
        "tables": [
            {"name": "f", "key": "k", "dimensions": {"F_DAY": "day"}, "metrics": {"TOTAL": "sum(v)", "ROWS_F": "count(1)"}, "filters": {"BIG": "v > 1"}},
            {"name": "g", "key": "k", "dimensions": {"G_DAY": "at"}, "metrics": {"EVENTS": "count(distinct e)"}},
            {"name": "d", "key": "k", "dimensions": {"LABEL": "label"}},
        ],
        "relationships": [{"left": "f", "left_key": "k", "right": "d", "right_key": "k"}, {"left": "g", "left_key": "k", "right": "d", "right_key": "k"}],
        "shared": {"DAY": {"f": "F_DAY", "g": "G_DAY"}},
    })
    f = spark.createDataFrame([("a", 1, 2.0), ("a", 1, 1.0), ("z", 1, 4.0), ("b", None, 8.0)], "k string, day int, v double")
    g = spark.createDataFrame([("a", 1, "x"), ("a", 1, "x"), ("a", 2, "y"), ("z", 1, "q"), ("b", None, "r")], "k string, at int, e string")
    d = spark.createDataFrame([("a", "A"), ("b", "B")], "k string, label string")
    frames = {"f": f, "g": g, "d": d}
    got = {(r["label"], r["day"]): (r["total"], r["events"], r["rows_f"]) for r in model.query(frames, ["LABEL", "DAY"], ["TOTAL", "EVENTS", "ROWS_F"]).collect()}
    assert got == {("A", 1): (3.0, 1, 2), ("A", 2): (None, 1, None), (None, 1): (4.0, 1, 1), ("B", None): (8.0, 1, 1)}
    filtered = {(r["label"], r["day"]): (r["total"], r["events"]) for r in model.query(frames, ["LABEL", "DAY"], ["TOTAL", "EVENTS"], ["BIG"]).collect()}
    assert filtered[("A", 1)] == (2.0, 1) and filtered[("A", 2)] == (None, 1)
    assert model.query(frames, [], ["EVENTS", "TOTAL"]).collect() == [(4, 15.0)]
    with pytest.raises(KeyError):
        model.query(frames, ["F_DAY"], ["TOTAL", "EVENTS"])  # g does not lead to f
    with pytest.raises(KeyError):
        model.query(frames, ["LABEL"], ["EVENTS"], ["BIG"])


def test_stored_sketches_merge_within_their_bounds(spark):
    rows = spark.range(60_000).select(
        F.concat(F.lit("M"), F.col("id") * 7919 % 3001).alias("meter_id"), (F.lit(T0) + F.make_dt_interval(F.lit(0), F.lit(0), F.col("id").cast("int"))).cast("timestamp_ntz").alias("reading_ts"),
        F.when(F.col("id") % 3 == 0, 0.0).otherwise(F.pow(F.col("id") % 997, F.lit(2))).alias("usage_kwh"),
    )
    daily = readings.daily_sketches(rows)
    assert daily.count() > 30
    for r in readings.approx_errors(readings.approx_monthly(daily), rows).collect():
        assert all(r[c] for c in ("all_counted", "meters_within", "median_within", "p95_within")) and r["meters"] == 3001

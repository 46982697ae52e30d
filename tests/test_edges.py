"""Hand-made frames: boundaries, NULLs, ties, hot keys and brute-force comparisons."""

import datetime as dt
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import Window, functions as F

from wattline.functions import geometry as G, rules
from wattline.operators import assets, geo, graph, learning, load, maintenance, modelling, ordering, outages, quality, quantiles, readings, relations, search
from wattline.plans.backfill import backfill
from wattline.plans.semantic import LogicalTable, Model, Relationship, grid_model
from wattline.sources import files, incremental, landing, spines
from wattline.streaming import changes, jobs

FEW = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
T0 = dt.datetime(2024, 1, 1)


def reading(spark, rows):
    return spark.createDataFrame(rows, "meter_id string, reading_ts timestamp_ntz, usage_kwh double, voltage_v double, power_factor double, quality string")


def test_voltage_boundaries(spark):
    vs = [107.99, 108.0, 113.99, 114.0, 126.0, 126.01, None]
    df = reading(spark, [("M1", T0, 1.0, v, 0.9, "VALID") for v in vs])
    got = {r["voltage_v"]: (r["sag_type"], r["voltage_event_id"]) for r in readings.voltage_events(df).collect()}
    assert got[107.99][0] == "SEVERE_SAG" and got[108.0][0] == "MODERATE_SAG" and got[113.99][0] == "MODERATE_SAG"
    assert got[114.0] == (None, None) and got[126.0] == (None, None) and got[None] == (None, None)
    assert got[126.01] == ("SWELL", "VSE-20240101000000-M1")


def test_outage_needs_a_known_voltage(spark):
    df = reading(spark, [("a", T0, 0.0, 99.9, 0.9, "V"), ("b", T0, 0.0, 100.0, 0.9, "V"), ("c", T0, 0.0, None, 0.9, "V"), ("d", T0, 1.0, 50.0, 0.9, "V")])
    got = {r["meter_id"]: r["is_outage"] for r in readings.outage_adjusted(df).collect()}
    assert got == {"a": True, "b": False, "c": False, "d": False}


def test_health_boundaries(spark):
    df = spark.createDataFrame([(str(v), v, 81.0) for v in (39.9, 40.0, 59.9, 60.0, 79.9, 80.0, None)], "transformer_id string, health_score double, load_utilization_pct double")
    got = {r["health_score"]: r["health_category"] for r in assets.equipment_scorecard(df).collect()}
    assert got == {39.9: "CRITICAL", 40.0: "POOR", 59.9: "POOR", 60.0: "FAIR", 79.9: "FAIR", 80.0: "GOOD"}


def test_zero_rating_gives_null_load_factor(spark):
    r = reading(spark, [("m", T0, 1.0, 120.0, 0.9, "VALID")])
    m = spark.createDataFrame([("m", "t")], "meter_id string, transformer_id string")
    t = spark.createDataFrame([("t", 0)], "transformer_id string, rated_kva int")
    w = spark.createDataFrame([], "hour timestamp_ntz, temperature_f double")
    row = load.transformer_hourly_load(r, m, t, w).first()
    assert row["load_kw"] == 4.0 and row["load_factor_pct"] is None


def test_slots_equal_range_join(spark):
    rng = random.Random(3)
    rows = [("t%d" % rng.randint(0, 3), T0 + dt.timedelta(minutes=m), T0 + dt.timedelta(minutes=m + d)) for m, d in ((rng.randint(0, 600), rng.choice([0, 1, 14, 15, 16, 120])) for _ in range(60))]
    rows += [("t0", T0 + dt.timedelta(minutes=15), T0 + dt.timedelta(minutes=30)), ("t1", T0, T0)]
    o = spark.createDataFrame(rows, "transformer_id string, start_ts timestamp_ntz, end_ts timestamp_ntz")
    spine = spines.time_spine(spark, "2024-01-01 00:00:00", "2024-01-02 00:00:00")
    fast = {tuple(r) for r in outages.outage_slots(o).collect()}
    slow = {tuple(r) for r in outages.outage_slots_by_range(o, spine).collect()}
    assert fast == slow and ("t1", T0) in fast


@FEW
@given(st.integers(0, 10**6))
def test_percentiles_match_numpy(spark, seed):
    rng = np.random.default_rng(seed)
    hot = rng.choice([rng.normal(0, 1, 400), np.repeat(1.5, 400), rng.lognormal(0, 4, 400)])
    groups = {"hot": hot, "one": np.array([7.0]), "two": np.array([1.0, 2.0]), "far": np.concatenate([-rng.random(33), [1e150, 1e300]]), None: rng.random(9)}
    df = spark.createDataFrame([(k, float(v)) for k, vs in groups.items() for v in vs] + [("hot", None)], "k string, v double")
    probs = {"a": 0.0, "b": 0.37, "c": 0.5, "d": 0.9, "e": 1.0}
    got = {r["k"]: r for r in quantiles.exact_percentiles(df, ["k"], "v", probs).collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        for name, p in probs.items():
            assert math.isclose(got[k][name], float(np.quantile(vs, p)), rel_tol=1e-9, abs_tol=1e-9), (k, name)


def test_positions_keep_null_keys(spark):
    df = spark.createDataFrame([("a", 1), (None, 2), (None, 3), ("b", 4)], "k string, v int")
    got = sorted(map(str, map(tuple, ordering.positioned(df, [F.col("v").asc()], ["k"], {"run": "v"}).collect())))
    assert got == sorted(map(str, [("a", 1, 1, 1), (None, 2, 1, 2), (None, 3, 2, 5), ("b", 4, 1, 4)]))


def test_a_value_that_moves_between_columns_is_a_change(spark):
    old = spark.createDataFrame([(5, None, 7), (6, 1, 1)], "id int, a int, b int")
    new = spark.createDataFrame([(5, 7, None)], "id int, a int, b int")
    got = {r["id"]: (r["action"], r["a"], r["b"]) for r in changes.diff_snapshots(old, new, "id").collect()}
    assert got == {5: ("UPDATE", 7, None), 6: ("DELETE", 1, 1)}


def test_a_null_slice_is_replaced(spark):
    df = spark.createDataFrame([(None, 1), ("x", 2)], "s string, v int")
    new = spark.createDataFrame([(None, 9)], "s string, v int")
    assert sorted(r["v"] for r in maintenance.replace_slice(df, new, ["s"]).collect()) == [2, 9]


def test_only_times_inside_an_outage_count(spark):
    at = lambda m: dt.datetime(2024, 1, 1, 10, m)
    outs = spark.createDataFrame([("t", "WEATHER", at(10), at(40)), ("t", "WEATHER", at(11), at(13)), ("t", "OTHER", at(50), at(45))], "transformer_id string, cause string, start_ts timestamp_ntz, end_ts timestamp_ntz")
    reads = spark.createDataFrame([("m", at(m), 1.0, 0.5) for m in (1, 12, 20, 40, 44)], "meter_id string, reading_ts timestamp_ntz, usage_kwh double, usage_kwh_adjusted double")
    meters = spark.createDataFrame([("m", "t")], "meter_id string, transformer_id string")
    marked = {r["reading_ts"].minute: r["slot_quality"] for r in outages.mark_outage(reads, meters, outs).collect()}
    assert marked == {1: "VALID", 12: "OUTAGE", 20: "OUTAGE", 40: "OUTAGE", 44: "VALID"}
    assert [tuple(r) for r in outages.outage_loss(reads, meters, outs).collect()] == [("WEATHER", 3, 1, 3.0, 1.5)]


def test_a_spine_of_more_than_a_million_steps(spark):
    spine = spines.time_spine(spark, "2024-01-01 00:00:00", "2024-01-13 00:00:00", "1 second")
    out = relations.expand(spark.createDataFrame([("a",), ("b",)], "k string"), spine, "slot_ts")
    assert out.count() == 2 * (12 * 86400 + 1) and out.agg(F.max("slot_ts")).first()[0] == dt.datetime(2024, 1, 13)


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    from types import SimpleNamespace

    from wattline.session import shared_folder

    def fake(master, named):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, other: named), sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=lambda d: None))

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(fake("spark://host:7077", None))
    assert shared_folder(fake("spark://host:7077", "s3a://bucket/x/")) == "s3a://bucket/x"
    assert shared_folder(fake("local[2]", None))


def test_positions_with_a_hot_key_equal_a_window(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 5).cast("string")).alias("k"), (F.col("id") * 31 % 17).alias("v"), "id")
    order = [F.col("v").desc(), F.col("id").asc()]
    got = ordering.positioned(df, order, ["k"], {"run": "v"}, chunks=8)
    w = Window.partitionBy("k").orderBy(*order)
    want = df.select("*", F.row_number().over(w).cast("bigint").alias("position"), F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("run"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("n", [1, 4, 5, 13, 100])
def test_tiles_equal_ntile(spark, n):
    df = spark.range(n).select("id", (F.col("id") * 7 % 10).alias("v"))
    order = [F.col("v").asc(), F.col("id").asc()]
    got = {r["id"]: r["q"] for r in ordering.tiled(df, order, 5, "q").collect()}
    want = {r["id"]: r["q"] for r in df.select("id", F.ntile(5).over(Window.orderBy(*order)).alias("q")).collect()}
    assert got == want


def random_edges(seed, n=40, m=90):
    rng = random.Random(seed)
    edges = {(f"n{rng.randint(0, n)}", f"n{rng.randint(0, n)}") for _ in range(m)}
    edges |= {("hub", f"n{i}") for i in range(0, n, 2)} | {("hub2", f"n{i}") for i in range(0, n, 3)} | {("hub", "hub2"), ("n1", "n1")}
    return sorted(edges)


def neighbours(edges):
    adj = defaultdict(set)
    for a, b in edges:
        if a != b:
            adj[a].add(b)
            adj[b].add(a)
    return adj


@pytest.mark.parametrize("seed,heavy", [(1, 6), (2, 3), (3, 1000), (4, 0)])
def test_degree_reach_equals_brute_force(spark, seed, heavy):
    edges = random_edges(seed)
    adj = neighbours(edges)
    df = spark.createDataFrame(edges, "src string, dst string")
    got = {r["node"]: (r["degree"], r["neighbors_2hop"]) for r in graph.degree_reach(df, heavy=heavy).collect()}
    want = {v: (len(adj[v]), len(set().union(*[adj[w] for w in adj[v]]) - adj[v] - {v})) for v in adj}
    assert got == want


def test_triangles_equal_brute_force(spark):
    edges = random_edges(9)
    adj = neighbours(edges)
    got = {r["node"]: r["triangles"] for r in graph.triangles(spark.createDataFrame(edges, "src string, dst string")).collect()}
    want = {v: sum(1 for a in adj[v] for b in adj[v] if a < b and b in adj[a]) for v in adj}
    assert got == want


def test_waves_on_a_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "a"), ("x", "y")], "src string, dst string")
    seeds = spark.createDataFrame([("a",), ("alone",)], "node string")
    got = {r["node"]: r["depth"] for r in graph.bfs(edges, seeds, 5).collect()}
    assert got == {"a": 0, "alone": 0, "b": 1, "d": 1, "c": 2}


def points(spark, n, seed, prefix, spread=0.2):
    rng = random.Random(seed)
    rows = [(f"{prefix}{i}", 29.7 + spread * rng.random(), -95.4 + spread * rng.random()) for i in range(n)]
    return rows, spark.createDataFrame(rows, f"{prefix}_id string, lat double, lon double")


def hav(a, b):
    la, lo, lb, lp = map(math.radians, (a[1], a[2], b[1], b[2]))
    return 2 * 6371.0 * math.asin(math.sqrt(math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((lp - lo) / 2) ** 2))


@pytest.mark.parametrize("crowded", [3, 10_000])
def test_within_radius_equals_all_pairs(spark, crowded):
    a, da = points(spark, 80, 1, "a")
    b, db = points(spark, 90, 2, "b")
    got = {(r["a_id"], r["b_id"]) for r in geo.within_radius(da, db, "a_id", "b_id", 3.0, crowded).collect()}
    assert got == {(x[0], y[0]) for x in a for y in b if hav(x, y) <= 3.0}


@pytest.mark.parametrize("spread", [0.001, 0.2, 3.0])
def test_nearest_equals_brute_force(spark, spread):
    a, da = points(spark, 60, 5, "a", spread)
    b, db = points(spark, 300, 6, "b", spread)
    got = {r["a_id"]: r["distance_km"] for r in geo.nearest(da, db, "a_id", "b_id").collect()}
    for x in a:
        assert math.isclose(got[x[0]], min(hav(x, y) for y in b), rel_tol=1e-6, abs_tol=1e-6)


def test_cell_search_equals_scan(spark):
    a, da = points(spark, 3000, 11, "a", 0.1)
    for radius in (200, 500, 2000):
        got = {r["a_id"] for r in geo.meters_near(da, 29.75, -95.35, radius).collect()}
        assert got == {x[0] for x in a if hav(x, ("", 29.75, -95.35)) * 1000 <= radius}


def test_cell_helpers(spark):
    _, df = points(spark, 200, 4, "a")
    lat, lon = G.center(F.col("c"), 8)
    rows = df.withColumn("c", G.cell(F.col("lat"), F.col("lon"), 8)).withColumns({"clat": lat, "clon": lon, "d": G.disk(F.col("c"), 2, 8)})
    for r in rows.withColumns({"back": G.cell(F.col("clat"), F.col("clon"), 8), "far": F.transform("d", lambda x: G.grid_distance(F.col("c"), x)), "edge": G.boundary(F.col("c"), 8)}).collect():
        assert r["back"] == r["c"] and len(set(r["d"])) == 19 and max(r["far"]) == 2 and r["edge"].startswith("POLYGON((")
        assert hav(("", r["lat"], r["lon"]), ("", r["clat"], r["clon"])) <= G.EDGE_M[8] / 1000 * 1.02


def test_pair_listing_is_bounded_and_exact(spark):
    a, da = points(spark, 50, 21, "a", 0.0001)
    b, db = points(spark, 50, 22, "b", 0.0001)
    got = [(r["a_id"], r["b_id"]) for r in geo.cell_join(da, db, "a_id", "b_id", 5, 70).collect()]
    cells_a = {r["a_id"]: r["cell"] for r in geo.with_cell(da, 5).collect()}
    cells_b = {r["b_id"]: r["cell"] for r in geo.with_cell(db, 5).collect()}
    assert got == sorted((x, y) for x in cells_a for y in cells_b if cells_a[x] == cells_b[y])[:70]


@pytest.mark.parametrize("words", [0, 1, 1499, 1500, 1501, 2801])
def test_chunks_cover_every_word(spark, words):
    text = " ".join(f"w{i}" for i in range(words))
    rows = search.chunk_text(spark.createDataFrame([(1, text)], "doc_id int, text string"), "doc_id", "text").orderBy("chunk_index").collect()
    assert len(rows) == len(range(0, words, 1300))
    seen = set()
    for r in rows:
        assert r["chunk_id"] == f"1_{r['chunk_index']:04d}" and r["token_count"] == len(r["chunk_text"].split())
        seen |= set(r["chunk_text"].split())
    assert len(seen) == words


def test_keys(spark):
    valid = spark.createDataFrame([("SUB-HOU-001",), ("SUB-0021",), ("OK",)], "k string")
    df = spark.createDataFrame([("SUB-HOU-0001",), ("SUB_0021",), ("SUB_0022",), ("X",), ("OK",), (None,), ("SUB-HOU-12345",)], "raw string")
    got = {r["raw"]: r["normalized"] for r in relations.normalize_key(df, "raw", valid, "k").collect()}
    assert got == {"SUB-HOU-0001": "SUB-HOU-001", "SUB_0021": "SUB-0021", "SUB_0022": None, "X": None, "OK": "OK", None: None, "SUB-HOU-12345": None}


def test_upsert_twice_changes_nothing(spark):
    t = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "id int, name string, v double")
    s = spark.createDataFrame([(2, "z", None), (3, "c", 3.0)], "id int, name string, v double")
    once = maintenance.upsert(t, s, ["id"], ["v"])
    assert sorted(map(tuple, once.collect())) == [(1, "a", 1.0), (2, "b", None), (3, "c", 3.0)]
    assert sorted(map(tuple, maintenance.upsert(once, s, ["id"], ["v"]).collect())) == sorted(map(tuple, once.collect()))


def test_latest_keeps_nulls_of_the_newest_row(spark):
    df = spark.createDataFrame([(1, 1, "old"), (1, 2, None), (2, 5, "x")], "id int, ver int, v string")
    assert sorted(map(tuple, maintenance.latest_per_key(df, ["id"], ["ver"]).collect())) == [(1, 2, None), (2, 5, "x")]


def test_change_labels_and_apply(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, v string")
    new = spark.createDataFrame([(1, "a"), (2, "B"), (4, "d"), (3, None)], "id int, v string")
    diff = changes.diff_snapshots(old, new, "id")
    assert {r["id"]: r["action"] for r in diff.collect()} == {2: "UPDATE", 4: "INSERT"}
    back = changes.diff_snapshots(new, old, "id")
    assert {r["id"]: r["action"] for r in back.collect()} == {2: "UPDATE", 4: "DELETE"}
    staged = changes.stage_changes(diff, "id", "t")
    assert sorted(map(tuple, changes.apply_changes(old, staged, "id", "v string").collect())) == sorted(map(tuple, new.collect()))
    assert {r["sync_status"] for r in changes.mark_synced(staged, "2024-01-01 00:00:00").collect()} == {"SYNCED"}


def test_slices_and_swap(spark):
    df = spark.createDataFrame([("d1", "s", 1), ("d1", "q", 2), ("d2", "s", 3)], "doc string, src string, v int")
    new = spark.createDataFrame([("d1", "s", 9)], "doc string, src string, v int")
    assert sorted(r["v"] for r in maintenance.replace_slice(df, new, ["doc", "src"]).collect()) == [2, 3, 9]
    files.save(df, "live_t", "overwrite")
    files.save(new, "cand_t", "overwrite")
    files.save(new.select("v", "src", "doc"), "cand_t", "append")
    maintenance.swap_tables(spark, "live_t", "cand_t", "back_t")
    assert spark.table("live_t").count() == 2 and spark.table("back_t").count() == 3
    files.save(df.limit(0), "cand_t", "overwrite")
    with pytest.raises(ValueError):
        maintenance.swap_tables(spark, "live_t", "cand_t", "back_t")


def test_delimited_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,name,n\n1,"x, y",5\n2,NULL,bad\n3,None\n4,"q",7,extra\n')
    from pyspark.sql.types import StructType

    got = {r["id"]: (r["name"], r["n"]) for r in files.load_csv(spark, str(tmp_path / "a.csv"), StructType.fromDDL("id int, name string, n int")).collect()}
    assert got == {1: ("x, y", 5), 2: (None, None), 3: (None, None), 4: ("q", 7)}


def test_typed_projection_and_rejects(spark):
    df = spark.createDataFrame([("1", "2024-01-05"), ("x", "2024-01-05"), ("3", "no")], "a string, b string")
    spec = {"id": ("a", "int"), "day": ("b", "date")}
    assert sorted(map(tuple, files.project_typed(df, spec, ["id"]).collect()), key=str) == [(1, dt.date(2024, 1, 5)), (3, None)]
    assert [r["a"] for r in files.rejected(df, spec, ["id"]).collect()] == ["x"]


def test_incremental_skips_rows_already_copied(spark):
    rows = [(i, T0 + dt.timedelta(hours=i // 2)) for i in range(10)]
    src = spark.createDataFrame(rows, "id int, at timestamp_ntz")
    tgt = src.where("id < 5")
    assert sorted(r["id"] for r in incremental.incremental(src, tgt, "at", ["id"]).collect()) == [5, 6, 7, 8, 9]
    assert incremental.incremental(src, tgt.limit(0), "at", ["id"]).count() == 10


def test_uuid5(spark):
    import uuid

    ns = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"
    names = [f"OUT-{i}" for i in range(50)]
    df = incremental.with_uuid_key(spark.createDataFrame([(n,) for n in names], "n string"), ns, "n")
    assert {r["n"]: r["row_id"] for r in df.collect()} == {n: str(uuid.uuid5(uuid.UUID(ns), n)) for n in names}


def test_seed_only_when_empty(spark):
    df = spark.createDataFrame([(1,)], "v int")
    assert spines.seed_if_empty(df, [(9,)]).first()[0] == 1
    assert spines.seed_if_empty(df.limit(0), [(9,)]).first()[0] == 9


def test_clustered_layout_prunes(spark, tmp_path):
    df = spark.range(500).select(F.concat(F.lit("M"), F.col("id") % 7).alias("meter_id"), (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_interval(hours=(F.col("id") % 72).cast("int"))).alias("reading_ts"))
    files.write_clustered(df, str(tmp_path / "c"), "reading_ts", "meter_id", 2)
    back = spark.read.parquet(str(tmp_path / "c"))
    assert back.count() == 500
    plan = back.where("day = date'2024-01-02'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan


def test_stream_equals_batch_and_drops_late_rows(spark, tmp_path):
    schema = "meter_id string, reading_ts timestamp_ntz, usage_kwh double, voltage_v double"
    folder = tmp_path / "in"
    def put(name, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))

    first = [("m", T0 + dt.timedelta(minutes=5 * i), 1.0, 120.0) for i in range(60)]
    put("a", first)
    from pyspark.sql.types import StructType

    stream = jobs.stream_parquet(spark, str(folder), StructType.fromDDL(schema))
    got = {r["window_start"]: r["reading_count"] for r in jobs.drain(jobs.tumbling(stream), "t").collect()}
    newest = first[-1][1] - dt.timedelta(minutes=30)
    want = {T0 + dt.timedelta(minutes=15 * i): 3 for i in range(20) if T0 + dt.timedelta(minutes=15 * i + 15) <= newest}
    assert got == want
    late = jobs.late_split(spark.createDataFrame(first, schema), "reading_ts", "30 minutes")
    assert late.where("is_late").count() == sum(r[1] < newest for r in first)


def test_stateful_runs_across_batches(spark, tmp_path):
    schema = "transformer_id string, load_hour timestamp_ntz, load_factor_pct double"
    loads = [120, 130, 90, 101, 140, 150, 160, 100]
    folder = str(tmp_path / "in")
    for i in (0, 4):
        rows = [("t", T0 + dt.timedelta(hours=i + j), float(v)) for j, v in enumerate(loads[i:i + 4])]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        import time

        time.sleep(1.1)
    from pyspark.sql.types import StructType

    stream = jobs.stream_parquet(spark, folder, StructType.fromDDL(schema), files_per_batch=1)
    got = [r["consecutive_hours"] for r in jobs.drain(jobs.stress_runs(stream), "s").orderBy("load_hour").collect()]
    batch = load.consecutive_hours(spark.read.parquet(folder), F.col("load_factor_pct") > 100).orderBy("load_hour").collect()
    assert got == [1, 2, 0, 1, 2, 3, 4, 0] == [r["consecutive_hours"] for r in batch]


def test_broken_payloads_are_left_out(spark):
    raw = spark.createDataFrame([('{"meter_id":"m","reading_ts":"2024-01-01T00:00:00","usage_kwh":1.5}',), ("{oops",), (None,)], "body string")
    rows = landing.parse_readings(landing.land_json(raw, "body", "feed")).collect()
    assert len(rows) == 1 and rows[0]["usage_kwh"] == 1.5 and rows[0]["voltage_v"] is None


def test_semantic_model_joins_do_not_multiply(spark):
    facts = spark.createDataFrame([(1, "a", 2.0), (2, "a", 3.0), (3, "z", 4.0)], "id int, k string, v double")
    dims = spark.createDataFrame([("a", "A")], "k string, label string")
    model = Model.from_dict({
        "tables": [{"name": "f", "key": "id", "metrics": {"TOTAL": "sum(v)"}, "synonyms": {"amount": "TOTAL"}}, {"name": "d", "key": "k", "dimensions": {"LABEL": "label"}}],
        "relationships": [{"left": "f", "left_key": "k", "right": "d", "right_key": "k"}],
    })
    got = {r["label"]: r["total"] for r in model.query({"f": facts, "d": dims}, ["LABEL"], ["amount"], check_keys=True).collect()}
    assert got == {"A": 5.0, None: 4.0}
    with pytest.raises(ValueError):
        model.query({"f": facts, "d": dims.union(dims)}, ["LABEL"], ["TOTAL"], check_keys=True)
    assert [r.right for r in grid_model().join_path("readings", "substations")] == ["meters", "transformers", "substations"]
    assert LogicalTable("x", "k").metrics == {} and Relationship("a", "b", "c", "d").left == "a"


def test_backfill_stops_on_failure(spark, tmp_path):
    def build(day):
        if day == "d3":
            raise RuntimeError("boom")
        return spark.range(3)

    def gate(rows, day):
        return spark.createDataFrame([("FAIL" if day == "d2" else "PASS", "why")], "verdict string, reason string")

    log = [(r["day"], r["status"]) for r in backfill(spark, ["d1", "d2", "d3"], build, gate, str(tmp_path / "o")).collect()]
    assert log == [("d1", "PASS"), ("d2", "FAIL")]
    log = [(r["day"], r["status"]) for r in backfill(spark, ["d1", "d3", "d4"], build, gate, str(tmp_path / "p")).collect()]
    assert log == [("d1", "PASS"), ("d3", "ERROR")]
    log = [(r["day"], r["status"]) for r in backfill(spark, ["d1"], build, gate, str(tmp_path / "q"), dry_run=True).collect()]
    assert log == [("d1", "DRY_RUN")]


def test_expansion_has_no_orphans_and_respects_radii(spark):
    subs = spark.createDataFrame([("SUB-1", 29.7, -95.4), ("SUB-2", 29.9, -95.2)], "substation_id string, lat double, lon double")
    circuits = modelling.expand_circuits(subs)
    xfmr = modelling.expand_transformers(circuits)
    poles = modelling.expand_poles(xfmr)
    assert relations.orphans(xfmr, circuits, "circuit_id").count() == 0 and relations.orphans(poles, xfmr, "transformer_id").count() == 0
    assert xfmr.select("transformer_id").distinct().count() == xfmr.count()
    p = xfmr.select("transformer_id", F.col("lat").alias("a"), F.col("lon").alias("o"))
    far = poles.join(p, "transformer_id").agg(F.max(G.haversine(F.col("lat"), F.col("lon"), F.col("a"), F.col("o")))).first()[0]
    assert far < 0.33
    meters = spark.range(40).select(F.concat(F.lit("M"), "id").alias("meter_id"))
    linked = modelling.relink_meters(meters, poles)
    assert linked.count() == 40 and relations.orphans(linked, poles, "pole_id").count() == 0


def test_noise_is_repeatable(spark):
    m = spark.createDataFrame([("m1", "t1", 29.6, "HIGH_INCOME")], "meter_id string, transformer_id string, lat double, customer_class string")
    spine = spines.time_spine(spark, "2024-07-04 00:00:00", "2024-07-04 23:45:00")
    w = spark.createDataFrame([], "hour timestamp_ntz, temperature_f double, humidity_pct double")
    o = spark.createDataFrame([("t1", dt.datetime(2024, 7, 4, 3))], "transformer_id string, slot_ts timestamp_ntz")
    runs = [modelling.expected_load(modelling.personas(m), spine, w, o, ["2024-07-04"], noise=True).orderBy("reading_ts").collect() for _ in range(2)]
    assert runs[0] == runs[1] and len(runs[0]) == 96
    assert [r["quality"] for r in runs[0]].count("OUTAGE") == 1 and runs[0][12]["usage_kwh"] == 0.0


def test_chunk_gate_order(spark):
    m = spark.createDataFrame([("m", "t")], "meter_id string, transformer_id string")
    t = spark.createDataFrame([("t", 100.0)], "transformer_id string, rated_kva double")

    def verdict(rows, expected=1):
        return quality.validate_chunk(reading(spark, rows), m, t, "2024-01-01 00:00:00", "2024-01-01 23:45:00", expected).first()["reason"].split(":")[0]

    ok = ("m", T0, 1.0, 120.0, 0.9, "VALID")
    assert verdict([ok]) == "" and verdict([ok], 5) == "ROW_COUNT"
    assert verdict([("x",) + ok[1:]]) == "FK_ORPHANS"
    assert verdict([("m", T0, 99.0, 120.0, 0.9, "VALID")]) == "CAPACITY_BREACH"
    assert verdict([("m", T0 + dt.timedelta(minutes=1), 1.0, 120.0, 0.9, "VALID")]) == "TIMESTAMP_GRID"
    assert verdict([("m", T0, 1.0, 100.0, 0.9, "VALID")]) == "VOLTAGE_BAND" and verdict([("m", T0, 1.0, 120.0, 0.5, "VALID")]) == "POWER_FACTOR"


def test_strict_extremes_and_filters(spark):
    df = spark.createDataFrame([(1.0, None), (1.0, 2.0)], "a double, b double")
    got = df.select(rules.strict_greatest(F.col("a"), F.col("b")).alias("g"), rules.strict_least(F.col("a"), F.col("b")).alias("l")).collect()
    assert [tuple(r) for r in got] == [(None, None), (2.0, 1.0)]
    assert all(callable(f) for f in rules.FILTERS.values())


def test_split_is_stable(spark):
    ids = spark.range(2000).select(F.col("id").cast("string").alias("k"))
    a = {r["k"]: r["p"] for r in ids.select("k", learning.split_label("k").alias("p")).collect()}
    b = {r["k"]: r["p"] for r in ids.repartition(13).select("k", learning.split_label("k").alias("p")).collect()}
    share = sum(v == "train" for v in a.values()) / len(a)
    assert a == b and 0.76 < share < 0.84


def test_backfill_over_the_readings_fails_on_overload(spark):
    from wattline.plans.model_queries import chunked_backfill_span
    from wattline.sources.derived import GridTables

    class Few(GridTables):
        rated = 1e9

        @property
        def readings(self):
            return super().readings.where("reading_ts >= '2024-01-08' AND reading_ts < '2024-01-10'")

        @property
        def transformers(self):
            return super().transformers.withColumn("rated_kva", F.lit(self.rated))

    g = Few(spark, "/root/testdata/sf0.001")
    assert [(r.day, r.passed) for r in chunked_backfill_span(g).collect()] == [("2024-01-08", True), ("2024-01-09", True)]
    g.rated = 0.001
    assert [(r.day, r.passed) for r in chunked_backfill_span(g).collect()] == [("2024-01-08", False)]


def test_scoring_takes_the_newest_day_or_the_newest_rows(spark):
    rows = spark.createDataFrame([(f"T{i}", dt.date(2024, 1, 1 + i % 3), 50.0, 0.5 + i / 100, 1.0) for i in range(12)], "transformer_id string, pair_date date, morning_load_pct double, risk_probability double, prediction double")
    assert [r.transformer_id for r in learning.latest_high_risk(rows).collect()] == ["T11", "T8", "T5", "T2"]
    older = rows.withColumn("pair_date", F.date_sub("pair_date", 1))
    newest = learning.newest_pairs(rows.unionByName(older)).select("transformer_id", "pair_date").collect()
    assert sorted(map(tuple, newest)) == sorted((f"T{i}", dt.date(2024, 1, 1 + i % 3)) for i in range(12))


def test_long_expansions_are_dealt_over_all_tasks(spark):
    """Few meters in one partition become many rows: all tasks get some."""
    from wattline.operators import modelling
    from wattline.sources.spines import time_spine

    meters = spark.range(400).select(F.concat(F.lit("M"), "id").alias("meter_id"), F.lit("RESIDENTIAL").alias("meter_type")).coalesce(1)
    rows = modelling.simple_load(meters, time_spine(spark, "2024-01-06 00:00:00", "2024-01-06 23:45:00"))
    counts = [r["n"] for r in rows.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(counts) == 400 * 96 and max(counts) < 400 * 96 / 4


def test_an_outage_is_written_out_a_few_times(spark):
    outs = spark.sql("SELECT 'T' AS transformer_id, timestamp_ntz'2024-01-01 05:59:00' AS start_ts, timestamp_ntz'2024-01-01 16:00:00' AS end_ts, 'X' AS cause")
    parts = [str(r["_part"]) for r in outages.part_spans(outs, ["transformer_id", "cause"]).orderBy("_part").collect()]
    assert parts == ["2024-01-01 00:00:00", "2024-01-01 06:00:00", "2024-01-01 12:00:00"]


def test_only_outages_of_a_day_are_written_out(spark):
    spans = [("a", "2023-12-31 23:00:00", "2024-01-01 00:00:00"), ("b", "2024-01-01 23:50:00", "2024-01-05 00:00:00"), ("c", "2024-01-02 00:00:00", "2024-01-02 01:00:00"), ("d", None, None)]
    outs = spark.createDataFrame(spans, "transformer_id string, start_ts string, end_ts string").selectExpr("transformer_id", "cast(start_ts as timestamp_ntz) AS start_ts", "cast(end_ts as timestamp_ntz) AS end_ts")
    assert sorted(r[0] for r in outages.touching(outs, "2024-01-01").collect()) == ["a", "b"]

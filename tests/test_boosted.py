"""The boosted classifier: its rows are built once, dealt evenly, and its table of trees is walked by plain expressions."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from wattline.operators import learning
from wattline.plans import model_queries

PAIR = (
    "transformer_id string, pair_date date, morning_load_pct double, morning_load_kw double, afternoon_load_pct double, historical_avg_load double, "
    "rated_kva bigint, age_years bigint, manufacturer string, active_meters bigint, stress_vs_historical double, afternoon_is_high_risk int"
)


def some_pairs(n=300):
    rnd = random.Random(5)
    out = []
    for i in range(n):
        late = rnd.uniform(20, 180)
        out.append((f"XF-{i % 120:06d}", dt.date(2024, 1, 1 + i // 120), late * rnd.uniform(0.6, 1.2), rnd.uniform(1, 90), late, rnd.uniform(40, 120), rnd.randint(1, 50), rnd.randint(1, 54), f"Brand#{i % 5}", i % 3, rnd.uniform(-50, 50), int(late >= 100)))
    return out


@pytest.mark.parametrize("query", ["boosted_classifier", "batch_scoring"])
def test_pairs_are_built_once_for_the_fit_and_all_that_is_scored(spark, tmp_path, monkeypatch, query):
    seen = tmp_path / "built"
    seen.mkdir()
    folder = str(seen)

    def mark(batches):
        import tempfile

        tempfile.mkstemp(dir=folder)
        yield from batches

    rows = spark.createDataFrame(some_pairs(), PAIR).coalesce(1).mapInArrow(mark, PAIR)
    monkeypatch.setattr(model_queries, "pairs", lambda g: rows)
    monkeypatch.setitem(learning.CONFIGS, "high_precision", {**learning.CONFIGS["high_precision"], "maxIter": 2})
    got = [tuple(r) for r in getattr(model_queries, query)(None).collect()]
    assert len(list(seen.iterdir())) == 1
    assert all(same and fits for _, _, same, fits in got)
    held_out = {r["transformer_id"] for r in rows.where(learning.split_label("transformer_id") == "test").collect()}
    newest = {}
    for t, day, *_ in some_pairs():
        newest[t] = max(day, newest.get(t, day))
    expected = {(t, day) for t, day, *_ in some_pairs() if t in held_out} if query == "boosted_classifier" else set(newest.items())
    assert sorted((t, day) for t, day, _, _ in got) == sorted(expected)


def test_rounds_get_full_waves_of_tasks():
    assert [learning.tasks_of_rounds(n, 12) for n in (0, 19_999, 20_000, 219_999, 240_000, 12_000_000, 12_000_001, 42_000_000)] == [1, 1, 2, 11, 12, 12, 24, 48]


def test_training_rows_of_one_partition_are_dealt_to_all_tasks(spark, monkeypatch):
    """Rows of one file would leave every level of every round to one task."""
    monkeypatch.setattr(learning.tasks_of_rounds, "__defaults__", (20, 1_000_000))
    parts = []
    fit = learning.Pipeline.fit
    monkeypatch.setattr(learning.Pipeline, "fit", lambda self, rows: (parts.append([r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]), fit(self, rows))[1])
    learning.train(spark.createDataFrame(some_pairs(), PAIR).coalesce(1), "high_precision", max_iter=1)
    width = spark.sparkContext.defaultParallelism
    assert sum(parts[0]) == 300 and len(parts[0]) > width / 2 and max(parts[0]) < 300 / 2


def leaf(value):
    return (-1, -1, [], -1, -1, value)


def numbered(nodes):
    return [(i, *n) for i, n in enumerate(nodes)]


def test_every_row_walks_every_tree(spark):
    """Thresholds, sets of categories, and trees that end before the deepest one."""
    trees = [
        (0, 1.0, numbered([(0, -1, [0.5], 1, 2, 0.0), leaf(-0.25), (1, 3, [0.0, 2.0], 3, 4, 0.0), (0, -1, [2.0], 5, 6, 0.0), leaf(0.5), leaf(0.125), leaf(-1.0)])),
        (1, 0.05, numbered([(1, 3, [1.0], 1, 2, 0.0), leaf(3.0), leaf(-2.0)])),
        (2, 0.05, numbered([leaf(0.75)])),
    ]
    node = "struct<id: int, feature: int, categories: int, left_if: array<double>, left: int, right: int, value: double>"
    table = spark.createDataFrame([(t, w, 3, n) for t, w, n in trees], f"tree int, weight double, depth int, nodes array<{node}>")
    rows = [(f"r{i}", None if i == 5 else i, [x, c]) for i, (x, c) in enumerate((x, c) for x in (0.0, 0.5, 1.0, 2.0, 3.0) for c in (0.0, 1.0, 2.0))]

    def margin(f):
        total = 0.0
        for _, weight, nodes in trees:
            at = 0
            while nodes[at][4] >= 0:
                _, feature, categories, left_if, left, right, _ = nodes[at]
                at = left if (f[feature] <= left_if[0] if categories < 0 else f[feature] in left_if) else right
            total += weight * nodes[at][6]
        return total

    scored = learning.score_by_trees(spark.createDataFrame(rows, "k string, n int, f array<double>"), "f", table, ["k", "n"])
    got = {(r["k"], r["n"]): r["risk_probability"] for r in scored.collect()}
    assert set(got) == {(k, n) for k, n, _ in rows}
    assert all(abs(got[k, n] - 1 / (1 + math.exp(-2 * margin(f)))) < 1e-12 for k, n, f in rows)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan and "Generate" not in plan

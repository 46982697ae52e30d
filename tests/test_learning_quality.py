"""Rounds and sums behind the learned queries, fused quality checks, backfill that keeps going."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattline.operators import learning, quality
from wattline.plans.backfill import backfill


def test_least_squares_equals_a_matrix_solution(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 3)) * [1.0, 1000.0, 1e-3] + [0.0, 1e6, 5.0]
    y = x @ [2.0, -0.5, 30.0] + 7 + rng.normal(size=500)
    rows = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y)] + [(None, 1.0, 1.0, 1.0)], "a double, b double, c double, y double")
    slope, intercept = learning.least_squares(rows, ["a", "b", "c"], "y")
    exact = np.linalg.lstsq(np.column_stack([x - x.mean(0), np.ones(500)]), y, rcond=None)[0]
    assert np.allclose(slope, exact[:3], rtol=1e-6) and np.isclose(intercept, exact[3] - exact[:3] @ x.mean(0), rtol=1e-6)


def test_least_squares_of_nothing_and_of_a_constant(spark):
    rows = spark.createDataFrame([], "a double, y double")
    assert learning.least_squares(rows, ["a"], "y") == ([0.0], 0.0)
    same = spark.createDataFrame([(2.0, 1.0), (2.0, 3.0)], "a double, y double")
    assert learning.least_squares(same, ["a"], "y") == ([0.0], 2.0)


@pytest.mark.parametrize("k", [3, 9])
def test_clusters_equal_plain_rounds(spark, k):
    rng = random.Random(k)
    rows = [(f"m{i}", rng.gauss(i % 3 * 5, 1), rng.gauss(i % 2, 0.5)) for i in range(70)] + [("null", None, 1.0)]
    got = {r["m"]: r["cluster"] for r in learning.usage_clusters(spark.createDataFrame(rows, "m string, a double, b double").repartition(7), "m", ["a", "b"], k, 6).collect()}
    x = np.array([r[1:] for r in rows[:-1]])
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    first = sorted(range(len(z)), key=lambda i: (hashlib.md5(rows[i][0].encode()).hexdigest(), rows[i][0]))[:k]
    centres = z[first].copy()
    for _ in range(6):
        at = ((z[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        for c in range(k):
            if (at == c).any():
                centres[c] = z[at == c].mean(0)
    at = ((z[:, None] - centres[None]) ** 2).sum(2).argmin(1)
    assert got == {rows[i][0]: int(c) for i, c in enumerate(at)}


def test_checks_of_a_table_share_one_scan(spark, tmp_path):
    rows = [(1, 29.0, -95.0, "a"), (2, None, -95.0, "b"), (3, 50.0, -95.0, None), (4, 29.5, -95.5, "zz")]
    spark.createDataFrame(rows, "id int, lat double, lon double, p string").write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    parents = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "p string")
    checks = quality.TableChecks("t", table).position().reference("t -> p", parents, "p").reference("t -> p, if any", parents, "p", nullable=True).rule("small", "id", F.col("id") < 2)
    out = checks.rows()
    got = {r["detail"]: (r["check_name"], r["measured"], r["status"]) for r in out.collect()}
    assert got == {"t": ("coordinate_validity", 2.0, "FAIL"), "t -> p": ("referential_integrity", 2.0, "FAIL"), "t -> p, if any": ("referential_integrity", 1.0, "FAIL"), "id": ("small", 1.0, "FAIL")}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("parquet") == 1


def test_contracts_read_rows(spark):
    view = spark.createDataFrame([(1, None), (2, 3.0)], "a int, b double")
    got = quality.check_contract({"v": (view, ["a", "b", "c"]), "w": (view, ["a"]), "x": (view, ["b"])}).collect()
    assert [(r["detail"], r["missing"], r["row_count"], r["null_rows"], r["status"]) for r in got] == [("v", "c", 2, 1, "FAIL"), ("w", "", 2, 0, "PASS"), ("x", "", 2, 1, "FAIL")]


def test_backfill_can_go_on_after_a_failed_day(spark, tmp_path):
    gate = lambda rows, day: spark.createDataFrame([("FAIL" if day == "d1" else "PASS", "")], "verdict string, reason string")
    log = backfill(spark, ["d1", "d2"], lambda day: spark.range(3), gate, str(tmp_path / "o"), keep_going=True)
    assert [(r["day"], r["status"], r["row_count"]) for r in log.collect()] == [("d1", "FAIL", 3), ("d2", "PASS", 3)]

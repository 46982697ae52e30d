"""Training pairs, pipelines, scoring, evaluation and logs on pyspark.ml."""

from __future__ import annotations

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from wattline.functions.calendar import day_of_week
from wattline.functions.hashing import uniform
from wattline.operators.anchors import topk
from wattline.session import cut, scratch_path


def split_label(key: str, train_share: float = 0.8, seed: int = 42) -> Column:
    """train / test by a hash of the key: the same rows whatever the partitioning."""
    return F.when(uniform(F.concat(F.col(key).cast("string"), F.lit(str(seed)))) < train_share, "train").otherwise("test")


def training_pairs(hourly: DataFrame, transformers: DataFrame, morning: tuple[int, int], afternoon: tuple[int, int], meters: DataFrame | None = None) -> DataFrame:
    """Morning state and afternoon outcome per transformer-day.

    Both slices are combined to one row per transformer-day before they meet; the history is the transformer's own
    mean over the data.
    """
    h, day = F.hour("load_hour"), F.to_date("load_hour").alias("pair_date")
    early = hourly.where(h.between(*morning)).groupBy("transformer_id", day).agg(F.avg("load_factor_pct").alias("morning_load_pct"), F.max("load_kw").alias("morning_load_kw"))
    late = hourly.where(h.between(*afternoon)).groupBy("transformer_id", day).agg(F.max("load_factor_pct").alias("afternoon_load_pct"))
    past = hourly.groupBy("transformer_id").agg(F.avg("load_factor_pct").alias("historical_avg_load"))
    out = early.join(late, ["transformer_id", "pair_date"]).join(past, "transformer_id")
    out = out.join(transformers.select("transformer_id", "rated_kva", "age_years", "manufacturer"), "transformer_id")
    if meters is not None:
        n = meters.groupBy("transformer_id").agg(F.count(F.lit(1)).alias("active_meters"))
        out = out.join(n, "transformer_id", "left").withColumn("active_meters", F.coalesce("active_meters", F.lit(0)))
    gap = (F.col("morning_load_pct") - F.col("historical_avg_load")) / F.nullif("historical_avg_load", F.lit(0.0)) * 100.0
    return out.withColumns({"stress_vs_historical": gap, "afternoon_is_high_risk": F.when(F.col("afternoon_load_pct") >= 100, 1).otherwise(0)})


def transitions(pairs: DataFrame) -> DataFrame:
    m = F.col("morning_load_pct")
    state = F.when(m >= 100, "Already High-Risk").when(m >= 90, "Borderline (90-100%)").when(m >= 70, "Moderate (70-90%)").otherwise("Low (<70%)")
    return pairs.groupBy(state.alias("morning_state")).agg(
        F.count(F.lit(1)).alias("total"), F.sum("afternoon_is_high_risk").alias("became_high_risk"),
        F.round(F.avg("afternoon_is_high_risk") * 100.0, 2).alias("transition_rate_pct"),
    )


NUMERIC = ["morning_load_pct", "morning_load_kw", "historical_avg_load", "rated_kva", "age_years", "active_meters", "stress_vs_historical"]
CATEGORY = "manufacturer"

# The three model settings.
CONFIGS = {
    "high_recall": {"maxIter": 150, "maxDepth": 8, "stepSize": 0.1, "positive_weight": 12.0},
    "balanced": {"maxIter": 100, "maxDepth": 6, "stepSize": 0.1, "positive_weight": 8.0},
    "high_precision": {"maxIter": 100, "maxDepth": 5, "stepSize": 0.05, "positive_weight": 4.0},
}


def feature_stages(numeric: list[str], category: str) -> list:
    """Impute, scale and one-hot stages; a pipeline fits them on the training rows only."""
    filled = [f"{c}_f" for c in numeric]
    return [
        Imputer(inputCols=numeric, outputCols=filled),
        VectorAssembler(inputCols=filled, outputCol="numeric_raw"),
        StandardScaler(inputCol="numeric_raw", outputCol="numeric_scaled", withMean=True),
        StringIndexer(inputCol=category, outputCol="category_index", handleInvalid="keep"),
        OneHotEncoder(inputCols=["category_index"], outputCols=["category_vec"]),
        VectorAssembler(inputCols=["numeric_scaled", "category_vec"], outputCol="features"),
    ]


def _typed(pairs: DataFrame, numeric: list[str]) -> DataFrame:
    return pairs.withColumns({c: F.col(c).cast("double") for c in numeric})


def scale_encode(pairs: DataFrame, numeric: list[str] = NUMERIC, category: str = CATEGORY) -> PipelineModel:
    return Pipeline(stages=feature_stages(numeric, category)).fit(_typed(pairs, numeric))


def stored(pairs: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder: a fit and what is scored after it read them many times, and build them once."""
    path = scratch_path(pairs.sparkSession, "pairs")
    pairs.write.parquet(path)
    return pairs.sparkSession.read.parquet(path)


def tasks_of_rounds(rows: int, cores: int, least: int = 20_000, most: int = 1_000_000) -> int:
    """Tasks for rows that hundreds of short jobs go over: full waves of all cores, none above ``most`` rows; fewer where a core would get less than ``least``."""
    few = rows // least + 1
    return few if few < cores else cores * -(-rows // (cores * most))


def train(pairs: DataFrame, config: str = "balanced", label: str = "afternoon_is_high_risk", max_iter: int | None = None) -> PipelineModel:
    """All rows fitted; they are dealt evenly and kept on disk meanwhile, since every stage reads them and every round has a job per level."""
    c = CONFIGS[config]
    rows = _typed(pairs, NUMERIC).withColumn("_w", F.when(F.col(label) == 1, c["positive_weight"]).otherwise(1.0)).withColumn(label, F.col(label).cast("double"))
    tree = GBTClassifier(featuresCol="features", labelCol=label, weightCol="_w", maxIter=max_iter or c["maxIter"], maxDepth=c["maxDepth"], stepSize=c["stepSize"], seed=42)
    tasks = tasks_of_rounds(rows.count(), rows.sparkSession.sparkContext.defaultParallelism)
    held = rows.repartition(tasks, *rows.columns).persist(StorageLevel.DISK_ONLY)
    try:
        return Pipeline(stages=feature_stages(NUMERIC, CATEGORY) + [tree]).fit(held)
    finally:
        held.unpersist()


def score(model: PipelineModel, pairs: DataFrame) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    out = model.transform(_typed(pairs, NUMERIC))
    return out.withColumn("risk_probability", vector_to_array("probability")[1])


def tree_table(model: PipelineModel) -> DataFrame:
    """The fitted trees as a table: (tree, weight, depth, nodes), ``nodes`` by number with feature, threshold or categories, children and value.

    This is the form in which Spark stores the classifier; what reads it needs no model and no library.
    """
    trees = model.stages[-1]
    spark = SparkSession.active()
    path = scratch_path(spark, "trees")
    trees.write().save(path)
    data = spark.read.parquet(f"{path}/data").selectExpr("treeID AS tree", "nodeData.*")
    node = F.struct(
        "id", F.col("split.featureIndex").alias("feature"), F.col("split.numCategories").alias("categories"), F.col("split.leftCategoriesOrThreshold").alias("left_if"),
        F.col("leftChild").alias("left"), F.col("rightChild").alias("right"), F.col("prediction").alias("value"),
    )
    weights = spark.read.parquet(f"{path}/treesMetadata").select(F.col("_1").alias("tree"), F.col("_3").alias("weight"))
    nodes = data.groupBy("tree").agg(F.sort_array(F.collect_list(node)).alias("nodes"))  # a tree has at most 2^(depth + 1) nodes
    return nodes.join(weights, "tree").withColumn("depth", F.lit(trees.getMaxDepth()))


#: One step of a walk from node ``at``; at a leaf it stays.
_STEP = """CASE
    WHEN nodes[at].left < 0 THEN at
    WHEN nodes[at].categories < 0 THEN IF(f[nodes[at].feature] <= nodes[at].left_if[0], nodes[at].left, nodes[at].right)
    ELSE IF(array_contains(nodes[at].left_if, f[nodes[at].feature]), nodes[at].left, nodes[at].right) END"""


def score_by_trees(rows: DataFrame, features: str, trees: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, risk_probability) by a join with the table of trees: every row walks every tree, and the leaves' weighted values are added.

    ``features`` is an array column. The table is as large as the model, so it is sent along; rows are not moved before the sums. Each
    level is a column of its own: plain expressions are compiled with the join and the sums, and no node is copied.
    """
    deepest = trees.agg(F.max("depth")).first()[0] or 0
    each = rows.select(*keys, F.col(features).alias("f")).crossJoin(F.broadcast(trees)).withColumn("at", F.lit(0))
    for _ in range(deepest):
        each = each.withColumn("at", F.expr(_STEP))
    leaves = each.selectExpr(*keys, "weight * nodes[at].value AS part")
    margin = leaves.groupBy(*keys).agg(F.sum("part").alias("margin"))
    return margin.select(*keys, (1 / (1 + F.exp(-2 * F.col("margin")))).alias("risk_probability"))


def newest_pairs(pairs: DataFrame) -> DataFrame:
    """The newest row of every transformer."""
    newest = pairs.groupBy("transformer_id").agg(F.max("pair_date").alias("pair_date"))
    return pairs.join(newest, ["transformer_id", "pair_date"], "left_semi")


def latest_high_risk(scored: DataFrame, n: int = 20, days: int = 1) -> DataFrame:
    """Predicted risks of the newest days, highest first."""
    newest = scored.agg(F.max("pair_date")).scalar()
    rows = scored.where((F.col("pair_date") > F.date_sub(newest, days)) & (F.col("prediction") == 1)).select("transformer_id", "pair_date", "morning_load_pct", "risk_probability")
    return topk(rows, [F.col("risk_probability").desc(), F.col("transformer_id").asc()], n)


def confusion(pred: DataFrame, label: str, prediction: str) -> DataFrame:
    """One aggregate over the predictions: counts and the derived rates."""
    y, p = F.col(label).cast("int"), F.col(prediction).cast("int")

    def n(a, b):
        return F.sum(F.when((y == a) & (p == b), 1).otherwise(0))

    row = pred.agg(n(1, 1).alias("tp"), n(0, 1).alias("fp"), n(1, 0).alias("fn"), n(0, 0).alias("tn"))
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    precision, recall = tp / F.nullif(tp + fp, F.lit(0.0)), tp / F.nullif(tp + fn, F.lit(0.0))
    return row.select(
        "tp", "fp", "fn", "tn", ((tp + tn) / (tp + fp + fn + tn)).alias("accuracy"), precision.alias("precision"), recall.alias("recall"),
        (2 * precision * recall / F.nullif(precision + recall, F.lit(0.0))).alias("f1"),
    )


def area_metrics(scored: DataFrame, label: str) -> dict[str, float]:
    """AUC and average precision."""
    rows = scored.withColumn(label, F.col(label).cast("double"))
    return {
        name: BinaryClassificationEvaluator(labelCol=label, metricName=name).evaluate(rows) for name in ("areaUnderROC", "areaUnderPR")
    }


def compare_runs(runs: DataFrame) -> DataFrame:
    """Best run by F1, by recall and by precision (run, precision, recall, f1)."""
    best = [
        F.max_by("run", F.struct(F.coalesce(m, F.lit(-1.0)), "run")).alias(f"best_{m}") for m in ("f1", "recall", "precision")
    ]
    return runs.agg(*best)


def usage_clusters(features: DataFrame, key: str, cols: list[str], k: int = 4, rounds: int = 10) -> DataFrame:
    """Lloyd rounds on standardised columns, each one aggregate; starts from the rows whose keys have the ``k`` least md5 digests.

    The driver holds ``k`` centres. Rows with a null value take no part; a row goes to the nearest centre, the first of equals; a centre
    without rows stays.
    """
    rows = features.dropna(subset=cols)
    row = rows.agg(*[f(c).alias(f"{n}_{c}") for c in cols for n, f in (("m", F.avg), ("s", F.stddev_samp))]).first()
    z = rows.withColumns({f"_z{i}": (F.col(c) - F.lit(row[f"m_{c}"])) / F.lit(row[f"s_{c}"] or 1.0) for i, c in enumerate(cols)})
    z = cut(z)
    names = [f"_z{i}" for i in range(len(cols))]
    first = z.orderBy(F.md5(F.col(key).cast("string")), key).limit(k).select(*names).collect()
    centres = [list(r) for r in first]

    def nearest():
        far = F.array(*[sum(((F.col(n) - F.lit(x)) * (F.col(n) - F.lit(x)) for n, x in zip(names, c)), F.lit(0.0)) for c in centres])
        return F.array_position(far, F.array_min(far)).cast("int") - 1

    for _ in range(rounds if centres else 0):
        for r in z.groupBy(nearest().alias("c")).agg(*[F.avg(n).alias(n) for n in names]).collect():  # k rows
            centres[r["c"]] = [r[n] for n in names]
    return z.withColumn("cluster", nearest() if centres else F.lit(None).cast("int")).drop(*names)


def least_squares(rows: DataFrame, features: list[str], label: str) -> tuple[list[float], float]:
    """(coefficients, intercept) from one aggregate of means and covariances; a feature that others explain gets the least norm."""
    means = [F.avg(c).alias(f"m{i}") for i, c in enumerate([*features, label])]
    products = [F.covar_pop(a, b).alias(f"c{i}_{j}") for i, a in enumerate(features) for j, b in enumerate([*features, label]) if j >= i]
    r = rows.dropna(subset=[*features, label]).agg(*means, *products).first()
    p = len(features)
    if r["m0"] is None:
        return [0.0] * p, 0.0
    c = np.array([[r[f"c{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)])
    slope = np.linalg.lstsq(c, np.array([r[f"c{i}_{p}"] for i in range(p)]), rcond=None)[0]
    return slope.tolist(), float(r[f"m{p}"] - sum(x * r[f"m{i}"] for i, x in enumerate(slope)))


def seasonal_naive(hourly: DataFrame, key: str, horizon: int = 168) -> DataFrame:
    """Forecast for the hours after the data: the value one week earlier, where there is one."""
    last = hourly.agg(F.max("hour")).scalar()
    shifted = hourly.select(key, (F.col("hour") + F.expr("interval 168 hours")).cast("timestamp_ntz").alias("hour"), F.col("value").alias("forecast"))
    ahead = shifted.withColumn("_last", last)
    limit = F.col("_last") + F.make_interval(hours=F.lit(horizon))
    return ahead.where((F.col("hour") > F.col("_last")) & (F.col("hour") <= limit)).drop("_last")


LAGGED = ["lag_168h", "sin_h", "cos_h", "dow"]


def with_lag(hourly: DataFrame, key: str) -> DataFrame:
    """Hours with the value a week before, the hour as a point on a circle and the day of the week."""
    lagged = hourly.select(key, (F.col("hour") + F.expr("interval 168 hours")).cast("timestamp_ntz").alias("hour"), F.col("value").alias("lag_168h"))
    angle = F.hour("hour") * F.lit(2.0) * F.pi() / 24.0
    return hourly.join(lagged, [key, "hour"]).withColumns({"sin_h": F.sin(angle), "cos_h": F.cos(angle), "dow": day_of_week(F.col("hour")).cast("double")})


def linear_forecast(hourly: DataFrame, key: str) -> DataFrame:
    """One linear model on weekly lag and calendar columns for all keys; fitted values with the actual ones."""
    rows = with_lag(hourly, key)
    slope, intercept = least_squares(rows, LAGGED, "value")
    fitted = sum((F.col(c) * F.lit(x) for c, x in zip(LAGGED, slope)), F.lit(intercept))
    return rows.select(key, "hour", "value", fitted.alias("forecast"))


def forecast_error(rows: DataFrame, actual: str = "value", forecast: str = "forecast") -> DataFrame:
    e = F.col(forecast) - F.col(actual)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"))


def forecast_accuracy(rows: DataFrame, ts_col: str, actual: str, forecast: str, days: int = 7) -> DataFrame:
    """Absolute percentage error per row over the trailing days."""
    last = rows.agg(F.max(ts_col)).scalar()
    ape = F.abs(F.col(forecast) - F.col(actual)) / F.nullif(F.col(actual), F.lit(0.0)) * 100.0
    return rows.where(F.col(ts_col) >= last - F.expr(f"interval {days} days")).withColumn("ape_pct", ape)


def production_models(catalog: DataFrame) -> DataFrame:
    return catalog.where(F.col("status") == "PRODUCTION").withColumn("primary_metric", F.coalesce("accuracy", "auc", F.lit(1.0) - F.col("rmse") / 1000.0))


def log_run(spark, run: str, config: dict, metrics: dict, at: str) -> DataFrame:
    """One registry row with hyperparameters and metrics as JSON; append it to the run log."""
    import json

    return spark.createDataFrame([(run, json.dumps(config, sort_keys=True), json.dumps(metrics, sort_keys=True), at)], "run string, hyperparameters string, metrics string, logged_at string")


def log_predictions(scored: DataFrame, model: str, version: str, at: str) -> DataFrame:
    return scored.select(
        F.lit(model).alias("model_name"), F.lit(version).alias("model_version"), F.col("transformer_id").alias("entity_id"), "risk_probability", F.col("prediction").cast("int").alias("predicted_label"),
        F.lit(at).cast("timestamp_ntz").alias("predicted_at"),
    )


def moving_range(hourly: DataFrame, key: str) -> DataFrame:
    """Hour-to-hour change per key on rows that are unique per (key, hour)."""
    w = Window.partitionBy(key).orderBy("hour")
    return hourly.withColumn("change", F.col("value") - F.lag("value").over(w))

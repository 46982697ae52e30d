"""Transformers and other assets: derived columns, scorecards, risk and rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wattline.functions import rules
from wattline.operators.anchors import share, topk
from wattline.operators.load import with_stress


def age_years(df: DataFrame, as_of: str) -> DataFrame:
    return df.withColumn("age_years", F.year(F.lit(as_of).cast("date")) - F.col("install_year"))


def derive_transformer(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "location_area": rules.location_area(F.col("lat"), F.col("lon")),
            "feeder_id": F.concat(F.lit("FEEDER-"), F.coalesce(F.right("circuit_id", F.lit(3)), F.lit("000"))),
            "load_serving_class": rules.load_serving_class(F.col("load_utilization_pct")),
        }
    )


def equipment_scorecard(df: DataFrame) -> DataFrame:
    h, load = F.col("health_score"), F.col("load_utilization_pct")
    return df.where(h.isNotNull()).select(
        "transformer_id",
        "health_score",
        "load_utilization_pct",
        rules.health_category(h).alias("health_category"),
        F.coalesce((h < 50) & (load > 80), F.lit(False)).alias("requires_attention"),
    )


def replacement_priority(df: DataFrame, n: int = 100) -> DataFrame:
    h, age = F.col("health_score"), F.col("age_years")
    rows = df.where((h < 70) | (age > 35)).select(
        "transformer_id", "substation_id", "rated_kva", "age_years", "health_score",
        rules.replacement_priority(h, age).alias("replacement_priority"),
    )
    rank = case_rank("replacement_priority", ["URGENT", "HIGH", "MEDIUM"])
    return topk(rows, [rank.asc(), F.col("health_score").asc_nulls_last(), F.col("transformer_id").asc()], n)


def case_rank(col: str, labels: list[str]) -> Column:
    """Sort rank of a label: its place in the list, unknown labels last."""
    out = None
    for i, label in enumerate(labels, 1):
        test = F.col(col) == label
        out = F.when(test, i) if out is None else out.when(test, i)
    return out.otherwise(len(labels) + 1)


def anonymize_assets(df: DataFrame, salt: str = "") -> DataFrame:
    return df.select(
        F.sha2(F.concat(F.col("transformer_id"), F.lit(salt)), 256).alias("asset_hash"),
        rules.location_area(F.col("lat"), F.col("lon")).alias("location_area"),
        "rated_kva",
        "health_score",
        F.trunc(F.make_date("install_year", F.lit(1) + F.col("k") % 12, F.lit(15)), "MM").alias("install_month"),
    )


def load_status(df: DataFrame) -> DataFrame:
    return df.withColumn("load_status", rules.load_status(F.col("load_utilization_pct")))


def at_risk(df: DataFrame, threshold: float = 50, n: int = 500) -> DataFrame:
    rows = df.where(F.col("health_score") < threshold).select("transformer_id", "lat", "lon", "health_score", "load_utilization_pct")
    return topk(rows, [F.col("health_score").asc_nulls_last(), F.col("transformer_id").asc()], n)


def fleet_overview(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("total_transformers"),
        F.avg("age_years").alias("avg_age"),
        F.avg("health_score").alias("avg_health"),
        (F.sum("rated_kva") / 1000).alias("total_capacity_mva"),
    )


def fleet_by_role(df: DataFrame) -> DataFrame:
    return df.groupBy("role").agg(
        F.count(F.lit(1)).alias("transformer_count"),
        F.avg("age_years").alias("avg_age"),
        F.avg("health_score").alias("avg_health"),
        F.sum("rated_kva").alias("total_kva"),
    )


def health_distribution(df: DataFrame) -> DataFrame:
    counts = df.groupBy(rules.health_category(F.col("health_score")).alias("health_category")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("age_years").alias("avg_age")
    )
    return counts.select("health_category", F.col("n").alias("transformer_count"), "avg_age", share(counts).alias("pct"))


def class_share(customers: DataFrame) -> DataFrame:
    counts = customers.groupBy("segment").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("segment", F.col("n").alias("customer_count"), share(counts).alias("pct"))


def age_buckets(df: DataFrame) -> DataFrame:
    return df.groupBy(rules.age_bucket(F.col("age_years")).alias("age_bucket")).agg(
        F.count(F.lit(1)).alias("transformer_count"), F.avg("health_score").alias("avg_health")
    )


def aging_summary(df: DataFrame, years: int = 35) -> DataFrame:
    return df.where(F.col("age_years") > years).agg(
        F.count(F.lit(1)).alias("aging_transformers"), F.avg("health_score").alias("avg_health")
    )


def _hour_stats(hourly: DataFrame) -> DataFrame:
    return (
        with_stress(hourly)
        .groupBy("transformer_id")
        .agg(
            F.avg("load_factor_pct").alias("avg_load_pct"),
            F.max("load_factor_pct").alias("peak_load_pct"),
            F.sum(F.when(F.col("is_overloaded"), 1).otherwise(0)).alias("overload_hours"),
            F.sum(F.when(F.col("thermal_stress_category") == "CRITICAL", 1).otherwise(0)).alias("critical_stress_hours"),
        )
    )


# Weights of the composite score.
RISK_WEIGHTS = {"health": 0.3, "age": 0.2, "load": 0.25, "overload": 0.15, "stress": 0.1}


def composite_risk(df: DataFrame, hourly: DataFrame, n: int = 50) -> DataFrame:
    """Weighted risk score; the hourly facts are combined to one row per transformer before the join."""
    w = RISK_WEIGHTS
    score = (
        (100 - F.col("health_score")) * w["health"]
        + F.col("age_years") / 50.0 * 100.0 * w["age"]
        + F.least(F.col("avg_load_pct"), F.lit(150.0)) * w["load"]
        + F.least(F.col("overload_hours"), F.lit(100)) * w["overload"]
        + F.least(F.col("critical_stress_hours"), F.lit(50)) * w["stress"]
    )
    rows = (
        df.select("transformer_id", "age_years", "health_score", "location_area")
        .join(_hour_stats(hourly), "transformer_id")
        .where((F.col("health_score") < 60) | (F.col("overload_hours") > 20) | (F.col("age_years") > 35))
        .withColumn("risk_score", F.round(score, 2))
    )
    return topk(rows, [F.col("risk_score").desc_nulls_last(), F.col("transformer_id").asc()], n)


def high_risk(df: DataFrame, hourly: DataFrame, n: int = 20) -> DataFrame:
    """Rows where the transformer is unhealthy or the hour is overloaded, aggregated per transformer.

    The OR spans both sides.  Two partial aggregates per transformer cover both cases, so the facts are combined
    before the join: unhealthy transformers use all hours, the others only overloaded hours.
    """
    over = F.col("load_factor_pct") > 100
    stats = hourly.groupBy("transformer_id").agg(
        F.sum("load_factor_pct").alias("s_all"),
        F.count("load_factor_pct").alias("n_all"),
        F.max("load_factor_pct").alias("peak_load_pct"),
        F.sum(F.when(over, F.col("load_factor_pct"))).alias("s_over"),
        F.sum(F.when(over, 1).otherwise(0)).alias("overload_hours"),
    )
    weak = F.col("health_score") < 50
    rows = (
        df.select("transformer_id", "age_years", "health_score")
        .join(stats, "transformer_id")
        .where(weak | (F.col("overload_hours") > 0))
        .select(
            "transformer_id",
            "age_years",
            "health_score",
            F.when(weak, F.col("s_all") / F.col("n_all")).otherwise(F.col("s_over") / F.col("overload_hours")).alias("avg_load_pct"),
            "peak_load_pct",
            "overload_hours",
        )
    )
    order = [F.col("health_score").asc_nulls_last(), F.col("peak_load_pct").desc_nulls_last(), F.col("transformer_id").asc()]
    return topk(rows, order, n)


def area_risk(df: DataFrame, hourly: DataFrame) -> DataFrame:
    def ones(cond):
        return F.sum(F.when(cond, 1).otherwise(0))

    return (
        df.join(_hour_stats(hourly), "transformer_id", "left")
        .groupBy("location_area")
        .agg(
            F.count(F.lit(1)).alias("transformer_count"),
            F.avg("health_score").alias("avg_health"),
            F.avg("age_years").alias("avg_age"),
            ones(F.col("health_score") < 50).alias("low_health_count"),
            ones(F.col("age_years") > 35).alias("aging_count"),
            F.coalesce(F.sum("critical_stress_hours"), F.lit(0)).alias("critical_hours"),
        )
    )


def aging_fleet(df: DataFrame, years: int = 30) -> DataFrame:
    return (
        df.where(F.col("age_years") > years)
        .groupBy("manufacturer")
        .agg(F.count(F.lit(1)).alias("aging_count"), F.avg("health_score").alias("avg_health"))
    )


def substation_capacity(substations: DataFrame, transformers: DataFrame) -> DataFrame:
    counts = transformers.groupBy("substation_id").agg(F.count(F.lit(1)).alias("n"))
    return (
        substations.join(counts, "substation_id", "left")
        .groupBy("region_id")
        .agg(
            F.count(F.lit(1)).alias("substation_count"),
            F.sum("capacity_mva").alias("total_mva"),
            F.coalesce(F.sum("n"), F.lit(0)).alias("total_transformers"),
        )
    )


def location_groups(df: DataFrame, key: str = "circuit_id") -> DataFrame:
    return df.groupBy(key).agg(
        F.min("lat").alias("min_lat"), F.max("lat").alias("max_lat"),
        F.min("lon").alias("min_lon"), F.max("lon").alias("max_lon"),
        ((F.min("lat") + F.max("lat")) / 2).alias("center_lat"),
        ((F.min("lon") + F.max("lon")) / 2).alias("center_lon"),
        F.count(F.lit(1)).alias("transformer_count"),
        F.sum("rated_kva").alias("total_kva"),
        F.avg("health_score").alias("avg_health"),
    )


def meters_per_transformer(meters: DataFrame) -> DataFrame:
    return meters.groupBy("segment").agg(
        F.count(F.lit(1)).alias("meter_count"),
        (F.count(F.lit(1)) / F.nullif(F.countDistinct("transformer_id"), F.lit(0))).alias("meters_per_transformer"),
    )


def health_score(df: DataFrame, days_since_maintenance: Column) -> DataFrame:
    """0.4 age + 0.3 load + 0.3 maintenance sub-scores, each and the total held inside 0..100."""
    def floor0(c):
        return F.greatest(F.lit(0.0), c)

    age = floor0(F.lit(100.0) - F.col("age_years") * 1.5)
    load = floor0(F.lit(100.0) - F.col("load_utilization_pct") * 0.5)
    care = floor0(F.lit(100.0) - days_since_maintenance / 365.0 * 20.0)
    total = F.least(F.lit(100.0), floor0(age * 0.4 + load * 0.3 + care * 0.3))
    return df.withColumn("modelled_health", total)


def health_history(snapshots: DataFrame, alert_drop: float = -10.0) -> DataFrame:
    """Previous score, change and alert per asset and date (one row per asset and date)."""
    from pyspark.sql import Window

    w = Window.partitionBy("asset_id").orderBy("recorded_date")
    previous = F.lag("health_score").over(w)
    change = F.col("health_score") - previous
    return snapshots.select(
        "asset_id", "recorded_date", "health_score",
        previous.alias("previous_score"),
        change.alias("score_change"),
        rules.health_category(F.col("health_score")).alias("health_category"),
        (F.coalesce(change <= alert_drop, F.lit(False)) | (F.col("health_score") < 40)).alias("alert_flag"),
    )


def rule_risk(pairs: DataFrame, transformers: DataFrame) -> DataFrame:
    """Rule score of the newest state per transformer.

    The category leaves out the stress factor that the probability contains; both are kept that way on purpose.
    """
    newest = (
        pairs.groupBy("transformer_id")
        .agg(F.max_by(F.struct("morning_load_pct", "stress_vs_historical", "pair_date"), "pair_date").alias("s"))
        .select("transformer_id", "s.*")
    )
    load = F.col("morning_load_pct") / 100.0
    age = 1 + F.col("age_years") / 50.0
    full = F.least(F.lit(1.0), load * (1 + F.coalesce(F.col("stress_vs_historical"), F.lit(0.0)) / 100.0) * age)
    short = F.least(F.lit(1.0), load * age)
    return newest.join(transformers.select("transformer_id", "age_years"), "transformer_id").select(
        "transformer_id",
        "pair_date",
        full.alias("failure_probability"),
        rules.banded(short, [(">=", 0.7, "CRITICAL"), (">=", 0.5, "HIGH"), (">=", 0.3, "MEDIUM")], "LOW").alias("risk_category"),
        (100 - (F.col("morning_load_pct") * 0.5 + F.col("age_years") * 0.5)).alias("health_estimate"),
    )

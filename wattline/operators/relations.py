"""Join shapes between meters, transformers, circuits, substations and facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wattline.functions.calendar import slot, trunc
from wattline.functions.hashing import keyed_uniform
from wattline.operators.ordering import positioned

def meter_context(meters: DataFrame, transformers: DataFrame, circuits: DataFrame, substations: DataFrame) -> DataFrame:
    """Left chain meter -> transformer -> circuit -> substation."""
    return (
        meters.select("meter_id", "transformer_id", "circuit_id", "county", "segment")
        .join(transformers.select("transformer_id", "rated_kva", F.col("substation_id").alias("t_substation")), "transformer_id", "left")
        .join(circuits.select("circuit_id", F.col("status").alias("circuit_status")), "circuit_id", "left")
        .join(substations.select(F.col("substation_id").alias("t_substation"), "substation_name"), "t_substation", "left")
        .select("meter_id", "transformer_id", "circuit_id", F.col("t_substation").alias("substation_id"), "rated_kva", "circuit_status", "substation_name", "county", "segment")
    )


def customers_per_substation(customers: DataFrame, meters: DataFrame, transformers: DataFrame, substations: DataFrame, n: int = 20) -> DataFrame:
    return (
        customers.select("customer_id", "meter_id")
        .join(meters.select("meter_id", "transformer_id"), "meter_id")
        .join(transformers.select("transformer_id", "substation_id"), "transformer_id")
        .join(substations.select("substation_id", "substation_name"), "substation_id")
        .groupBy("substation_id", "substation_name")
        .agg(F.countDistinct("customer_id").alias("customer_count"))
        .orderBy(F.col("customer_count").desc(), "substation_id")
        .limit(n)
    )


def left_join_window(left: DataFrame, right: DataFrame, key: str, ts_col: str, lo: Column) -> DataFrame:
    """Left join with the time bound inside ON: left rows without a recent match keep a row."""
    return left.join(right.where(F.col(ts_col) >= lo), key, "left")


def by_day(spine: DataFrame, column: str) -> DataFrame:
    """The spine as one row per day with its steps in order: (_day, _steps)."""
    return spine.groupBy(F.to_date(column).alias("_day")).agg(F.sort_array(F.collect_set(column)).alias("_steps"))


def with_days(entities: DataFrame, spine: DataFrame, column: str) -> DataFrame:
    """Entity x day of the spine, written out on the entity's own row from the first and last day."""
    first, last = (spine.agg(f(F.to_date(column))).scalar() for f in (F.min, F.max))
    return entities.withColumn("_day", F.explode(F.sequence(first, last, F.expr("interval 1 day"))))


def dealt(rows: DataFrame) -> DataFrame:
    """Rows dealt over all tasks before they are written out many times: a small file or partition would leave its long output to one task."""
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(width, *[c for c, kind in rows.dtypes if "map<" not in kind])


def expand(entities: DataFrame, spine: DataFrame, column: str) -> DataFrame:
    """Entity x spine: days are written out per entity, then the steps of each day; a spine of any length is never held in one row."""
    return with_days(dealt(entities), spine, column).join(F.broadcast(by_day(spine, column)), "_day").withColumn(column, F.explode("_steps")).drop("_day", "_steps")


def with_weather(df: DataFrame, ts_col: str, weather: DataFrame) -> DataFrame:
    hours = weather.select(F.col("hour").alias("_hour"), "temperature_f", "humidity_pct")
    return df.withColumn("_hour", trunc("HOUR", F.col(ts_col))).join(hours, "_hour", "left").drop("_hour")


def orphans(child: DataFrame, parent: DataFrame, key: str, nullable: bool = False) -> DataFrame:
    rows = child.where(F.col(key).isNotNull()) if nullable else child
    return rows.join(parent.select(key), key, "left_anti")


def orphan_readings(readings: DataFrame, meters: DataFrame) -> DataFrame:
    """Meters that report but have no transformer on record."""
    known = meters.where("transformer_id IS NOT NULL").select("meter_id")
    return readings.select("meter_id").distinct().join(known, "meter_id", "left_anti")


def linked(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    return child.join(parent.select(key), key, "left_semi")


def count_diff(source: DataFrame, target: DataFrame) -> DataFrame:
    """Compare two (table_name, row_count) lists."""
    s = source.select("table_name", F.col("row_count").alias("source_rows"))
    t = target.select("table_name", F.col("row_count").alias("target_rows"))
    return s.join(t, "table_name", "full_outer").select(
        "table_name", "source_rows", "target_rows",
        F.when(F.col("target_rows").isNull(), "MISSING")
        .when(F.col("source_rows").isNull(), "NEW_TABLE")
        .when(F.col("source_rows") == F.col("target_rows"), "PASS")
        .otherwise("ROW_COUNT_DIFF")
        .alias("status"),
    )


def with_child_counts(parent: DataFrame, child: DataFrame, key: str, out: str) -> DataFrame:
    counts = child.groupBy(key).agg(F.count(F.lit(1)).alias(out))
    return parent.join(counts, key, "left").withColumn(out, F.coalesce(out, F.lit(0)))


def metro(substations: DataFrame, circuits: DataFrame, transformers: DataFrame, hourly: DataFrame, since: Column) -> DataFrame:
    """Per substation: recent load, circuits out, transformer count and capacity; each child is combined first."""
    per_xfmr = hourly.where(F.col("load_hour") >= since).groupBy("transformer_id").agg(
        F.sum("load_factor_pct").alias("s"), F.count("load_factor_pct").alias("c")
    )
    load = (
        per_xfmr.join(transformers.select("transformer_id", "substation_id"), "transformer_id")
        .groupBy("substation_id")
        .agg(F.round(F.sum("s") / F.sum("c"), 2).alias("avg_load_pct"))
    )
    out = circuits.where(F.col("status") == "OUTAGE").groupBy("substation_id").agg(F.count(F.lit(1)).alias("active_outages"))
    size = transformers.groupBy("substation_id").agg(
        F.count(F.lit(1)).alias("transformer_count"), F.sum("rated_kva").alias("total_capacity_kva")
    )
    return (
        substations.select("substation_id", "substation_name", "lat", "lon", "capacity_mva")
        .join(load, "substation_id", "left")
        .join(out, "substation_id", "left")
        .join(size, "substation_id", "left")
        .withColumns({c: F.coalesce(c, F.lit(0)) for c in ("active_outages", "transformer_count", "total_capacity_kva")})
    )


def circuit_view(circuits: DataFrame, substations: DataFrame, meters: DataFrame, readings: DataFrame, since: Column) -> DataFrame:
    """Per circuit: meters on it, mean recent voltage and outage flag."""
    count = meters.groupBy("circuit_id").agg(F.count(F.lit(1)).alias("meter_count"))
    per_meter = readings.where(F.col("reading_ts") >= since).groupBy("meter_id").agg(
        F.sum("voltage_v").alias("v"), F.count("voltage_v").alias("n")
    )
    volts = (
        per_meter.join(meters.select("meter_id", "circuit_id"), "meter_id")
        .groupBy("circuit_id")
        .agg((F.sum("v") / F.sum("n")).alias("avg_voltage"))
    )
    return (
        circuits.select("circuit_id", "substation_id", F.coalesce("status", F.lit("ENERGIZED")).alias("status"))
        .join(substations.select("substation_id", "substation_name"), "substation_id", "left")
        .join(count, "circuit_id", "left")
        .join(volts, "circuit_id", "left")
        .withColumns({"meter_count": F.coalesce("meter_count", F.lit(0)), "has_outage": F.col("status") == "OUTAGE"})
    )


def service_areas(substations: DataFrame, circuits: DataFrame, transformers: DataFrame, meters: DataFrame, outages: DataFrame) -> DataFrame:
    """Per substation: customers, transformers, circuits, and the measured average outage minutes per customer."""
    def count(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("substation_id").agg(F.count(F.lit(1)).alias(name))

    minutes = outages.groupBy("substation_id").agg(
        F.sum(F.col("customers") * F.timestamp_diff("MINUTE", F.col("start_ts"), F.col("end_ts"))).alias("customer_minutes")
    )
    out = substations.select(
        F.col("substation_id"), F.col("substation_name").alias("service_area_name"),
        F.col("lat").alias("center_lat"), F.col("lon").alias("center_lon"), F.col("capacity_mva").alias("total_capacity_mva"),
    )
    for df, name in ((meters, "customer_count"), (transformers, "transformer_count"), (circuits, "circuit_count")):
        out = out.join(count(df, name), "substation_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return (
        out.join(minutes, "substation_id", "left")
        .withColumn("saidi_minutes", F.col("customer_minutes") / F.nullif(F.col("customer_count"), F.lit(0)))
        .withColumnRenamed("substation_id", "service_area_id")
        .drop("customer_minutes")
    )


def feeders(transformers: DataFrame, substations: DataFrame, circuits: DataFrame) -> DataFrame:
    """One row per transformer: the circuit is a scalar pick per substation, so nothing fans out."""
    from wattline.functions.geometry import haversine

    first = circuits.groupBy("substation_id").agg(F.min("circuit_id").alias("circuit_id"))
    subs = substations.select("substation_id", F.col("lat").alias("from_lat"), F.col("lon").alias("from_lon"))
    rows = (
        transformers.where("lat IS NOT NULL").drop("circuit_id")
        .join(subs.where("from_lat IS NOT NULL"), "substation_id")
        .join(first, "substation_id", "left")
    )
    return rows.select(
        "substation_id", "transformer_id", F.lit("SUBSTATION_TO_TRANSFORMER").alias("connection_type"),
        "from_lat", "from_lon", F.col("lat").alias("to_lat"), F.col("lon").alias("to_lon"),
        F.when(F.col("rated_kva") > 0, F.col("load_utilization_pct")).alias("load_utilization_pct"),
        "circuit_id", "rated_kva",
        haversine(F.col("from_lat"), F.col("from_lon"), F.col("lat"), F.col("lon")).alias("distance_km"),
        F.lit("12.47 kV").alias("voltage_level"),
    )


def relink(children: DataFrame, child_key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """Bind every child to the parent whose position equals floor(uniform(child) * parents)."""
    numbered = positioned(parents.select(parent_key), [F.col(parent_key).asc()], position="_rn")
    n = parents.agg(F.count(F.lit(1)).alias("n")).scalar()
    pick = F.floor(keyed_uniform(F.col(child_key), "pole") * n) + 1
    return children.withColumn("_rn", pick).join(numbered, "_rn").drop("_rn")


def siblings(transformers: DataFrame, wanted: DataFrame) -> DataFrame:
    """Other transformers of the same substation for the transformers in ``wanted``, one row per sibling."""
    mine = wanted.select("transformer_id").join(transformers.select("transformer_id", "substation_id"), "transformer_id")
    other = transformers.select(F.col("transformer_id").alias("sibling_id"), "substation_id")
    return mine.join(other, "substation_id").where("sibling_id <> transformer_id").select("transformer_id", "sibling_id")


def affected_assets(transformers: DataFrame, substation_id: str, connected: list[str], include_secondary: bool = True) -> DataFrame:
    """Key equals the source, or is in the connected list when secondary effects count."""
    keys = [substation_id] + (list(connected) if include_secondary else [])
    return transformers.where(F.col("substation_id").isin(keys))


def flatten(df: DataFrame, array_col: str, out: str) -> DataFrame:
    return df.withColumn(out, F.explode(array_col)).drop(array_col)


def normalize_key(df: DataFrame, col: str, valid: DataFrame, valid_col: str) -> DataFrame:
    """Rewrite the two legacy spellings, then keep the key only if it is a valid one.

    SUB-HOU-0001 -> SUB-HOU-001 and SUB_0021 -> SUB-0021; anything else stays as it is.
    """
    k = F.col(col)
    dashed = F.regexp_extract(k, r"^SUB-HOU-(\d+)$", 1)
    scored = F.regexp_extract(k, r"^SUB_(\d+)$", 1)

    def padded(prefix: str, digits: Column, width: int) -> Column:
        number = F.nullif(digits, F.lit("")).try_cast("bigint").cast("string")
        return F.concat(F.lit(prefix), F.lpad(number, F.greatest(F.lit(width), F.length(number)), F.lit("0")))

    guess = (
        F.when(dashed != "", padded("SUB-HOU-", dashed, 3)).when(scored != "", padded("SUB-", scored, 4)).otherwise(k)
    )
    known = valid.select(F.col(valid_col).alias("_valid")).distinct()
    return (
        df.withColumn("_guess", guess)
        .join(known, F.col("_guess") == F.col("_valid"), "left")
        .withColumn("normalized", F.col("_valid"))
        .drop("_guess", "_valid")
    )


def apply_xref(df: DataFrame, col: str, xref: DataFrame, source_system: str) -> DataFrame:
    """Translate legacy ids; rows without a translation are dropped."""
    mine = xref.where(F.col("source_system") == source_system).select(F.col("source_id").alias(col), "canonical_id")
    return df.join(mine, col)


def slot_join_key(df: DataFrame, ts_col: str) -> DataFrame:
    return df.withColumn("slot_ts", slot(F.col(ts_col)))

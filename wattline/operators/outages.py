"""Outage records: severity, statistics, slot expansion and matching to readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wattline.functions import rules
from wattline.functions.calendar import NTZ, minutes_between, slot, trunc, ts
from wattline.functions.hashing import uniform_int
from wattline.operators.anchors import anchor, recent, topk
from wattline.operators.moments import merged_moments, moments


def outage_searchable(outages: DataFrame) -> DataFrame:
    text = F.concat(
        F.col("outage_id"), F.lit(" "),
        F.coalesce("cause", F.lit("unknown_cause")), F.lit(" "),
        F.coalesce("status", F.lit("unknown_status")), F.lit(" on substation "),
        F.coalesce("substation_id", F.lit("unknown_sub")), F.lit(" transformer "),
        F.coalesce("transformer_id", F.lit("unknown_xfmr")), F.lit(" "),
    )
    return outages.withColumns(
        {
            "outage_date": F.to_date("start_ts"),
            "outage_hour": F.hour("start_ts"),
            "severity": rules.outage_severity(F.col("customers")),
            "search_text": text,
        }
    )


def ops_severity(outages: DataFrame) -> DataFrame:
    return outages.withColumns(
        {
            "severity": rules.ops_severity(F.col("cause"), F.col("customers")),
            "scenario": rules.scenario_tag(F.col("cause")),
        }
    )


def active_outages(outages: DataFrame, substations: DataFrame, as_of: str | None = None) -> DataFrame:
    at = anchor(outages, "end_ts", as_of)
    where = substations.select("substation_id", "substation_name", "lat", "lon")
    return (
        outages.where(F.col("status") == "ACTIVE")
        .withColumn("minutes_out", minutes_between(F.col("start_ts"), at))
        .join(where, "substation_id")
        .select("outage_id", "substation_id", "substation_name", "lat", "lon", "cause", "customers", "start_ts", "minutes_out")
    )


def duration_minutes(as_of: Column | None = None) -> Column:
    end = F.col("end_ts") if as_of is None else F.when(F.col("status") == "ACTIVE", as_of).otherwise(F.col("end_ts"))
    return minutes_between(F.col("start_ts"), end)


def outage_stats(outages: DataFrame, days: int = 7, as_of: str | None = None) -> DataFrame:
    """Totals of the trailing days; open outages last until the anchor."""
    at = anchor(outages, "start_ts", as_of)
    rows = recent(outages, "start_ts", f"{days} days", as_of).withColumn("_at", at)
    active = F.col("status") == "ACTIVE"
    return rows.agg(
        F.count(F.lit(1)).alias("total_outages"),
        F.sum(F.when(active, 1).otherwise(0)).alias("active_outages"),
        F.sum(F.when(active, F.col("customers")).otherwise(0)).alias("customers_out"),
        F.avg(duration_minutes(F.col("_at"))).alias("avg_minutes"),
    )


def outage_by_cause(outages: DataFrame, lo: str | None = None, hi: str | None = None) -> DataFrame:
    """Per cause.  The upper bound is inclusive and bare dates mean midnight."""
    rows = outages
    if lo is not None:
        rows = rows.where(F.col("start_ts").between(ts(lo), ts(hi)))
    return rows.groupBy("cause").agg(
        F.countDistinct("outage_id").alias("outage_count"),
        F.sum("customers").alias("customers_affected"),
        F.avg(duration_minutes()).alias("avg_duration_min"),
    )


def outage_timeline(outages: DataFrame) -> DataFrame:
    return outages.groupBy(trunc("HOUR", F.col("start_ts")).alias("hour")).agg(
        F.count(F.lit(1)).alias("outage_count"), F.sum("customers").alias("customers_affected")
    )


def reliability_indices(outages: DataFrame, customers: DataFrame) -> DataFrame:
    """SAIDI and SAIFI per year over restored outages.

    ``saifi_events`` divides the number of outages, ``saifi`` the number of customer interruptions.
    """
    n = customers.agg(F.count(F.lit(1)).alias("n")).scalar()
    return (
        outages.where(F.col("status") == "RESTORED")
        .groupBy(F.year("start_ts").alias("year"))
        .agg(
            F.sum(F.col("customers") * duration_minutes()).alias("customer_minutes"),
            F.sum("customers").alias("interruptions"),
            F.count(F.lit(1)).alias("outage_count"),
        )
        .select(
            "year",
            (F.col("customer_minutes") / n).alias("saidi"),
            (F.col("interruptions") / n).alias("saifi"),
            (F.col("outage_count") / n).alias("saifi_events"),
        )
    )


def outage_slots(outages: DataFrame, minutes: int = 15) -> DataFrame:
    """Every slot start inside [start, end] of an outage, both ends included, once per (transformer, slot).

    Each interval is expanded on its own row, which turns the range join into an equality join later on.
    """
    first = slot(F.col("start_ts"), minutes)
    step = F.expr(f"interval {minutes} minutes")
    begin = F.when(first < F.col("start_ts"), (first + step).cast(NTZ)).otherwise(first)
    spans = outages.select("transformer_id", begin.alias("_from"), F.col("end_ts").alias("_to")).where("_from <= _to")
    return spans.select("transformer_id", F.explode(F.sequence("_from", "_to", step)).alias("slot_ts")).distinct()


def touching(outages: DataFrame, day: str) -> DataFrame:
    """The outages that lie on a day, in part at least."""
    start = F.lit(day).cast("date").cast(NTZ)
    return outages.where((F.col("start_ts") < start + F.expr("interval 1 day")) & (F.col("end_ts") >= start))


def outage_slots_by_range(outages: DataFrame, spine: DataFrame) -> DataFrame:
    """The same result from the literal BETWEEN join with the time spine; kept for small inputs and tests."""
    cond = spine["slot_ts"].between(outages["start_ts"], outages["end_ts"])
    return outages.join(spine, cond).select("transformer_id", "slot_ts").distinct()


def part_of_day(col: Column, hours: int = 6) -> Column:
    """Start of the part of the day that holds ``col`` (parts divide the day)."""
    return (F.date_trunc("DAY", col) + F.make_interval(hours=(F.floor(F.hour(col) / F.lit(hours)) * F.lit(hours)).cast("int"))).cast(NTZ)


def part_spans(outages: DataFrame, keys: list[str], hours: int = 6) -> DataFrame:
    """Per key and part of a day that an outage touches, its intervals: equality joins on the part find them, the exact times decide.

    Parts are about as long as outages, so an outage is written out a few times and not once for every slot of a reading.
    """
    step = F.expr(f"interval {hours} hours")
    spans = outages.where("start_ts <= end_ts").select(*keys, "start_ts", "end_ts", F.explode(F.sequence(part_of_day(F.col("start_ts"), hours), F.col("end_ts"), step)).alias("_part"))
    return spans.groupBy(*keys, "_part").agg(F.collect_set(F.struct("start_ts", "end_ts")).alias("_spans"))


def inside(ts_col: str) -> Column:
    """Whether the time lies in one of ``_spans``, both ends included."""
    return F.exists("_spans", lambda x: F.col(ts_col).between(x.start_ts, x.end_ts))


def mark_outage(readings: DataFrame, meters: DataFrame, outages: DataFrame) -> DataFrame:
    """Readings with the flag of their transformer: OUTAGE where the reading's time lies inside an outage."""
    keyed = readings.join(meters.select("meter_id", "transformer_id"), "meter_id").withColumns({"slot_ts": slot(F.col("reading_ts")), "_part": part_of_day(F.col("reading_ts"))})
    return keyed.join(part_spans(outages, ["transformer_id"]), ["transformer_id", "_part"], "left").select(
        "meter_id", "transformer_id", "reading_ts", "slot_ts", "usage_kwh",
        F.when(F.coalesce(inside("reading_ts"), F.lit(False)), "OUTAGE").otherwise("VALID").alias("slot_quality"),
    )


def outage_loss(final: DataFrame, meters: DataFrame, outages: DataFrame) -> DataFrame:
    """Per cause: readings inside an outage of that cause, meters touched and kWh at stake.

    One row per (transformer, part of a day, cause), so overlapping outages of one cause do not multiply readings.
    """
    keyed = final.join(meters.select("meter_id", "transformer_id"), "meter_id").withColumn("_part", part_of_day(F.col("reading_ts")))
    return (
        keyed.join(part_spans(outages, ["transformer_id", "cause"]), ["transformer_id", "_part"])
        .where(inside("reading_ts"))
        .groupBy("cause")
        .agg(
            F.count(F.lit(1)).alias("affected_intervals"),
            F.countDistinct("meter_id").alias("affected_meters"),
            F.sum("usage_kwh").alias("kwh_at_stake"),
            F.sum(F.col("usage_kwh") - F.col("usage_kwh_adjusted")).alias("lost_kwh"),
        )
    )


def load_outages(raw: DataFrame, transformers: DataFrame, meters: DataFrame, lo: str, hi: str, storm_day: str, storm_hours: tuple[int, int] = (17, 19)) -> DataFrame:
    """Clean load: valid window, known transformers, storm hours retagged, crew, mid-point estimate and notes."""
    counts = meters.groupBy("transformer_id").agg(F.count(F.lit(1)).alias("meters_affected"))
    known = transformers.select("transformer_id", F.col("substation_id").alias("t_substation"))
    rows = (
        raw.where((F.col("start_ts") >= ts(lo)) & (F.col("start_ts") < ts(hi)) & (F.col("end_ts") > F.col("start_ts")))
        .join(known, "transformer_id")
        .join(counts, "transformer_id", "left")
    )
    storm = (F.to_date("start_ts") == F.lit(storm_day).cast("date")) & F.hour("start_ts").between(*storm_hours)
    minutes = minutes_between(F.col("start_ts"), F.col("end_ts"))
    half = F.round(minutes / F.lit(2.0)).cast("int")
    crew = F.concat(F.lit("CREW-"), uniform_int(1, 8, F.col("outage_id")).cast("string"))
    return rows.select(
        "outage_id",
        "circuit_id",
        F.col("t_substation").alias("substation_id"),
        "transformer_id",
        "start_ts",
        "end_ts",
        F.lit("RESTORED").alias("status"),
        F.when(storm, "WEATHER").otherwise(F.col("cause")).alias("cause"),
        F.coalesce("meters_affected", F.lit(1)).alias("customers"),
        crew.alias("crew"),
        (F.col("start_ts") + F.make_interval(mins=half)).cast(NTZ).alias("estimated_restoration"),
        minutes.alias("duration_minutes"),
        F.when(storm, F.concat(F.lit("Storm impact. Original cause: "), F.col("cause")))
        .otherwise(F.concat(F.lit("Historical seed outage. Cause: "), F.col("cause")))
        .alias("notes"),
    )


def outage_features(readings: DataFrame, meters: DataFrame, outages: DataFrame, hours: int = 4) -> DataFrame:
    """Per circuit and hour: reporting rate, voltage state, past outages, and the label of an outage soon after.

    Readings are combined per meter and hour first, so that meters are counted as rows and only those rows meet the circuits.
    """
    per_meter = readings.groupBy("meter_id", trunc("HOUR", F.col("reading_ts")).alias("feature_hour")).agg(
        *moments("voltage_v"), F.max(F.when(F.col("voltage_v") < 114, 1).otherwise(0)).alias("_low")
    )
    mean, deviation = merged_moments()
    state = per_meter.join(meters.select("meter_id", "circuit_id"), "meter_id").groupBy("circuit_id", "feature_hour").agg(
        F.count(F.lit(1)).alias("meters_reporting"), mean.alias("avg_voltage"), deviation.alias("voltage_stddev"), F.sum("_low").alias("low_voltage_meters")
    )
    sizes = meters.groupBy("circuit_id").agg(F.count(F.lit(1)).alias("meter_count"))
    # Outages are first combined per circuit and hour; the look-back is then a sum over at most 90*24 such rows.
    per_hour = outages.groupBy("circuit_id", trunc("HOUR", F.col("start_ts")).alias("outage_hour")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(duration_minutes()).alias("minutes")
    )
    days = per_hour.select("circuit_id", "outage_hour", "n", "minutes", F.to_date("outage_hour").alias("outage_day"))
    daily = days.groupBy("circuit_id", "outage_day").agg(F.sum("n").alias("n"), F.sum("minutes").alias("minutes"))
    spread = daily.select(
        "circuit_id", "n", "minutes",
        F.posexplode(F.transform(F.sequence(F.lit(1), F.lit(90)), lambda d: F.date_add("outage_day", d))).alias("lag", "feature_day"),
    )
    past = spread.groupBy("circuit_id", "feature_day").agg(
        F.sum(F.when(F.col("lag") < 30, F.col("n")).otherwise(0)).alias("outages_last_30d"),
        F.sum("n").alias("outages_last_90d"),
        (F.sum("minutes") / F.sum("n")).alias("avg_outage_duration_min"),
    )
    soon = per_hour.select(
        "circuit_id",
        F.explode(
            F.sequence(
                (F.col("outage_hour") - F.expr(f"interval {hours} hours")).cast(NTZ),
                (F.col("outage_hour") - F.expr("interval 1 hour")).cast(NTZ),
                F.expr("interval 1 hour"),
            )
        ).alias("feature_hour"),
    ).distinct().withColumn("_soon", F.lit(True))
    return (
        state.withColumn("feature_day", F.to_date("feature_hour"))
        .join(sizes, "circuit_id")
        .join(past, ["circuit_id", "feature_day"], "left")
        .join(soon, ["circuit_id", "feature_hour"], "left")
        .select(
            "circuit_id", "feature_hour", "meter_count", "meters_reporting",
            (F.col("meters_reporting") / F.col("meter_count")).alias("reporting_rate"),
            "avg_voltage", "voltage_stddev", "low_voltage_meters",
            F.coalesce("outages_last_30d", F.lit(0)).alias("outages_last_30d"),
            F.coalesce("outages_last_90d", F.lit(0)).alias("outages_last_90d"),
            "avg_outage_duration_min",
            F.coalesce("_soon", F.lit(False)).alias("had_outage_soon"),
        )
    )


def worst_outages(outages: DataFrame, n: int = 20) -> DataFrame:
    return topk(outages, [F.col("customers").desc_nulls_last(), F.col("outage_id").asc()], n)

"""Data-quality checks.  Each yields check_name, detail, violations and status."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from wattline.functions.calendar import is_weekend, slot, trunc, ts
from wattline.functions.geometry import haversine
from wattline.operators.ordering import tiled
from wattline.operators.quantiles import exact_percentiles

# Limits of the service territory.
LAT_RANGE = (28.0, 31.0)
LON_RANGE = (-97.0, -93.5)


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _ones(cond: Column) -> Column:
    return F.coalesce(F.sum(F.when(cond, 1).otherwise(0)), F.lit(0))


def _verdict(violations: Column) -> Column:
    return F.when(violations == 0, "PASS").otherwise("FAIL")


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    return union(
        [df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(n).alias("table_name"), "row_count") for n, df in tables.items()]
    )


def check_coords(tables: dict[str, DataFrame]) -> DataFrame:
    """Missing or out-of-territory positions per table: one scan each."""
    bad = (
        F.col("lat").isNull() | F.col("lon").isNull() | ~F.col("lat").between(*LAT_RANGE) | ~F.col("lon").between(*LON_RANGE)
    )
    parts = []
    for name, df in tables.items():
        row = df.agg(F.count(F.lit(1)).alias("total"), _ones(bad).alias("violations"))
        parts.append(row.select(F.lit("coordinate_validity").alias("check_name"), F.lit(name).alias("detail"), "total", "violations", _verdict(F.col("violations")).alias("status")))
    return union(parts)


def check_fk(relations: list[tuple[str, DataFrame, DataFrame, str, bool]]) -> DataFrame:
    """(name, child, parent, key, key may be NULL) -> orphan count."""
    parts = []
    for name, child, parent, key, nullable in relations:
        rows = child.select(key)
        rows = rows.where(F.col(key).isNotNull()) if nullable else rows
        n = rows.join(parent.select(key), key, "left_anti").agg(F.count(F.lit(1)).alias("violations"))
        parts.append(n.select(F.lit("referential_integrity").alias("check_name"), F.lit(name).alias("detail"), "violations", _verdict(F.col("violations")).alias("status")))
    return union(parts)


def check_distance(name: str, child: DataFrame, parent: DataFrame, key: str, limit_km: float, required_pct: float) -> DataFrame:
    """Share of child-parent distances within the limit."""
    p = parent.select(key, F.col("lat").alias("_plat"), F.col("lon").alias("_plon"))
    d = haversine(F.col("lat"), F.col("lon"), F.col("_plat"), F.col("_plon"))
    row = child.join(p, key).agg(
        F.round(F.avg(F.when(d <= limit_km, 100.0).otherwise(0.0)), 3).alias("actual_pct"), F.round(F.avg(d) * 1000, 1).alias("mean_m")
    )
    return row.select(
        F.lit("spatial_invariants").alias("check_name"), F.lit(name).alias("detail"), F.lit(required_pct).alias("required_pct"),
        "actual_pct", "mean_m", F.when(F.col("actual_pct") >= required_pct, "PASS").otherwise("FAIL").alias("status"),
    )


def check_edges(edges: DataFrame) -> DataFrame:
    """Edges longer than 100 km, without a length or leading outside the territory, by edge type."""
    d = haversine(F.col("from_lat"), F.col("from_lon"), F.col("to_lat"), F.col("to_lon"))
    bad = d.isNull() | (d > 100) | ~F.col("to_lat").between(*LAT_RANGE) | ~F.col("to_lon").between(*LON_RANGE)
    return (
        edges.groupBy("edge_type")
        .agg(F.count(F.lit(1)).alias("total"), _ones(bad).alias("violations"))
        .select(F.lit("no_absurd_edges").alias("check_name"), F.col("edge_type").alias("detail"), "total", "violations", _verdict(F.col("violations")).alias("status"))
    )


def check_contract(views: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """Per view: required columns that it lacks, and rows in which a required column that it has is null; one aggregate a view."""
    parts = []
    for name, (df, required) in views.items():
        lacking = sorted(c for c in required if c not in df.columns)
        held = [c for c in required if c in df.columns]
        empty = reduce(lambda x, y: x | y, [F.col(c).isNull() for c in held], F.lit(False))
        row = df.agg(F.count(F.lit(1)).alias("row_count"), _ones(empty).alias("null_rows"))
        bad = F.lit(len(lacking)) + F.col("null_rows")
        parts.append(row.select(
            F.lit("column_contracts").alias("check_name"), F.lit(name).alias("detail"), F.lit(len(set(required))).cast("bigint").alias("required_cols"), F.lit(", ".join(lacking)).alias("missing"),
            "row_count", "null_rows", _verdict(bad).alias("status"),
        ))
    return union(parts)


class TableChecks:
    """Checks of one table that are measured together: any number of rules and references cost one scan and one aggregate."""

    def __init__(self, name: str, df: DataFrame):
        self.name, self.df = name, df
        self.measures: list[tuple[str, str, Column]] = []

    def rule(self, check: str, detail: str, bad: Column) -> TableChecks:
        """Count the rows for which ``bad`` holds."""
        self.measures.append((check, detail, bad))
        return self

    def position(self) -> TableChecks:
        inside = F.col("lat").between(*LAT_RANGE) & F.col("lon").between(*LON_RANGE)
        return self.rule("coordinate_validity", self.name, ~F.coalesce(inside, F.lit(False)))

    def reference(self, detail: str, parent: DataFrame, key: str, nullable: bool = False) -> TableChecks:
        """Count the rows whose key no parent has. Parents' keys are joined once each, so rows are never multiplied."""
        found = f"_found{len(self.measures)}"
        known = parent.select(F.col(key).alias(found)).where(F.col(found).isNotNull()).distinct()
        self.df = self.df.join(known, F.col(key) == F.col(found), "left")
        missing = F.col(found).isNull()
        return self.rule("referential_integrity", detail, missing & F.col(key).isNotNull() if nullable else missing)

    def rows(self) -> DataFrame:
        """(check_name, detail, measured, status) with the number of violations as ``measured``."""
        one = self.df.agg(*[_ones(bad).alias(f"_v{i}") for i, (_, _, bad) in enumerate(self.measures)])
        each = [F.struct(F.lit(c).alias("check_name"), F.lit(d).alias("detail"), F.col(f"_v{i}").alias("v")) for i, (c, d, _) in enumerate(self.measures)]
        return one.select(F.explode(F.array(*each)).alias("c")).select("c.check_name", "c.detail", F.col("c.v").cast("double").alias("measured"), _verdict(F.col("c.v")).alias("status"))


def reading_profile(readings: DataFrame, meters: DataFrame) -> DataFrame:
    """Readings by hour and county: rows, valid rows and their kWh, outage rows and those with usage. The one scan behind ``shape_checks``.

    Readings are combined per meter and hour before they meet the meters; the result is bounded by hours times counties.
    """
    valid = F.col("quality") == "VALID"
    out = F.col("quality") == "OUTAGE"
    per = readings.groupBy("meter_id", trunc("HOUR", F.col("reading_ts")).alias("hour")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(valid, F.col("usage_kwh"))).alias("kwh"), F.count(F.when(valid, F.col("usage_kwh"))).alias("valid"),
        _ones(out).alias("outage"), _ones(out & (F.col("usage_kwh") != 0)).alias("outage_used"),
    )
    joined = per.join(meters.select("meter_id", "county"), "meter_id", "left")
    return joined.groupBy("hour", "county").agg(*[F.sum(c).alias(c) for c in ("n", "kwh", "valid", "outage", "outage_used")])


def shape_checks(profile: DataFrame, weather: DataFrame) -> DataFrame:
    """(check_name, detail, measured, status) of the statistical checks, all from a stored ``reading_profile``."""
    mean = F.sum("kwh") / F.nullif(F.sum("valid"), F.lit(0))
    none = F.nullif(F.lit(0.0), F.lit(0.0))

    def by(key: Column) -> DataFrame:
        return profile.groupBy(key.alias("k")).agg(mean.alias("m")).where("m IS NOT NULL")

    def result(row: DataFrame, name: str, value: Column, ok: Column) -> DataFrame:
        return row.select(value.alias("v"), ok.alias("ok")).select(F.lit(name).alias("check_name"), F.lit("readings").alias("detail"), F.round("v", 4).alias("measured"), F.when(F.col("ok"), "PASS").otherwise("FAIL").alias("status"))

    days = by(F.to_date("hour")).agg(((F.max("m") - F.min("m")) / F.nullif(F.avg("m"), F.lit(0.0)) * 100).alias("v"))
    warm = by(F.col("hour")).join(weather.select(F.col("hour").alias("k"), "temperature_f"), "k").agg(F.corr("m", "temperature_f").alias("v"))
    week = by(is_weekend(F.col("hour"))).agg(F.max(F.when(F.col("k"), F.col("m"))).alias("e"), F.max(F.when(~F.col("k"), F.col("m"))).alias("d")).select((F.col("e") / F.nullif("d", F.lit(0.0))).alias("v"))
    place = by(F.col("county")).where("k IS NOT NULL").agg((F.stddev_samp("m") / F.nullif(F.avg("m"), F.lit(0.0)) * 100).alias("v"))
    clock = by(F.hour("hour")).agg(F.avg(F.when(F.col("k").between(17, 20), F.col("m"))).alias("e"), F.avg(F.when(F.col("k").between(0, 3), F.col("m"))).alias("o")).select((F.col("e") / F.nullif("o", F.lit(0.0))).alias("v"))
    total = profile.agg(F.sum("outage_used").cast("double").alias("v"))
    v = F.coalesce(F.col("v"), none)
    return union([
        result(days, "01_daily_variance", F.col("v"), F.round(v, 2).between(5, 30)), result(warm, "02_temp_corr", F.col("v"), v > 0.40), result(total, "04_outage_zeros", F.col("v"), v == 0),
        result(week, "05_weekend_split", F.col("v"), v.between(1.04, 1.15)), result(place, "08_geographic_variance", F.col("v"), v >= 3), result(clock, "09_diurnal_ratio", F.col("v"), v >= 1.8),
    ])


def check_keys(df: DataFrame, key_cols: list[str], ts_col: str) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        *[_ones(F.col(c).isNull()).alias(f"null_{c}") for c in key_cols],
        F.min(ts_col).alias("first_ts"),
        F.max(ts_col).alias("last_ts"),
    )


def column_completeness(df: DataFrame) -> DataFrame:
    """Filled count and share of every column, from one aggregate turned into rows."""
    cols = df.columns
    one = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(c).alias(c) for c in cols])
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("filled")) for c in cols])
    return one.select("_n", F.explode(pairs).alias("p")).select(
        "p.column_name", "p.filled", F.round(F.col("p.filled").cast("double") * 100 / F.nullif("_n", F.lit(0)), 2).alias("completeness_pct")
    )


def check_rows(counts: DataFrame, expected: dict[str, int]) -> DataFrame:
    """PASS at or above the minimum, WARN below it, FAIL when empty, INFO without a minimum."""
    spark = counts.sparkSession
    limits = spark.createDataFrame(list(expected.items()), "table_name string, minimum_rows bigint")
    n, lo = F.col("row_count"), F.col("minimum_rows")
    status = F.when(lo.isNull(), "INFO").when(n >= lo, "PASS").when(n > 0, "WARN").otherwise("FAIL")
    return counts.join(limits, "table_name", "left").select("table_name", "row_count", "minimum_rows", status.alias("status"))


def validate_chunk(readings: DataFrame, meters: DataFrame, transformers: DataFrame, from_ts: str, to_ts: str, expected_rows: int) -> DataFrame:
    """Gate for one time chunk: the first failing test decides the verdict."""
    rows = readings.where(F.col("reading_ts").between(ts(from_ts), ts(to_ts)))
    on_grid = (F.minute("reading_ts").isin(0, 15, 30, 45)) & (F.second("reading_ts") == 0)

    def pct(cond: Column) -> Column:
        return F.round(F.avg(F.when(cond, 1.0).otherwise(0.0)) * 100.0, 2)

    basic = rows.agg(
        F.count(F.lit(1)).alias("total_readings"),
        pct(F.col("voltage_v").between(115, 125)).alias("voltage_ok_pct"),
        pct(F.col("power_factor").between(0.85, 0.99)).alias("pf_ok_pct"),
        pct(on_grid).alias("grid_ok_pct"),
    )
    known = meters.where("transformer_id IS NOT NULL").select("meter_id")
    orphan = rows.select("meter_id").distinct().join(known, "meter_id", "left_anti").agg(F.count(F.lit(1)).alias("n")).scalar()
    per_meter = rows.groupBy("meter_id", trunc("HOUR", F.col("reading_ts")).alias("h")).agg(F.sum(F.col("usage_kwh") * 4.0).alias("kw"))
    hours = per_meter.join(meters.select("meter_id", "transformer_id"), "meter_id").groupBy("transformer_id", "h").agg(F.sum("kw").alias("kw"))
    breach = (
        hours.join(transformers.select("transformer_id", "rated_kva"), "transformer_id")
        .where(F.col("kw") > F.col("rated_kva") * 0.9)
        .agg(F.count(F.lit(1)).alias("n"))
        .scalar()
    )
    m = basic.withColumns(
        {
            "fk_orphans": orphan,
            "capacity_breaches": breach,
            "expected_rows": F.lit(round(expected_rows)).cast("bigint"),
        }
    ).withColumn("row_count_pct", F.round(F.col("total_readings") * 100.0 / F.nullif("expected_rows", F.lit(0)), 2))
    tests = [
        (F.col("fk_orphans") > 0, "FAIL", F.concat(F.lit("FK_ORPHANS: "), F.col("fk_orphans").cast("string"))),
        (F.col("capacity_breaches") > 0, "FAIL", F.concat(F.lit("CAPACITY_BREACH: "), F.col("capacity_breaches").cast("string"))),
        (F.col("grid_ok_pct") < 100.0, "FAIL", F.concat(F.lit("TIMESTAMP_GRID: "), F.round(100.0 - F.col("grid_ok_pct"), 2).cast("string"), F.lit("%"))),
        (~F.col("row_count_pct").between(95.0, 105.0), "FAIL", F.concat(F.lit("ROW_COUNT: "), F.col("total_readings").cast("string"))),
        (F.col("voltage_ok_pct") < 95.0, "WARN", F.concat(F.lit("VOLTAGE_BAND: "), F.col("voltage_ok_pct").cast("string"), F.lit("%"))),
        (F.col("pf_ok_pct") < 99.0, "WARN", F.concat(F.lit("POWER_FACTOR: "), F.col("pf_ok_pct").cast("string"), F.lit("%"))),
    ]
    verdict = F.coalesce(*[F.when(c, v) for c, v, _ in tests], F.lit("PASS"))
    reason = F.coalesce(*[F.when(c, r) for c, _, r in tests], F.lit(""))
    fields = ["fk_orphans", "total_readings", "expected_rows", "row_count_pct", "voltage_ok_pct", "pf_ok_pct", "grid_ok_pct", "capacity_breaches"]
    return m.select(verdict.alias("verdict"), reason.alias("reason"), *fields, F.to_json(F.struct(*fields)).alias("details"))


# ------------------------------------------------------------------ statistical shape

def _valid(readings: DataFrame) -> DataFrame:
    return readings.where(F.col("quality") == "VALID")


def _result(df: DataFrame, name: str, ok: Column, otherwise: str = "FAIL") -> DataFrame:
    return df.withColumns({"check_name": F.lit(name), "result": F.when(ok, "PASS").otherwise(otherwise)})


def hourly_weather(readings: DataFrame, weather: DataFrame) -> DataFrame:
    hourly = readings.groupBy(trunc("HOUR", F.col("reading_ts")).alias("hour")).agg(F.avg("usage_kwh").alias("avg_kwh"))
    return hourly.join(weather.select("hour", "temperature_f"), "hour")


def daily_variance(readings: DataFrame, lo: float = 5, hi: float = 30) -> DataFrame:
    days = _valid(readings).groupBy(F.to_date("reading_ts").alias("d")).agg((F.avg("usage_kwh") * 96).alias("k"))
    row = days.agg(F.round((F.max("k") - F.min("k")) / F.nullif(F.avg("k"), F.lit(0.0)) * 100, 2).alias("rel_range_pct"))
    return _result(row, "01_daily_variance", F.col("rel_range_pct").between(lo, hi))


def temp_corr(readings: DataFrame, weather: DataFrame, least: float = 0.40) -> DataFrame:
    row = hourly_weather(_valid(readings), weather).agg(F.corr("avg_kwh", "temperature_f").alias("c"))
    row = row.select(F.round("c", 4).alias("corr_value"), "c")
    return _result(row, "02_temp_corr", F.col("c") > least).drop("c")


def event_signal(readings: DataFrame, meters: DataFrame, pre: tuple[str, str], spike: tuple[str, str], post: tuple[str, str], max_lat: float = 29.70) -> DataFrame:
    """Coastal daily averages before, at and after an event."""
    coast = meters.where(F.col("lat") < max_lat).select("meter_id")
    days = readings.join(coast, "meter_id", "left_semi").groupBy(F.to_date("reading_ts").alias("d")).agg((F.avg("usage_kwh") * 96).alias("k"))

    def mean(span):
        return F.avg(F.when(F.col("d").between(*[F.lit(x).cast("date") for x in span]), F.col("k")))

    row = days.agg(mean(pre).alias("pre"), mean(spike).alias("spike"), mean(post).alias("post"))
    ok = (F.col("spike") > F.col("pre")) & (F.col("post") < F.col("pre"))
    return _result(row, "03_event_signal", ok).withColumns({c: F.round(c, 2) for c in ("pre", "spike", "post")})


def outage_zero(readings: DataFrame) -> DataFrame:
    row = readings.where(F.col("quality") == "OUTAGE").agg(F.count(F.lit(1)).alias("total_outage"), _ones(F.col("usage_kwh") != 0).alias("non_zero"))
    return _result(row, "04_outage_zeros", F.col("non_zero") == 0)


def weekend_ratio(readings: DataFrame, lo: float = 1.04, hi: float = 1.15) -> DataFrame:
    w = is_weekend(F.col("reading_ts"))
    row = _valid(readings).agg(F.avg(F.when(w, F.col("usage_kwh"))).alias("we"), F.avg(F.when(~w, F.col("usage_kwh"))).alias("wd"))
    row = row.select((F.col("we") / F.nullif("wd", F.lit(0.0))).alias("r"))
    return _result(row, "05_weekend_split", F.col("r").between(lo, hi)).withColumn("ratio", F.round("r", 4)).drop("r")


def holiday_ratio(readings: DataFrame, holiday: str, lo_day: str, hi_day: str, lo: float = 1.10, hi: float = 1.30) -> DataFrame:
    day = F.lit(holiday).cast("date")
    days = (
        _valid(readings)
        .groupBy(F.to_date("reading_ts").alias("d"))
        .agg(F.avg("usage_kwh").alias("k"))
        .where(F.col("d").between(F.lit(lo_day).cast("date"), F.lit(hi_day).cast("date")))
    )
    row = days.agg(F.max(F.when(F.col("d") == day, F.col("k"))).alias("h"), F.avg(F.when(F.col("d") != day, F.col("k"))).alias("o"))
    row = row.select((F.col("h") / F.nullif("o", F.lit(0.0))).alias("r"))
    return _result(row, "06_holiday_spike", F.col("r").between(lo, hi)).withColumn("ratio", F.round("r", 4)).drop("r")


def quintile_means(readings: DataFrame, base: DataFrame) -> DataFrame:
    """Mean daily kWh per quintile of a per-meter base load (meter_id, base)."""
    q = tiled(base, [F.col("base").asc(), F.col("meter_id").asc()], 5, "quintile").select("meter_id", "quintile")
    per = _valid(readings).groupBy("meter_id").agg(F.sum("usage_kwh").alias("s"), F.count("usage_kwh").alias("n"))
    return per.join(q, "meter_id").groupBy("quintile").agg((F.sum("s") / F.sum("n") * 96).alias("avg_daily_kwh"))


def monotone(readings: DataFrame, base: DataFrame) -> DataFrame:
    q = quintile_means(readings, base)
    cols = {f"q{i}": F.min(F.when(F.col("quintile") == i, F.col("avg_daily_kwh"))) for i in range(1, 6)}
    row = q.agg(*[c.alias(n) for n, c in cols.items()])
    ok = reduce(lambda a, b: a & b, [F.col(f"q{i}") < F.col(f"q{i + 1}") for i in range(1, 5)])
    return _result(row, "07_segment_ordering", ok).withColumns({n: F.round(n, 4) for n in cols})


def geo_cv(readings: DataFrame, meters: DataFrame, least: float = 3) -> DataFrame:
    per = _valid(readings).groupBy("meter_id").agg(F.sum("usage_kwh").alias("s"), F.count("usage_kwh").alias("n"))
    county = per.join(meters.select("meter_id", "county"), "meter_id").groupBy("county").agg((F.sum("s") / F.sum("n") * 96).alias("k"))
    row = county.agg((F.stddev_samp("k") / F.nullif(F.avg("k"), F.lit(0.0)) * 100).alias("cv"))
    return _result(row, "08_geographic_variance", F.col("cv") >= least).withColumn("cv_pct", F.round("cv", 2)).drop("cv")


def diurnal_ratio(readings: DataFrame, least: float = 1.8) -> DataFrame:
    hours = _valid(readings).groupBy(F.hour("reading_ts").alias("h")).agg(F.avg("usage_kwh").alias("k"))
    row = hours.agg(F.avg(F.when(F.col("h").between(17, 20), F.col("k"))).alias("e"), F.avg(F.when(F.col("h").between(0, 3), F.col("k"))).alias("o"))
    row = row.select((F.col("e") / F.nullif("o", F.lit(0.0))).alias("r"))
    return _result(row, "09_diurnal_ratio", F.col("r") >= least).withColumn("peak_ratio", F.round("r", 3)).drop("r")


def device_signatures(readings: DataFrame, personas: DataFrame) -> DataFrame:
    h, k = F.hour("reading_ts"), F.col("usage_kwh")
    per = _valid(readings).groupBy("meter_id").agg(
        F.avg(F.when(h.between(10, 16), k)).alias("day_kwh"), F.avg(F.when((h >= 23) | (h <= 5), k)).alias("night_kwh")
    )
    rows = per.join(personas.select("meter_id", "has_ev", "has_solar"), "meter_id")
    ratio = F.col("night_kwh") / F.nullif("day_kwh", F.lit(0.0))
    row = rows.agg(
        F.avg(F.when(F.col("has_ev"), ratio)).alias("ev"), F.avg(F.when(~F.col("has_ev"), ratio)).alias("no_ev"),
        F.avg(F.when(F.col("has_solar"), F.col("day_kwh"))).alias("solar"), F.avg(F.when(~F.col("has_solar"), F.col("day_kwh"))).alias("no_solar"),
    )
    ok = (F.col("solar") < F.col("no_solar")) & (F.col("ev") > F.col("no_ev"))
    return _result(row, "10_device_signatures", ok).select(
        "check_name", "result", F.round(F.col("solar") / F.nullif("no_solar", F.lit(0.0)), 4).alias("solar_ratio"),
        F.round("ev", 4).alias("ev_night_day_ratio"), F.round("no_ev", 4).alias("no_ev_night_day_ratio"),
    )


def load_parity(rebuilt: DataFrame, stored: DataFrame) -> DataFrame:
    """Largest gap between a re-aggregated and a stored transformer-hour."""
    s = stored.select("transformer_id", "load_hour", F.col("load_kw").alias("stored_kw"))
    row = rebuilt.join(s, ["transformer_id", "load_hour"]).agg(F.max(F.abs(F.col("load_kw") - F.col("stored_kw"))).alias("d"), F.count(F.lit(1)).alias("rows_compared"))
    return _result(row, "11_load_parity", F.col("d") < 0.01).withColumn("max_delta_kw", F.round("d", 6)).drop("d")


def capacity_sanity(hourly: DataFrame) -> DataFrame:
    row = hourly.agg(F.count(F.lit(1)).alias("n"), _ones(F.col("load_factor_pct") > 110).alias("overloaded_rows"))
    pct = F.col("overloaded_rows").cast("double") * 100.0 / F.nullif("n", F.lit(0))
    return _result(row.withColumn("p", pct), "12_capacity_sanity", F.col("p") < 5, "WARN").withColumn("overload_pct", F.round("p", 2)).drop("p", "n")


def physics(readings: DataFrame) -> DataFrame:
    """Median gap between kW from energy and kW from V x I x PF, over all valid rows."""
    gap = F.abs(F.col("usage_kwh") * 4.0 - F.col("voltage_v") * F.col("current_a") * F.col("power_factor") / 1000.0)
    rows = _valid(readings).select(gap.alias("g"))
    med = exact_percentiles(rows, [], "g", {"m": 0.5})
    row = med.select("m", rows.agg(F.avg("g").alias("a")).scalar().alias("a"))
    return _result(row, "13_physical_consistency", F.col("m") < 0.5).select(
        "check_name", "result", F.round("m", 4).alias("median_abs_delta_kw"), F.round("a", 4).alias("avg_abs_delta_kw")
    )


def row_band(readings: DataFrame, lo: int, hi: int) -> DataFrame:
    row = readings.agg(F.count(F.lit(1)).alias("actual_rows"))
    return _result(row, "14_row_count", F.col("actual_rows").between(lo, hi))


def chart_shape(readings: DataFrame, base: DataFrame) -> DataFrame:
    q = tiled(base, [F.col("base").asc(), F.col("meter_id").asc()], 5, "quintile").select("meter_id", "quintile")
    per = _valid(readings).groupBy("meter_id", F.to_date("reading_ts").alias("d")).agg(F.sum("usage_kwh").alias("s"), F.count("usage_kwh").alias("n"))
    return per.join(q, "meter_id").groupBy("d", "quintile").agg((F.sum("s") / F.sum("n") * 96).alias("avg_daily_kwh"))


def duplicate_slots(readings: DataFrame) -> DataFrame:
    """(meter, slot) pairs reported more than once."""
    return readings.groupBy("meter_id", slot(F.col("reading_ts")).alias("slot_ts")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def report(tables: list[TableChecks], profile: DataFrame, weather: DataFrame) -> DataFrame:
    """Every check of every table as (check_name, detail, measured, status): one aggregate per table, and the shape of the readings from its profile."""
    return union([t.rows() for t in tables] + [shape_checks(profile, weather)])

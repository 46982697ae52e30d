"""Deterministic load modelling: personas, expected load, topology expansion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wattline.functions.calendar import NTZ, is_weekend
from wattline.functions.geometry import offset_lat, offset_lon
from wattline.functions.hashing import keyed_normal, keyed_uniform, uniform_int
from wattline.functions.rules import class_bucket
from wattline.operators.ordering import positioned
from wattline.operators.relations import by_day, dealt, expand, with_days

# kWh per 15-minute slot by customer class.
BASE_KWH = {
    "LOW_INCOME": 0.18, "LOWER_MIDDLE": 0.30, "MIDDLE_INCOME": 0.45, "UPPER_MIDDLE": 0.65, "HIGH_INCOME": 0.95,
    "COM_SMALL": 0.85, "COM_LARGE": 4.50, "IND_LIGHT": 7.00, "IND_HEAVY": 45.00, "GOV_LOCAL": 1.60, "GOV_STATE": 2.20,
}
# Power factor by class; every other class has 0.97.
BASE_PF = {"IND_HEAVY": 0.85, "IND_LIGHT": 0.88, "COM_LARGE": 0.92, "COM_SMALL": 0.95}
# Adoption shares by class.
SOLAR_SHARE = {"HIGH_INCOME": 0.10, "UPPER_MIDDLE": 0.04, "MIDDLE_INCOME": 0.01}
EV_SHARE = {"HIGH_INCOME": 0.15, "UPPER_MIDDLE": 0.08, "MIDDLE_INCOME": 0.03}
POOL_SHARE = {"HIGH_INCOME": 0.25, "UPPER_MIDDLE": 0.12, "MIDDLE_INCOME": 0.12}
# Hourly multipliers, hours 0 to 23.
DIURNAL = {
    "RES": [0.55, 0.55, 0.55, 0.55, 0.60, 0.65, 1.10, 1.30, 1.20, 0.95, 0.85, 0.85,
            0.85, 0.85, 0.85, 0.85, 1.00, 1.30, 1.55, 1.50, 1.40, 1.20, 1.00, 0.90],
    "COM": [0.40, 0.40, 0.40, 0.40, 0.40, 0.50, 0.65, 0.95, 1.20, 1.30, 1.35, 1.35,
            1.30, 1.35, 1.35, 1.35, 1.25, 1.10, 0.85, 0.65, 0.55, 0.50, 0.45, 0.40],
    "IND": [0.85] * 6 + [1.05] * 16 + [0.90] * 2,
    "GOV": [0.20] * 7 + [0.50] + [1.30] * 10 + [0.50] * 2 + [0.20] * 4,
}
# Response per degree F above 72 and below 60, and per point of humidity away from 50.
COOLING = {"RES": 0.028, "COM": 0.020, "IND": 0.008, "GOV": 0.020}
HEATING = {"RES": 0.020, "COM": 0.012, "IND": 0.005, "GOV": 0.012}
HUMIDITY = {"RES": 0.0008, "COM": 0.0005, "IND": 0.0, "GOV": 0.0}
# Saturday, Sunday and holiday factors.
SATURDAY = {"RES": 1.07, "COM": 0.55, "IND": 0.85, "GOV": 0.30}
SUNDAY = {"RES": 1.10, "COM": 0.40, "IND": 0.85, "GOV": 0.30}
HOLIDAY = {"RES": 1.18, "COM": 0.45, "IND": 0.55, "GOV": 0.30}
# Segment profiles by hour.
PROFILES = {
    "RESIDENTIAL": [0.4, 0.35, 0.3, 0.3, 0.35, 0.5, 0.7, 0.9, 0.8, 0.6, 0.5, 0.5,
                    0.5, 0.5, 0.6, 0.7, 0.9, 1.0, 1.0, 0.95, 0.85, 0.7, 0.55, 0.45],
    "COMMERCIAL": [0.3, 0.3, 0.3, 0.3, 0.35, 0.5, 0.7, 0.9, 1.0, 1.0, 1.0, 1.0,
                   0.9, 1.0, 1.0, 1.0, 1.0, 0.9, 0.7, 0.5, 0.4, 0.35, 0.3, 0.3],
    "INDUSTRIAL": [0.8, 0.8, 0.8, 0.8, 0.85, 0.9, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0,
                   0.9, 1.0, 1.0, 1.0, 1.0, 1.0, 0.95, 0.9, 0.85, 0.8, 0.8, 0.8],
}


def _lookup(key: Column, table: dict[str, float], default: float | None = None) -> Column:
    pairs = [x for name, value in table.items() for x in (F.lit(name), F.lit(float(value)))]
    found = F.element_at(F.create_map(*pairs), key)
    return found if default is None else F.coalesce(found, F.lit(default))


def _lookup_curve(name: Column, table: dict[str, list[float]]) -> Column:
    """The 24 values of a class as an array column."""
    pairs = [x for k, row in table.items() for x in (F.lit(k), F.array(*[F.lit(float(v)) for v in row]))]
    return F.element_at(F.create_map(*pairs), name)


# Customer class of each market segment of the derived tables.
SEGMENT_CLASS = {
    "HOUSEHOLD": "HIGH_INCOME", "BUILDING": "COM_SMALL", "FURNITURE": "COM_LARGE", "MACHINERY": "IND_LIGHT", "AUTOMOBILE": "GOV_LOCAL",
}


def class_of_segment(segment: Column) -> Column:
    pairs = [x for k, v in SEGMENT_CLASS.items() for x in (F.lit(k), F.lit(v))]
    return F.element_at(F.create_map(*pairs), segment)


def with_multiplier(customers: DataFrame, config: DataFrame, default: float) -> DataFrame:
    return customers.join(config, "segment", "left").withColumns(
        {"load_multiplier": F.coalesce("load_multiplier", F.lit(default)), "solar_eligible": F.coalesce("solar_eligible", F.lit(False))}
    )


def personas(meters: DataFrame) -> DataFrame:
    """Stable attributes per meter; input needs meter_id, transformer_id, lat and customer_class."""
    m, c, lat = F.col("meter_id"), F.col("customer_class"), F.col("lat")

    def adopts(salt: str, shares: dict[str, float]) -> Column:
        return keyed_uniform(m, salt) < _lookup(c, shares, 0.0)

    climate = (
        F.when(lat >= 30.10, -2.5).when(lat >= 29.95, -1.5).when(lat >= 29.75, -0.5).when(lat <= 29.50, 1.5).otherwise(0.0)
    )
    return meters.select(
        "meter_id",
        "transformer_id",
        "lat",
        "customer_class",
        class_bucket(c).alias("class_bucket"),
        F.round(F.lit(0.70) + F.lit(0.60) * keyed_uniform(m, "_size"), 3).alias("home_size_factor"),
        adopts("_solar", SOLAR_SHARE).alias("has_solar"),
        adopts("_ev", EV_SHARE).alias("has_ev"),
        (adopts("_pool", POOL_SHARE) & (lat > 29.7)).alias("has_pool_pump"),
        climate.alias("microclimate_offset_f"),
        _lookup(c, BASE_PF, 0.97).alias("pf_base"),
        _lookup(c, BASE_KWH, 0.50).alias("base_per_15min"),
    )


def expected_load(
    people: DataFrame,
    spine: DataFrame,
    weather: DataFrame,
    outage_slots: DataFrame,
    holidays: list[str] = (),
    pre_storm: tuple[str, str] | None = None,
    noise: bool = False,
    kwh_digits: int = 4,
) -> DataFrame:
    """Meter x slot energy and electrical values.

    Rows are meters, then meter-days, then slots. Outage slots are folded per transformer and day (at most one entry per slot of a day)
    and joined to the meter-days, so the expanded rows meet nothing but the hourly weather and are never shuffled by key.
    """
    dark = outage_slots.groupBy("transformer_id", F.to_date("slot_ts").alias("_day")).agg(F.collect_set("slot_ts").alias("_dark"))
    none = F.array().cast(f"array<{NTZ}>")
    b = F.col("class_bucket")
    # class-dependent numbers are looked up once per meter, not once per slot
    per_meter = {"_curve": _lookup_curve(b, DIURNAL)}
    per_meter |= {f"_{n}": _lookup(b, t) for n, t in (("cool", COOLING), ("heat", HEATING), ("damp", HUMIDITY), ("sat", SATURDAY), ("sun", SUNDAY), ("feast", HOLIDAY))}
    days = with_days(people.withColumns(per_meter), spine, "slot_ts")
    met = dealt(days.join(dark, ["transformer_id", "_day"], "left")).withColumn("_dark", F.coalesce("_dark", none))
    ready = met.join(F.broadcast(by_day(spine, "slot_ts")), "_day")

    def tagged(slots: Column, out: bool) -> Column:
        return F.transform(slots, lambda s: F.struct(s.alias("slot_ts"), F.lit(out).alias("_out")))

    both = F.concat(tagged(F.array_except("_steps", "_dark"), False), tagged(F.array_intersect("_steps", "_dark"), True))
    slots = ready.withColumn("_slot", F.explode(both)).drop("_steps", "_dark").select("*", "_slot.*").drop("_slot")
    w = weather.select(F.col("hour").alias("_hour"), "temperature_f", "humidity_pct")
    rows = slots.withColumn("_hour", F.date_trunc("HOUR", "slot_ts").cast(NTZ)).join(w, "_hour", "left")
    hour = F.hour("slot_ts")
    temp = F.coalesce("temperature_f", F.lit(85.0)) + F.col("microclimate_offset_f")
    hvac = (
        F.lit(1.0)
        + F.col("_cool") * F.greatest(F.lit(0.0), temp - 72.0)
        + F.col("_heat") * F.greatest(F.lit(0.0), F.lit(60.0) - temp)
        + F.col("_damp") * (F.coalesce("humidity_pct", F.lit(70.0)) - 50.0)
    )
    dow = F.dayofweek("slot_ts")
    week = F.when(dow == 1, F.col("_sun")).when(dow == 7, F.col("_sat")).otherwise(1.0)
    feast = F.when(F.to_date("slot_ts").cast("string").isin(list(holidays) or ["none"]), F.col("_feast")).otherwise(1.0)
    storm = F.lit(1.0)
    if pre_storm is not None:
        span = F.col("slot_ts").between(*[F.lit(x).cast(NTZ) for x in pre_storm])
        storm = F.when(span & (F.col("lat") < 29.95), 1.15).otherwise(1.0)
    solar = F.when(F.col("has_solar") & hour.between(10, 16), 0.55).otherwise(1.0)
    key = F.concat_ws("@", "meter_id", F.date_format("slot_ts", "yyyyMMddHHmm"))
    shake = F.exp(F.lit(0.13) * keyed_normal(key, "kwh")) if noise else F.lit(1.0)
    kwh = (
        F.col("base_per_15min") * F.element_at("_curve", hour + 1) * hvac * week * feast * storm * F.col("home_size_factor") * solar * shake
        + F.when(F.col("has_ev") & ((hour >= 23) | (hour <= 5)), 0.40).otherwise(0.0)
        + F.when(F.col("has_pool_pump") & hour.between(4, 7), 0.25).otherwise(0.0)
    )
    volts = F.lit(120.0) - F.lit(4.0) * (F.col("base_per_15min") / 5.0)
    amps = F.greatest(F.lit(0.01), F.col("base_per_15min") * F.col("home_size_factor") * 4.0 * 1000.0 / F.nullif(120.0 * F.col("pf_base"), F.lit(0.0)))
    pf = F.least(F.lit(0.999), F.greatest(F.lit(0.700), F.col("pf_base")))
    if noise:
        volts = volts + F.lit(0.8) * keyed_normal(key, "v")
        amps = F.greatest(F.lit(0.01), amps + F.lit(0.3) * keyed_normal(key, "a"))
        pf = F.least(F.lit(0.999), F.greatest(F.lit(0.700), F.col("pf_base") + F.lit(0.015) * keyed_normal(key, "pf")))
    out = F.col("_out")

    def live(value: Column, digits: int) -> Column:
        return F.round(F.when(out, 0.0).otherwise(value), digits)

    return rows.select(
        "meter_id",
        F.col("slot_ts").alias("reading_ts"),
        live(kwh, kwh_digits).alias("usage_kwh"),
        live(volts, 2).alias("voltage_v"),
        live(amps, 2).alias("current_a"),
        live(pf, 3).alias("power_factor"),
        F.when(out, "OUTAGE").otherwise("VALID").alias("quality"),
    )


def simple_load(meters: DataFrame, spine: DataFrame) -> DataFrame:
    """Base by meter type x time-of-day factor, keyed noise of 0.8 to 1.2."""
    hour = F.hour("slot_ts")
    # kW by meter type and factors by hour band.
    base = _lookup(F.col("meter_type"), {"RESIDENTIAL": 1.5, "COMMERCIAL": 15.0, "INDUSTRIAL": 150.0}, 2.0)
    factor = F.when(hour.between(6, 9), 1.5).when(hour.between(17, 21), 1.8).when(hour.between(0, 5), 0.4).otherwise(1.0)
    key = F.concat_ws("@", "meter_id", F.date_format("slot_ts", "yyyyMMddHHmm"))
    rows = expand(meters.select("meter_id", "meter_type"), spine, "slot_ts")
    kwh = base * 0.25 * factor * (F.lit(0.8) + keyed_uniform(key, "kwh") * 0.4)
    return rows.select("meter_id", F.col("slot_ts").alias("reading_ts"), F.round(kwh, 3).alias("usage_kwh"))


def profile_load(meters: DataFrame, spine: DataFrame, base_kwh: Column) -> DataFrame:
    """Segment profile by hour x season x commercial weekend."""
    ready = meters.withColumns({"_base": base_kwh, "_curve": _lookup_curve(F.col("profile"), PROFILES)})
    rows = expand(ready.select("meter_id", "profile", "_base", "_curve"), spine, "slot_ts")
    month = F.month("slot_ts")
    season = F.when(month.isin(6, 7, 8), 1.4).when(month.isin(12, 1, 2), 1.1).otherwise(1.0)
    weekend = F.when((F.col("profile") == "COMMERCIAL") & is_weekend(F.col("slot_ts")), 0.3).otherwise(1.0)
    kwh = F.col("_base") * F.element_at("_curve", F.hour("slot_ts") + 1) * season * weekend
    return rows.select("meter_id", F.col("slot_ts").alias("reading_ts"), F.round(kwh, 3).alias("usage_kwh"))


def place(df: DataFrame, key: str, radius_km: float, lat: str, lon: str, out_lat: str = "lat", out_lon: str = "lon") -> DataFrame:
    """Area-uniform placement inside a disc round (lat, lon)."""
    k = F.col(key)
    km = F.lit(radius_km) * F.sqrt(keyed_uniform(k, "radius"))
    bearing = F.lit(2.0) * F.pi() * keyed_uniform(k, "bearing")
    a, o = F.col(lat), F.col(lon)
    return df.withColumns(
        {out_lat: F.round(offset_lat(a, km, bearing), 6), out_lon: F.round(offset_lon(a, o, km, bearing), 6)}
    )


def expand_circuits(substations: DataFrame) -> DataFrame:
    """20 to 45 feeders per substation, within 5.5 km."""
    n = uniform_int(20, 45, F.concat(F.col("substation_id"), F.lit("ncirc")))
    rows = substations.select(
        "substation_id", F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon"), F.explode(F.sequence(F.lit(1).cast("bigint"), n)).alias("seq")
    ).withColumn("circuit_id", F.concat(F.lit("FEEDER-"), F.col("substation_id"), F.lit("-"), F.lpad(F.col("seq").cast("string"), 2, "0")))
    placed = place(rows, "circuit_id", 5.5, "s_lat", "s_lon")
    out = keyed_uniform(F.col("circuit_id"), "status") >= 0.985
    return placed.select("circuit_id", "substation_id", "seq", F.when(out, "OUTAGE").otherwise("ENERGIZED").alias("status"), "lat", "lon")


# Nameplate ratings.
RATINGS_KVA = [15.0, 25.0, 37.5, 50.0, 75.0, 100.0, 167.0, 250.0, 333.0, 500.0, 750.0, 1000.0]


def expand_transformers(circuits: DataFrame) -> DataFrame:
    """3 to 20 transformers per circuit, within 4 km; ids are positions in (circuit, sequence) order."""
    n = uniform_int(3, 20, F.concat(F.col("circuit_id"), F.lit("nxfmr")))
    rows = circuits.select(
        "circuit_id", "substation_id", F.col("lat").alias("c_lat"), F.col("lon").alias("c_lon"), F.explode(F.sequence(F.lit(1).cast("bigint"), n)).alias("seq")
    )
    numbered = positioned(rows, [F.col("circuit_id").asc(), F.col("seq").asc()], position="pos").withColumn(
        "transformer_id", F.concat(F.lit("XFMR-HOU-"), F.lpad(F.col("pos").cast("string"), 6, "0"))
    )
    placed = place(numbered, "transformer_id", 4.0, "c_lat", "c_lon")
    t = F.col("transformer_id")
    kva = F.element_at(F.array(*[F.lit(v) for v in RATINGS_KVA]), uniform_int(1, 12, F.concat(t, F.lit("kva"))).cast("int"))
    return placed.select(
        "transformer_id", "circuit_id", "substation_id", "lat", "lon", kva.alias("rated_kva"),
        uniform_int(1972, 2025, F.concat(t, F.lit("year"))).alias("install_year"),
        F.round(F.lit(28.0) + F.lit(71.0) * keyed_uniform(t, "health"), 1).alias("health_score"),
    )


def expand_poles(transformers: DataFrame) -> DataFrame:
    """A pole for 68 % of the transformers, within 320 m."""
    picked = transformers.where(keyed_uniform(F.col("transformer_id"), "haspole") < 0.68).select(
        "transformer_id", "circuit_id", "substation_id", F.col("lat").alias("t_lat"), F.col("lon").alias("t_lon")
    )
    numbered = positioned(picked, [F.col("transformer_id").asc()], position="pos").withColumn(
        "pole_id", F.concat(F.lit("POLE-HOU-"), F.lpad(F.col("pos").cast("string"), 6, "0"))
    )
    return place(numbered, "pole_id", 0.32, "t_lat", "t_lon").select("pole_id", "transformer_id", "circuit_id", "substation_id", "lat", "lon")


def relink_meters(meters: DataFrame, poles: DataFrame) -> DataFrame:
    """Bind every meter to a pole by its own key and place it within 360 m."""
    from wattline.operators.relations import relink

    linked = relink(meters.select("meter_id"), "meter_id", poles, "pole_id")
    where = poles.select("pole_id", "transformer_id", "circuit_id", "substation_id", F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"))
    return place(linked.join(where, "pole_id"), "meter_id", 0.36, "p_lat", "p_lon").drop("p_lat", "p_lon")

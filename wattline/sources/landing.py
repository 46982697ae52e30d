"""Raw JSON landing, payload columns and statuses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

READING_JSON = "meter_id string, reading_ts timestamp_ntz, usage_kwh double, voltage_v double, power_factor double"


def land_json(df: DataFrame, payload: str, source: str, ingested_at: Column | None = None) -> DataFrame:
    """Keep the payload as it came, with ingest time, source and a processed flag."""
    return df.select(
        F.col(payload).alias("payload"),
        (ingested_at if ingested_at is not None else F.current_timestamp()).alias("ingested_at"),
        F.lit(source).alias("source"),
        F.lit(False).alias("processed"),
    )


def parse_readings(landed: DataFrame, schema: str = READING_JSON) -> DataFrame:
    """Typed readings; a payload that does not parse yields NULL columns and is left out."""
    parsed = landed.withColumn("r", F.from_json("payload", schema, {"mode": "PERMISSIVE"}))
    return parsed.where("r.meter_id IS NOT NULL").select("r.*", "ingested_at", "source")


def to_payload(df: DataFrame, cols: list[str] | None = None, out: str = "payload") -> DataFrame:
    """JSON of the named columns or of the whole row; NULL fields are left out."""
    return df.withColumn(out, F.to_json(F.struct(*(cols or df.columns))))


def run_status(runs: DataFrame, col: str) -> DataFrame:
    v = F.try_parse_json(F.col(col))
    return runs.withColumns(
        {"verdict": F.try_variant_get(v, "$.verdict", "string"), "reason": F.try_variant_get(v, "$.reason", "string")}
    )

"""Structured Streaming over file sources.

Policy for late data: every job sets a watermark; rows older than the largest event time seen minus the delay are
dropped from windows. ``LateRows`` routes them to a table beside the stream; ``late_split`` flags them in a table at rest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from wattline.functions import rules
from wattline.session import scratch_path

# Staging shapes of captured changes.
SCHEMAS = {
    "readings_cdc": "meter_id string, reading_ts timestamp_ntz, usage_kwh double, voltage_v double, operation string, cdc_ts timestamp_ntz",
    "telemetry_cdc": "transformer_id string, sample_ts timestamp_ntz, load_kw double, oil_temp_c double, operation string, cdc_ts timestamp_ntz",
    "work_orders_cdc": "work_order_id string, asset_id string, status string, priority string, operation string, cdc_ts timestamp_ntz",
    "outages_cdc": "outage_id string, transformer_id string, status string, start_ts timestamp_ntz, end_ts timestamp_ntz, customers bigint, operation string, cdc_ts timestamp_ntz",
}


def stream_parquet(spark: SparkSession, folder: str, schema: StructType, glob: str = "*.parquet", files_per_batch: int = 1000) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def with_ingest(stream: DataFrame, source: str) -> DataFrame:
    return stream.withColumns({"ingested_at": F.current_timestamp(), "source": F.lit(source)})


def drain(stream: DataFrame, label: str, mode: str = "append", partition_by: list[str] | None = None) -> DataFrame:
    """Run what is available now into a Parquet folder below the shared folder and return it as a table."""
    spark = stream.sparkSession
    base = scratch_path(spark, label)
    writer = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{base}/state")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    query = writer.trigger(availableNow=True).start(f"{base}/rows")
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")


def drain_batches(stream: DataFrame, label: str, each: Callable[[DataFrame, int], None], mode: str = "append", every: str | None = None):
    """foreachBatch job: available data once, or a trigger every so often; empty batches are skipped."""
    base = scratch_path(stream.sparkSession, label)

    def step(batch: DataFrame, epoch: int) -> None:
        if not batch.isEmpty():
            each(batch, epoch)

    writer = stream.writeStream.foreachBatch(step).outputMode(mode).option("checkpointLocation", f"{base}/state")
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


def on_event_time(stream: DataFrame, delay: str, col: str = "reading_ts") -> DataFrame:
    """Watermarks need a zoned timestamp; the session zone is UTC, so the values stay the same."""
    return stream.withColumn(col, F.col(col).cast("timestamp_ltz")).withWatermark(col, delay)


def plain(name: str):
    return F.col(name).cast("timestamp_ntz")


def tumbling(stream: DataFrame, size: str = "15 minutes", delay: str = "30 minutes") -> DataFrame:
    rows = on_event_time(stream, delay)
    return (
        rows.groupBy(F.window("reading_ts", size).alias("w"))
        .agg(F.count(F.lit(1)).alias("reading_count"), F.sum("usage_kwh").alias("total_kwh"), F.avg("voltage_v").alias("avg_voltage"))
        .select(plain("w.start").alias("window_start"), plain("w.end").alias("window_end"), "reading_count", "total_kwh", "avg_voltage")
    )


def rolling_circuit_health(stream: DataFrame, meters: DataFrame, size: str = "1 hour", slide: str = "15 minutes", delay: str = "30 minutes") -> DataFrame:
    """Sliding circuit state with the exact number of meters; the meter table is a static join side.

    Two aggregations in a row: readings are combined per window, circuit and meter, and once the watermark has closed a window its
    meters are counted. The state is one short row per meter and open window.
    """
    keyed = on_event_time(stream, delay).join(meters.select("meter_id", "circuit_id"), "meter_id")
    per_meter = keyed.groupBy(F.window("reading_ts", size, slide).alias("w"), "circuit_id", "meter_id").agg(
        *[f(c).alias(f"{n}_{c}") for c in ("voltage_v", "usage_kwh") for n, f in (("sum", F.sum), ("n", F.count))],
        F.sum(F.when(F.col("voltage_v") < rules.SAG_V, 1).otherwise(0)).alias("low"), F.sum(F.when(F.col("usage_kwh") == 0, 1).otherwise(0)).alias("zero"),
    )
    return (
        per_meter.groupBy("w", "circuit_id")
        .agg(
            F.count(F.lit(1)).alias("active_meters"),
            *[(F.sum(f"sum_{c}") / F.nullif(F.sum(f"n_{c}"), F.lit(0))).alias(out) for c, out in (("voltage_v", "avg_voltage"), ("usage_kwh", "avg_usage_kwh"))],
            F.sum("low").alias("low_voltage_count"), F.sum("zero").alias("zero_usage_count"),
        )
        .select(plain("w.start").alias("window_start"), "circuit_id", "active_meters", "avg_voltage", "avg_usage_kwh", "low_voltage_count", "zero_usage_count")
    )


def dedup(stream: DataFrame, keys: list[str], delay: str = "1 hour") -> DataFrame:
    """One row per key while its state is kept, that is within the delay of the newest event."""
    return on_event_time(stream, delay).dropDuplicatesWithinWatermark(keys).withColumn("reading_ts", plain("reading_ts"))


def outage_sessions(stream: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Out-of-service readings of a meter at most ``gap`` apart form one event."""
    out = on_event_time(stream.where(rules.is_outage(F.col("usage_kwh"), F.col("voltage_v"))), delay)
    return (
        out.groupBy(F.session_window("reading_ts", gap).alias("w"), "meter_id")
        .agg(F.count(F.lit(1)).alias("intervals"))
        .select("meter_id", plain("w.start").alias("session_start"), plain("w.end").alias("session_end"), "intervals")
    )


STRESS_OUT = "transformer_id string, load_hour timestamp_ntz, load_factor_pct double, consecutive_hours bigint"


def stress_runs(stream: DataFrame, limit: float = 100.0) -> DataFrame:
    """Running count of consecutive hours above the limit, kept as state per transformer.

    Rows of one batch are put in time order per key; the state is two numbers (last hour, run length).  The input has
    one row per (transformer, hour), so a key brings at most one row per hour of the batch; ``maxFilesPerTrigger``
    bounds the hours.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values("load_hour")
        hours = rows["load_hour"].to_numpy("datetime64[h]").astype("int64")
        over = (rows["load_factor_pct"] > limit).to_numpy()
        last, run = state.get if state.exists else (None, 0)
        # A row goes on with the run before it if that is the hour before; a run's length is its place since the last break.
        follows = np.diff(hours, prepend=hours[0] - 1 if last is None else last) == 1
        carried = run if follows[0] and last is not None else 0
        place = np.arange(len(hours))
        starts = np.maximum.accumulate(np.where(~follows | ~over | ~np.concatenate([[True], over[:-1]]), place, 0))
        runs = np.where(over, place - starts + np.where(over[starts], 1, 0) + np.where(starts == 0, np.where(over[0], carried, 0), 0), 0)
        state.update((int(hours[-1]), int(runs[-1])))
        yield pd.DataFrame(
            {"transformer_id": key[0], "load_hour": rows["load_hour"].values, "load_factor_pct": rows["load_factor_pct"].values, "consecutive_hours": runs}
        )

    grouped = stream.select("transformer_id", "load_hour", "load_factor_pct").groupBy("transformer_id")
    return grouped.applyInPandasWithState(step, STRESS_OUT, "last bigint, run bigint", "append", GroupStateTimeout.NoTimeout)


class LateRows:
    """A running stream's rows in two parts: those that arrive in time, and those at or behind the watermark, which windows would drop.

    The watermark is Spark's own: the newest event time of all batches before, in milliseconds, less the delay. Batches are written to a
    folder each, so that one that runs again replaces its rows, with the newest time so far beside them.
    """

    def __init__(self, spark: SparkSession, ts_col: str, delay: str, base: str | None = None):
        self.spark, self.ts_col, self.delay = spark, ts_col, delay
        self.base = base or scratch_path(spark, "late-rows")

    def _newest_before(self, epoch: int):
        """The newest event time before a batch, or None; each batch's record covers all before it."""
        if epoch == 0:
            return None
        records = self.spark.read.schema("newest timestamp_ntz, epoch bigint").parquet(f"{self.base}/newest")
        return records.where(F.col("epoch") < epoch).agg(F.max("newest")).first()[0]

    def _step(self, batch: DataFrame, epoch: int) -> None:
        newest = self._newest_before(epoch)
        at = F.col(self.ts_col)
        edge = F.date_trunc("MILLISECOND", F.lit(newest)).cast("timestamp_ntz") - F.expr(f"interval {self.delay}")
        late = F.lit(False) if newest is None else F.coalesce(at <= edge, F.lit(False))
        batch.withColumn("is_late", late).write.mode("overwrite").partitionBy("is_late").parquet(f"{self.base}/rows/epoch={epoch}")
        seen = self._table(batch.schema).where(F.col("epoch") == epoch).agg(F.max(self.ts_col).alias("newest"))
        before = F.lit(newest).cast("timestamp_ntz")
        seen.select(F.greatest("newest", before).alias("newest")).write.mode("overwrite").parquet(f"{self.base}/newest/epoch={epoch}")

    def _table(self, schema: StructType) -> DataFrame:
        kept = StructType([*schema.fields, *StructType.fromDDL("epoch bigint, is_late boolean").fields])
        return self.spark.read.schema(kept).parquet(f"{self.base}/rows")

    def take(self, stream: DataFrame) -> DataFrame:
        """Route what is available now; later calls go on from there. Returns all rows so far with ``epoch`` and ``is_late``."""
        writer = stream.writeStream.foreachBatch(self._step).option("checkpointLocation", f"{self.base}/state")
        writer.trigger(availableNow=True).start().awaitTermination()
        return self._table(stream.schema)


def dropped_by_watermark(progress: list[dict]) -> int:
    """Rows that a query's stateful operators dropped as late, from its progress reports."""
    return sum(op["numRowsDroppedByWatermark"] for report in progress for op in report["stateOperators"])


def late_split(rows: DataFrame, ts_col: str, delay: str) -> DataFrame:
    """Rows flagged late when older than the newest event minus the delay."""
    newest = rows.agg(F.max(ts_col)).scalar()
    return rows.withColumn("is_late", F.col(ts_col) < newest - F.expr(f"interval {delay}"))

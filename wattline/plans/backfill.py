"""Day-by-day backfill with a run log and a stop on a failed gate."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession


def backfill(
    spark: SparkSession,
    days: list[str],
    build: Callable[[str], DataFrame],
    gate: Callable[[DataFrame, str], DataFrame],
    path: str,
    dry_run: bool = False,
    paused: Callable[[], bool] = lambda: False,
    keep_going: bool = False,
) -> DataFrame:
    """Write one ``day=`` partition per day; each is validated after it is written.

    A day that fails, raises or meets the pause flag ends the run; with ``keep_going`` days that fail are logged and the next one follows.  Days are independent Spark jobs; rerunning one
    replaces its partition.
    """
    log = []
    for day in days:
        if paused():
            log.append((day, "PAUSED", None, "", _now()))
            break
        try:
            if dry_run:
                log.append((day, "DRY_RUN", None, "", _now()))
                continue
            target = f"{path}/day={day}"
            build(day).write.mode("overwrite").parquet(target)
            written = spark.read.parquet(target)
            result = gate(written, day).first()
            log.append((day, result["verdict"], written.count(), result["reason"], _now()))
            if result["verdict"] == "FAIL" and not keep_going:
                break
        except Exception as error:  # the log keeps the failure, the run stops
            log.append((day, "ERROR", None, str(error)[:500], _now()))
            break
    return spark.createDataFrame(log, "day string, status string, row_count bigint, reason string, logged_at string")


def _now() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M:%S")

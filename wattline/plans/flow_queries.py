"""Named queries for files, table changes, streams and text."""

from __future__ import annotations

import json

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wattline.functions.calendar import NTZ
from wattline.operators import maintenance as T
from wattline.operators import relations as J
from wattline.operators import search as X, text_index
from wattline.plans.network_queries import r8
from wattline.plans.oracle import u
from wattline.plans.registry import register
from wattline.session import scratch_path
from wattline.sources import files as IO
from wattline.sources import incremental as INC
from wattline.sources import landing
from wattline.sources.derived import readings_of
from wattline.sources.spines import seed_if_empty, time_spine
from wattline.streaming import changes as C
from wattline.streaming import jobs as ST

NAMESPACE = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"


# ---------------------------------------------------------------- files

def _schema(text: str) -> StructType:
    return StructType.fromDDL(text)


@register("csv_load", "SELECT transformer_id, rated_kva, health_score, CASE WHEN k%6=0 THEN NULL ELSE manufacturer END AS manufacturer FROM transformers")
def csv_load(g):
    path = scratch_path(g.spark, "csv")
    k = F.col("k") % 6
    odd = F.when(k == 0, F.element_at(F.array(F.lit("NULL"), F.lit("None")), (F.col("k") % 2 + 1).cast("int"))).otherwise(F.col("manufacturer"))
    g.transformers.select("transformer_id", "rated_kva", "health_score", odd.alias("manufacturer")).write.csv(path, header=True)
    return IO.load_csv(g.spark, path, _schema("transformer_id string, rated_kva int, health_score double, manufacturer string"))


@register("safe_cast_load", """
SELECT outage_id AS id, CASE WHEN nr%11=0 THEN NULL ELSE cast(start_ts AS date) END AS start_date, customers AS customers FROM (SELECT *, cast(substr(outage_id,5) AS bigint) AS nr FROM outages) WHERE nr%3<>0""")
def safe_cast_load(g):
    nr = F.substring("outage_id", 5, 20).cast("bigint")
    rows = g.outages.select(
        F.col("outage_id").alias("a"),
        F.when(nr % 11 == 0, "not a date").otherwise(F.date_format("start_ts", "yyyy-MM-dd")).alias("b"),
        F.when(nr % 3 == 0, "x").otherwise(F.col("customers").cast("string")).alias("c"),
    )
    return IO.project_typed(rows, {"id": ("a", "string"), "start_date": ("b", "date"), "customers": ("c", "bigint")}, ["customers"])


@register("parquet_load_by_name", "SELECT c_custkey AS C_CUSTKEY, c_name AS C_NAME, NULL::varchar AS PHONE FROM customer")
def parquet_load_by_name(g):
    return IO.load_by_name(g.spark, f"{g.folder}/customer.parquet", _schema("C_CUSTKEY bigint, C_NAME string, PHONE string"))


@register("bulk_ingest", "SELECT count(*) AS row_count, min(ts) AS first_ts, max(ts) AS last_ts, count(DISTINCT user_id) AS distinct_keys FROM events")
def bulk_ingest(g):
    return IO.ingest(g.spark, f"{g.folder}/events.parquet", "ts", "user_id")[1]


@register("parquet_export", "SELECT transformer_id, circuit_id, rated_kva FROM transformers")
def parquet_export(g):
    path = scratch_path(g.spark, "export")
    IO.export(g.transformers, path, ["transformer_id", "circuit_id", "rated_kva"], 500)
    return g.spark.read.parquet(path)


@register("sample_export", f"SELECT outage_id, cause FROM outages ORDER BY {u("outage_id||'3'")}, outage_id LIMIT 100")
def sample_export(g):
    path = scratch_path(g.spark, "sample")
    IO.export(IO.sample_rows(g.outages.select("outage_id", "cause"), 100, "outage_id", 3), path)
    return g.spark.read.parquet(path)


@register("manifest_build", "SELECT '{\"version\":\"1.0\",\"table_count\":2,\"files\":[{\"table\":\"substations\",\"file\":\"x/substations.parquet\",\"rows\":'||(SELECT count(*) FROM substations)||'},{\"table\":\"meters\",\"file\":\"x/meters.parquet\",\"rows\":'||(SELECT count(*) FROM meters)||'}]}' AS manifest")
def manifest_build(g):
    return IO.build_manifest({"substations": g.substations, "meters": g.meters}, "x")


@register("manifest_load", "SELECT 'nation' AS table_name, count(*) AS row_count FROM nation UNION ALL SELECT 'part', 2*count(*) FROM part")
def manifest_load(g):
    target = scratch_path(g.spark, "manifest")
    part = {"table": "part", "file": f"{g.folder}/part.parquet"}
    spec = {"files": [{"table": "nation", "file": f"{g.folder}/nation.parquet"}, part, {**part, "truncate": False}]}
    IO.load_manifest(g.spark, json.dumps(spec), target)
    from wattline.operators.quality import table_counts

    return table_counts({n: g.spark.read.parquet(f"{target}/{n}") for n in ("nation", "part")})


@register("jdbc_incremental_read", "SELECT outage_id, start_ts FROM outages WHERE start_ts > timestamp '2024-01-20 12:00:00'")
def jdbc_incremental_read(g):
    edge = F.lit("2024-01-20 12:00:00").cast(NTZ)
    copied = g.outages.where(F.col("start_ts") <= edge)
    mark = copied.unionByName(g.outages.where(F.col("start_ts") == edge).limit(0))
    return INC.incremental(g.outages, mark, "start_ts", ["outage_id"]).select("outage_id", "start_ts")


@register("jdbc_full_refresh", "SELECT substation_id, 'POINT('||cast(round(lon*100)::int AS varchar)||' '||cast(round(lat*100)::int AS varchar)||')' AS geom_wkt FROM substations")
def jdbc_full_refresh(g):
    path = scratch_path(g.spark, "refresh")
    rows = g.substations.select("substation_id", F.round(F.col("lat") * 100).cast("int").alias("lat"), F.round(F.col("lon") * 100).cast("int").alias("lon"))
    INC.full_refresh(INC.with_point(rows).select("substation_id", "geom_wkt"), path=path)
    return g.spark.read.parquet(path)


@register("idempotent_append", """
SELECT outage_id, s[1:8]||'-'||s[9:12]||'-5'||s[14:16]||'-'||lower(printf('%x', (cast('0x'||s[17:17] AS int)%4)+8))||s[18:20]||'-'||s[21:32] AS row_id
FROM (SELECT outage_id, sha1(from_hex('6ba7b8119dad11d180b400c04fd430c8')||cast(outage_id AS blob)) AS s FROM outages)""")
def idempotent_append(g):
    keyed = INC.with_uuid_key(g.outages.select("outage_id"), NAMESPACE, "outage_id")
    half = keyed.where("cast(substring(outage_id, 5) as bigint) % 2 = 0")
    once = half.unionByName(INC.append_new(half, keyed, "row_id").select(*half.columns))
    return once.unionByName(INC.append_new(once, keyed, "row_id").select(*half.columns))


FILES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@register("file_listing", " UNION ALL ".join(f"SELECT '{t}.parquet' AS name, true AS has_bytes, count(*) AS row_count FROM {t}" for t in FILES))
def file_listing(g):
    """Every Parquet file of the folder with its rows, which are counted from the files' footers."""
    listed = IO.list_docs(g.spark, g.folder, ".parquet").select(F.element_at(F.split("path", "/"), -1).alias("name"), (F.col("length") > 0).alias("has_bytes"))
    files = g.spark.read.schema("none int").parquet(f"{g.folder}/*.parquet")
    counted = files.groupBy(F.col("_metadata.file_name").alias("name")).agg(F.count(F.lit(1)).alias("row_count"))
    return listed.join(counted, "name")


@register("raw_json_landing", "SELECT meter_id, reading_ts, usage_kwh, voltage_v FROM readings WHERE quality<>'ESTIMATED'")
def raw_json_landing(g):
    ok = F.col("quality") != "ESTIMATED"
    body = F.to_json(F.struct("meter_id", F.date_format("reading_ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("reading_ts"), "usage_kwh", "voltage_v", "power_factor"))
    raw = g.readings.select(F.when(ok, body).otherwise(F.lit("{broken")).alias("body"))
    return landing.parse_readings(landing.land_json(raw, "body", "feed")).select("meter_id", "reading_ts", "usage_kwh", "voltage_v")


@register("time_spine", "SELECT unnest(generate_series(date_trunc('hour', (SELECT min(ts) FROM events)), (SELECT max(ts) FROM events), INTERVAL 1 HOUR))::timestamp AS slot_ts")
def time_spine_query(g):
    lo, hi = g.readings.agg(F.date_trunc("HOUR", F.min("reading_ts")).cast("string"), F.max("reading_ts").cast("string")).first()
    return time_spine(g.spark, lo, hi, "1 hour")


@register("inline_values", "SELECT segment, count(*) AS n FROM customers GROUP BY 1")
def inline_values(g):
    rows = [("HOUSEHOLD", 0)]
    counted = g.customers.groupBy("segment").agg(F.count(F.lit(1)).alias("n"))
    return seed_if_empty(counted, rows)


@register("physical_layout", "SELECT cast(reading_ts AS date) AS day, count(*) AS n FROM readings WHERE reading_ts>='2024-01-10' AND reading_ts<'2024-01-13' GROUP BY 1")
def physical_layout(g):
    path = scratch_path(g.spark, "layout")
    IO.write_clustered(g.readings, path, "reading_ts", "meter_id", 2)
    rows = g.spark.read.parquet(path).where("day >= date'2024-01-10' AND day < date'2024-01-13'")
    return rows.groupBy("day").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- table changes

def _old(g):
    """An earlier snapshot: rows of k % 40 = 1 did not exist, scores of k % 10 = 0 were one lower."""
    return g.transformers.where("k % 40 <> 1").withColumn("health_score", F.when(F.col("k") % 10 == 0, F.col("health_score") - 1).otherwise(F.col("health_score"))).select("transformer_id", "k", "health_score", "rated_kva")


def _new(g):
    """The current snapshot: rows of k % 50 = 0 are gone."""
    return g.transformers.where("k % 50 <> 0").select("transformer_id", "k", "health_score", "rated_kva")


@register("merge_upsert", """
SELECT transformer_id, CASE WHEN k%50=0 THEN health_score-1 ELSE health_score END AS health_score, rated_kva FROM transformers""")
def merge_upsert(g):
    target = _old(g).select("transformer_id", "health_score", "rated_kva")
    return T.upsert(target, _new(g).select("transformer_id", "health_score", "rated_kva"), ["transformer_id"], ["health_score"])


@register("merge_insert_only", "SELECT transformer_id, CASE WHEN k%40<>1 AND k%10=0 THEN health_score-1 ELSE health_score END AS health_score FROM transformers")
def merge_insert_only(g):
    return T.insert_new(_old(g).select("transformer_id", "health_score"), g.transformers.select("transformer_id", "health_score"), "transformer_id")


@register("update_from_agg", "SELECT circuit_id, coalesce((SELECT count(*) FROM meters m WHERE m.circuit_id=c.circuit_id GROUP BY m.circuit_id), -1) AS customer_count FROM circuits c")
def update_from_agg(g):
    target = g.circuits.select("circuit_id", F.lit(-1).cast("bigint").alias("customer_count"))
    counts = g.meters.groupBy("circuit_id").agg(F.count(F.lit(1)).alias("customer_count"))
    return T.update_from_agg(target, counts, "circuit_id", "customer_count")


@register("update_where_null", "SELECT meter_id, CASE WHEN k%3=0 THEN county||'-filled' ELSE county END AS area FROM meters")
def update_where_null(g):
    rows = g.meters.select("meter_id", "county", F.when(F.col("k") % 3 != 0, F.col("county")).alias("area"))
    return T.backfill(rows, "area", F.concat("county", F.lit("-filled"))).select("meter_id", "area")


@register("delete_by_scope", "SELECT substation_id, circuit_id, CASE WHEN substation_id IN ('SUB-0002','SUB-0005') THEN 'NEW' ELSE status END AS status FROM circuits")
def delete_by_scope(g):
    rows = g.circuits.select("substation_id", "circuit_id", "status")
    new = rows.where(F.col("substation_id").isin("SUB-0002", "SUB-0005")).withColumn("status", F.lit("NEW"))
    return T.replace_slice(rows, new, ["substation_id"])


@register("delete_null_slice", "SELECT meter_id, CASE WHEN k%5<>0 THEN county END AS area, CASE WHEN k%5=0 THEN 'NEW' ELSE segment END AS segment FROM meters")
def delete_null_slice(g):
    rows = g.meters.select("meter_id", F.when(F.col("k") % 5 != 0, F.col("county")).alias("area"), "segment")
    return T.replace_slice(rows, rows.where("area IS NULL").withColumn("segment", F.lit("NEW")), ["area"])


@register("archive_then_replace", "SELECT outage_id, status, timestamp '2024-03-01 00:00:00' AS archived_at, 'reload' AS archive_reason FROM outages")
def archive_then_replace(g):
    path = scratch_path(g.spark, "archive")
    T.archive(g.outages.select("outage_id", "status"), "reload", "2024-03-01 00:00:00").write.parquet(path)
    return g.spark.read.parquet(path)


@register("truncate_insert", "SELECT segment, count(*) AS n FROM meters GROUP BY 1")
def truncate_insert(g):
    path = scratch_path(g.spark, "overwrite")
    rows = g.meters.groupBy("segment").agg(F.count(F.lit(1)).alias("n"))
    for _ in range(2):
        rows.write.mode("overwrite").parquet(path)
    return g.spark.read.parquet(path)


@register("scd_sync_log", "SELECT outage_id AS job_id, status, date_sub('second', start_ts, end_ts) AS duration_s FROM outages WHERE start_ts>=timestamp '2024-01-25 00:00:00'-INTERVAL 7 DAY")
def scd_sync_log(g):
    jobs = g.outages.select(F.col("outage_id").alias("job_id"), "status", F.col("start_ts").alias("started_at"), F.col("end_ts").alias("ended_at"))
    return T.job_log(jobs, "2024-01-25 00:00:00").select("job_id", "status", "duration_s")


@register("materialized_refresh", "SELECT meter_id, count(*) AS n, round(sum(usage_kwh),6) AS kwh FROM readings GROUP BY 1")
def materialized_refresh(g):
    def rebuild(df):
        return df.groupBy("meter_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("usage_kwh"), 6).alias("kwh"))

    edge = F.lit("2024-01-25 00:00:00").cast(NTZ)
    before = rebuild(g.readings.where(F.col("reading_ts") < edge))
    return T.changed_keys_refresh(before, g.readings.where(F.col("reading_ts") >= edge), g.readings, "meter_id", rebuild)


@register("cdc_diff", """
SELECT transformer_id, CASE WHEN k%40=1 AND k%50<>0 THEN 'INSERT' WHEN k%50=0 THEN 'DELETE' ELSE 'UPDATE' END AS action, k%50<>0 AND k%40<>1 AS is_update FROM transformers
WHERE (k%40=1 AND k%50<>0) OR (k%50=0 AND k%40<>1) OR (k%10=0 AND k%50<>0 AND k%40<>1)""")
def cdc_diff(g):
    return C.diff_snapshots(_old(g), _new(g), "transformer_id").select("transformer_id", "action", "is_update")


@register("cdc_null_move", "SELECT transformer_id, 'UPDATE' AS action, CASE WHEN k%2=1 THEN rated_kva END AS first_kva, CASE WHEN k%2=0 THEN rated_kva END AS second_kva FROM transformers WHERE k%3=0")
def cdc_null_move(g):
    """A value moves from one column to its neighbour, which leaves a null behind."""
    def split(even):
        return [F.when(F.col("k") % 2 == int(even), F.col("rated_kva")).alias("first_kva"), F.when(F.col("k") % 2 != int(even), F.col("rated_kva")).alias("second_kva")]

    new = g.transformers.select("transformer_id", *split(True))
    old = g.transformers.where("k % 3 <> 0").select("transformer_id", *split(True)).unionByName(g.transformers.where("k % 3 = 0").select("transformer_id", *split(False)))
    return C.diff_snapshots(old, new, "transformer_id").select("transformer_id", "action", "first_kva", "second_kva")


@register("cdc_stage", """
SELECT 'transformers' AS source_table, transformer_id AS record_key, CASE WHEN k%40=1 THEN 'INSERT' WHEN k%50=0 THEN 'DELETE' ELSE 'UPDATE' END AS operation, 'PENDING' AS sync_status FROM transformers
WHERE (k%40=1 AND k%50<>0) OR (k%50=0 AND k%40<>1) OR (k%10=0 AND k%50<>0 AND k%40<>1)""")
def cdc_stage(g):
    return C.stage_changes(C.diff_snapshots(_old(g), _new(g), "transformer_id"), "transformer_id", "transformers").drop("payload")


@register("cdc_apply", "SELECT transformer_id, k, health_score, rated_kva FROM transformers WHERE k%50<>0")
def cdc_apply(g):
    staged = C.stage_changes(C.diff_snapshots(_old(g), _new(g), "transformer_id"), "transformer_id", "transformers")
    return C.apply_changes(_old(g), staged, "transformer_id", "k bigint, health_score double, rated_kva int")


@register("cdc_config", "SELECT outage_id, status FROM outages")
def cdc_config(g):
    rows = g.outages.select("outage_id", "status", "start_ts")
    edge = F.lit("2024-01-20 00:00:00").cast(NTZ)
    config = [{"table": "outages", "ts_col": "start_ts", "keys": ["outage_id"]}, {"table": "off", "enabled": False}]
    return C.run_sync(config, {"outages": rows}, {"outages": rows.where(F.col("start_ts") <= edge)})["outages"].select("outage_id", "status")


# ---------------------------------------------------------------- streams

def _stream(g):
    events = g.raw("events")
    return readings_of(ST.stream_parquet(g.spark, g.folder, events.schema, "events.parquet"))


@register("stream_readings", "SELECT meter_id, reading_ts, usage_kwh, 'meter_feed' AS source FROM readings")
def stream_readings(g):
    out = ST.drain(ST.with_ingest(_stream(g), "meter_feed"), "readings")
    return out.select("meter_id", "reading_ts", "usage_kwh", "source")


@register("cdc_stream", "SELECT event_id, event_type, 'INSERT' AS action FROM events")
def cdc_stream(g):
    events = g.raw("events")
    stream = ST.stream_parquet(g.spark, g.folder, events.schema, "events.parquet")
    return ST.drain(stream.select("event_id", "event_type", F.lit("INSERT").alias("action")), "changes")


@register("stream_tumbling", """
WITH x AS (SELECT max(reading_ts) AS mx FROM readings), w AS (SELECT time_bucket(INTERVAL 15 MINUTE, reading_ts) AS window_start, count(*) AS reading_count, round(sum(usage_kwh),8) AS total_kwh, round(avg(voltage_v),8) AS avg_voltage FROM readings GROUP BY 1)
SELECT window_start, window_start+INTERVAL 15 MINUTE AS window_end, reading_count, total_kwh, avg_voltage FROM w, x WHERE window_start+INTERVAL 15 MINUTE<=date_trunc('millisecond', mx)-INTERVAL 30 MINUTE""")
def stream_tumbling(g):
    return r8(ST.drain(ST.tumbling(_stream(g)), "tumbling"), "total_kwh", "avg_voltage")


@register("stream_circuit_health", """
WITH x AS (SELECT max(reading_ts) AS mx FROM readings), e AS (SELECT r.*, m.circuit_id, time_bucket(INTERVAL 15 MINUTE, reading_ts)-INTERVAL 15 MINUTE*o AS ws FROM readings r JOIN meters m ON m.meter_id=r.meter_id, (VALUES (0),(1),(2),(3)) v(o))
SELECT ws AS window_start, circuit_id, count(DISTINCT meter_id) AS active_meters, round(avg(voltage_v),8) AS avg_voltage, round(avg(usage_kwh),8) AS avg_usage_kwh, count_if(voltage_v<114) AS low_voltage_count, count_if(usage_kwh=0) AS zero_usage_count
FROM e, x WHERE ws+INTERVAL 1 HOUR<=date_trunc('millisecond', mx)-INTERVAL 30 MINUTE GROUP BY 1,2""")
def stream_circuit_health(g):
    out = ST.drain(ST.rolling_circuit_health(_stream(g), g.meters), "circuit_health")
    return r8(out, "avg_voltage", "avg_usage_kwh")


@register("stream_dedup", "SELECT meter_id, reading_ts, any_value(usage_kwh) AS usage_kwh FROM readings GROUP BY 1,2")
def stream_dedup(g):
    events = g.raw("events")
    twice = ST.stream_parquet(g.spark, g.folder, events.schema, "events.parquet").withColumn("_again", F.explode(F.array(F.lit(1), F.lit(2))))
    return ST.drain(ST.dedup(readings_of(twice), ["meter_id", "reading_ts"]), "dedup").select("meter_id", "reading_ts", "usage_kwh")


@register("stream_outage_sessions", """
WITH x AS (SELECT max(reading_ts) AS mx FROM readings WHERE usage_kwh=0 AND voltage_v<100), o AS (SELECT meter_id, reading_ts, lag(reading_ts) OVER (PARTITION BY meter_id ORDER BY reading_ts) AS p FROM readings WHERE usage_kwh=0 AND voltage_v<100),
s AS (SELECT *, sum(CASE WHEN p IS NULL OR reading_ts>=p+INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY meter_id ORDER BY reading_ts) AS sid FROM o),
r AS (SELECT meter_id, min(reading_ts) AS session_start, max(reading_ts)+INTERVAL 30 MINUTE AS session_end, count(*) AS intervals FROM s GROUP BY meter_id, sid)
SELECT meter_id, session_start, session_end, intervals FROM r, x WHERE session_end<=date_trunc('millisecond', mx)-INTERVAL 1 HOUR""")
def stream_outage_sessions(g):
    return ST.drain(ST.outage_sessions(_stream(g)), "sessions")


@register("stream_consecutive", """
WITH f AS (SELECT *, load_factor_pct>100 AS flag FROM hourly_load), i AS (SELECT *, load_hour - INTERVAL 1 HOUR * (row_number() OVER (PARTITION BY transformer_id, flag ORDER BY load_hour)) AS grp FROM f)
SELECT transformer_id, load_hour, CASE WHEN flag THEN row_number() OVER (PARTITION BY transformer_id, flag, grp ORDER BY load_hour) ELSE 0 END AS consecutive_hours FROM i""")
def stream_consecutive(g):
    path = scratch_path(g.spark, "hourly")
    g.hourly_load.select("transformer_id", "load_hour", "load_factor_pct").write.parquet(path)
    stream = ST.stream_parquet(g.spark, path, g.spark.read.parquet(path).schema)
    return ST.drain(ST.stress_runs(stream), "stress").select("transformer_id", "load_hour", "consecutive_hours")


@register("scheduled_task", "SELECT quality, count(*) AS n FROM readings GROUP BY 1")
def scheduled_task(g):
    path = scratch_path(g.spark, "batches")
    query = ST.drain_batches(_stream(g), "task", lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}"))
    query.awaitTermination()  # a batch that runs again replaces its own folder
    return g.spark.read.parquet(path).groupBy("quality").agg(F.count(F.lit(1)).alias("n"))


@register("late_data", "SELECT count(*) AS n, count_if(reading_ts<(SELECT max(reading_ts) FROM readings)-INTERVAL 2 DAY) AS late FROM readings")
def late_data(g):
    flagged = ST.late_split(g.readings, "reading_ts", "2 days")
    return flagged.agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("is_late"), 1).otherwise(0)).alias("late"))


DELIVERY = "CASE WHEN event_id % 11 = 5 THEN 3 WHEN {day} < 11 THEN 0 WHEN {day} < 21 THEN 1 ELSE 2 END"


@register("late_rows_routed", f"""
WITH e AS (SELECT ts, {DELIVERY.format(day='day(ts)')} AS delivery FROM events),
w AS (SELECT delivery, max(max(ts)) OVER (ORDER BY delivery ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM e GROUP BY 1)
SELECT e.delivery, count(*) AS n, count(*) FILTER (ts<=date_trunc('millisecond', newest)-INTERVAL 2 DAY) AS late, count(*) FILTER (ts<=date_trunc('millisecond', newest)-INTERVAL 2 DAY) AS dropped FROM e JOIN w ON w.delivery=e.delivery GROUP BY 1""")
def late_rows_routed(g):
    """Readings that arrive out of order: late rows go to a table, as many as a deduplicating stream drops for the same watermark."""
    events = g.raw("events").select("event_id", F.col("ts").cast("timestamp_ntz").alias("reading_ts"), F.expr(DELIVERY.format(day="day(ts)")).alias("delivery"))
    path, state = scratch_path(g.spark, "deliveries"), scratch_path(g.spark, "dedup-state")
    router, dropped = ST.LateRows(g.spark, "reading_ts", "2 days"), []
    for delivery in range(4):
        events.where(F.col("delivery") == delivery).write.mode("append").parquet(path)
        stream = ST.stream_parquet(g.spark, path, events.schema)
        rows = router.take(stream)
        query = ST.dedup(stream, ["event_id"], "2 days").writeStream.format("noop").option("checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination()
        dropped.append((delivery, ST.dropped_by_watermark([json.loads(p.json) for p in query.recentProgress])))
    routed = rows.groupBy("delivery").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("is_late").cast("int")).alias("late"))
    return routed.join(g.spark.createDataFrame(dropped, "delivery int, dropped bigint"), "delivery")


@register("cdc_staging_tables", "SELECT outage_id, transformer_id, status, customers, 'INSERT' AS operation FROM outages")
def cdc_staging_tables(g):
    path = scratch_path(g.spark, "outages_cdc")
    schema = _schema(ST.SCHEMAS["outages_cdc"])
    g.outages.withColumns({"operation": F.lit("INSERT"), "cdc_ts": F.col("start_ts")}).select(*schema.names).write.parquet(path)
    return ST.drain(ST.stream_parquet(g.spark, path, schema), "staged").select("outage_id", "transformer_id", "status", "customers", "operation")


# ---------------------------------------------------------------- text

@register("search_documents", """
SELECT 'customer' AS kind, customer_id AS id, full_name||' '||segment||' '||city||' '||account_status||' customer' AS search_text FROM customers
UNION ALL SELECT 'meter', m.meter_id, m.meter_id||' '||m.county||' '||m.transformer_id||' '||m.circuit_id||' '||m.substation_id||' '||s.substation_name||' '||m.segment FROM meters m JOIN substations s ON s.substation_id=m.substation_id""")
def search_documents(g):
    a = X.customer_text(g.customers).select(F.lit("customer").alias("kind"), F.col("customer_id").alias("id"), "search_text")
    context = J.meter_context(g.meters, g.transformers, g.circuits, g.substations)
    return a.unionByName(X.meter_text(context).select(F.lit("meter").alias("kind"), F.col("meter_id").alias("id"), "search_text"))


TERMS = ("ation", "the", "of", "is")


def _bm25_sql(terms) -> str:
    tf = ", ".join(f"len(list_filter(t, lambda x: x='{w}'))::double AS tf{i}" for i, w in enumerate(terms))
    df = ", ".join(f"count_if(tf{i}>0) AS df{i}" for i in range(len(terms)))
    score = " + ".join(
        f"ln(1.0+(s.n-df{i}+0.5)/(df{i}+0.5))*tf{i}*2.2::double/(tf{i}+1.2::double*(0.25::double+0.75::double*l/s.al))" for i in range(len(terms))
    )
    return f"""
WITH tk AS (SELECT doc_id, lang, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x<>'') AS t FROM documents),
c AS (SELECT doc_id, lang, len(t)::double AS l, {tf} FROM tk), s AS (SELECT count(*) AS n, avg(l) AS al, {df} FROM c)
SELECT doc_id, lang, round({score},6) AS score FROM c, s WHERE lang='en' AND ({' OR '.join(f'tf{i}>0' for i in range(len(terms)))}) ORDER BY {score} DESC, doc_id LIMIT 20"""


@register("text_search", _bm25_sql(sorted(TERMS)))
def text_search(g):
    index = text_index.index_of(g.raw("documents"), "doc_id", "text", ["lang"])
    out = index.search(" ".join(TERMS), {"lang": "en"}, 20)
    return out.withColumn("score", F.round("score", 6))


@register("fuzzy_search", """
WITH g AS (SELECT *, list_distinct(list_transform(range(1, length('  '||lower(substation_name)||' ')-1), lambda i: substr('  '||lower(substation_name)||' ', i, 3))) AS g FROM substations),
q AS (SELECT list_distinct(list_transform(range(1, length('  natoin_12 substaton ')-1), lambda i: substr('  natoin_12 substaton ', i, 3))) AS q),
s AS (SELECT substation_id, substation_name, len(list_intersect(g, q))::double/(len(g)+len(q)-len(list_intersect(g, q))) AS sim, levenshtein(lower(substation_name), 'natoin_12 substaton') AS d FROM g, q)
SELECT substation_id, substation_name, round(sim,8) AS similarity, d AS edit_distance FROM s WHERE sim>=0.2 ORDER BY d, sim DESC, substation_id LIMIT 8""")
def fuzzy_search(g):
    hits = X.fuzzy_search(g.substations, "substation_id", "substation_name", "Natoin_12 Substaton", 0.2, 8)
    return r8(hits.withColumn("edit_distance", F.col("edit_distance").cast("bigint")), "similarity")


@register("fuzzy_customer_search", """
WITH g AS (SELECT *, list_distinct(list_transform(range(1, length('  '||lower(full_name)||' ')-1), lambda i: substr('  '||lower(full_name)||' ', i, 3))) AS g FROM customers),
q AS (SELECT list_distinct(list_transform(range(1, length('  custmer#00000012 ')-1), lambda i: substr('  custmer#00000012 ', i, 3))) AS q),
s AS (SELECT customer_id, full_name, len(list_intersect(g, q))::double/(len(g)+len(q)-len(list_intersect(g, q))) AS sim, levenshtein(lower(full_name), 'custmer#00000012') AS d FROM g, q)
SELECT customer_id, full_name, round(sim,8) AS similarity, d AS edit_distance FROM s WHERE sim>=0.3 ORDER BY d, sim DESC, customer_id LIMIT 10""")
def fuzzy_customer_search(g):
    hits = X.fuzzy_search(g.customers, "customer_id", "full_name", "Custmer#00000012", 0.3, 10)
    return r8(hits.withColumn("edit_distance", F.col("edit_distance").cast("bigint")), "similarity")


@register("vector_search", """
WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id=0)
SELECT vec_id, round(list_cosine_similarity(embedding::double[], e::double[]),6) AS similarity FROM embeddings, q ORDER BY list_cosine_similarity(embedding::double[], e::double[]) DESC, vec_id LIMIT 15""")
def vector_search(g):
    rows = g.raw("embeddings")
    q = F.array(*[F.lit(float(v)) for v in rows.where("vec_id = 0").select("embedding").first()[0]])
    return X.nearest_vectors(rows, "vec_id", "embedding", q, 15).withColumn("similarity", F.round("similarity", 6))


@register("chunk_text", """
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x<>'') AS w FROM documents), s AS (SELECT doc_id, w, unnest(range(0, len(w), 1300)) AS st FROM w WHERE len(w)>0)
SELECT doc_id||'_'||CASE WHEN length(cast(st//1300 AS varchar))<4 THEN lpad(cast(st//1300 AS varchar),4,'0') ELSE cast(st//1300 AS varchar) END AS chunk_id, doc_id, (st//1300)::int AS chunk_index, md5(array_to_string(w[st+1:st+1500],' ')) AS text_md5, len(w[st+1:st+1500])::int AS token_count FROM s""")
def chunk_text(g):
    out = X.chunk_text(g.raw("documents"), "doc_id", "text")
    return out.select("chunk_id", "doc_id", "chunk_index", F.md5("chunk_text").alias("text_md5"), "token_count")


@register("doc_identity", "SELECT page_id, substr(md5(url),1,16) AS document_id FROM pages")
def doc_identity(g):
    return X.doc_identity(g.raw("pages"), "url").select("page_id", "document_id")


@register("doc_filters", "SELECT CASE WHEN n_chars>4000 THEN 'SKIPPED' WHEN trim(text)='' THEN 'ERROR' ELSE 'SUCCESS' END AS status, count(*) AS n FROM documents GROUP BY 1")
def doc_filters(g):
    return X.ingest_report(g.raw("documents"), "n_chars", "text", 4000).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@register("chunk_source_filter", "SELECT doc_id, n_chars FROM documents WHERE source='src3' AND text IS NOT NULL")
def chunk_source_filter(g):
    return X.usable_chunks(g.raw("documents"), "src3").select("doc_id", "n_chars")

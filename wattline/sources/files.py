"""File scans, exports and manifests."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from wattline.functions.hashing import uniform

# Texts that stand for NULL in delimited files.
NULL_TOKENS = ["", "NULL", "None"]


def load_csv(spark: SparkSession, path: str, schema: StructType, null_tokens: list[str] = NULL_TOKENS) -> DataFrame:
    """Header skipped, quotes honoured, short or long rows tolerated.

    Columns are read as text first so that every null token is recognised, then cast; a bad value becomes NULL.
    """
    as_text = StructType()
    for f in schema.fields:
        as_text.add(f.name, "string")
    raw = spark.read.csv(path, schema=as_text, header=True, quote='"', escape='"', mode="PERMISSIVE", enforceSchema=True)
    return raw.select(
        *[
            F.when(~F.col(f.name).isin(null_tokens), F.col(f.name)).try_cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


def project_typed(df: DataFrame, spec: dict[str, tuple[str, str]], required: list[str] = ()) -> DataFrame:
    """Typed projection ``{output: (input, type)}``; rows whose required columns do not parse are skipped."""
    out = df.select(*[F.trim(F.col(src)).try_cast(kind).alias(name) for name, (src, kind) in spec.items()])
    for name in required:
        out = out.where(F.col(name).isNotNull())
    return out


def rejected(df: DataFrame, spec: dict[str, tuple[str, str]], required: list[str]) -> DataFrame:
    """The rows ``project_typed`` skips, as they came."""
    bad = F.lit(False)
    for name in required:
        src, kind = spec[name]
        bad = bad | F.trim(F.col(src)).try_cast(kind).isNull()
    return df.where(bad)


def load_by_name(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Match columns by name without regard to case; missing ones become NULL, extra ones are not read."""
    df = spark.read.parquet(path)
    have = {c.lower(): c for c in df.columns}
    cols: list[Column] = []
    for f in schema.fields:
        found = have.get(f.name.lower())
        cols.append((F.col(f"`{found}`") if found else F.lit(None)).cast(f.dataType).alias(f.name))
    return df.select(*cols)


def ingest(spark: SparkSession, path: str, ts_col: str, key_col: str, schema: StructType | None = None) -> tuple[DataFrame, DataFrame]:
    """Many-file scan that skips unreadable files, and one-row statistics of what was read."""
    reader = spark.read.option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True)
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.parquet(path)
    stats = df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.min(ts_col).alias("first_ts"),
        F.max(ts_col).alias("last_ts"),
        F.countDistinct(key_col).alias("distinct_keys"),
    )
    return df, stats


def export(df: DataFrame, path: str, columns: list[str] | None = None, max_records: int = 1_000_000) -> None:
    """Overwrite a Parquet folder with files of bounded size."""
    out = df.select(*columns) if columns else df
    out.write.mode("overwrite").option("maxRecordsPerFile", max_records).parquet(path)


def sample_rows(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """Fixed-size sample that depends on the key and the seed only: a distributed top-n by hash."""
    order = uniform(F.concat(F.col(key).cast("string"), F.lit(str(seed))))
    return df.orderBy(order, F.col(key)).limit(n)


def write_clustered(df: DataFrame, path: str, ts_col: str, key: str, files_per_day: int = 8) -> None:
    """One directory per day, each day split by key hash and sorted by key, so both filters skip files or row groups."""
    (
        df.withColumn("day", F.to_date(ts_col))
        .withColumn("_file", F.pmod(F.xxhash64(key, ts_col), F.lit(files_per_day)))
        .repartition("day", "_file")
        .sortWithinPartitions("day", key, ts_col)
        .drop("_file")
        .write.mode("overwrite")
        .partitionBy("day")
        .parquet(path)
    )


def list_docs(spark: SparkSession, path: str, suffix: str = ".pdf") -> DataFrame:
    """Path, size and modification time; the contents are never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", "modificationTime").where(F.col("path").endswith(suffix)).orderBy("path")


def save(df: DataFrame, name: str, mode: str = "append", path: str | None = None) -> None:
    """Append to or overwrite a catalog table, columns matched by name; ``path`` places a new table."""
    spark = df.sparkSession
    if mode == "append" and spark.catalog.tableExists(name):
        df.select(*spark.table(name).columns).write.mode("append").insertInto(name)
    else:
        writer = df.write.mode("overwrite")
        (writer.option("path", path) if path else writer).saveAsTable(name)


def released(spark: SparkSession, name: str) -> DataFrame:
    """The rows of a table that was saved with a path, read from there; the catalog forgets the table and the files stay."""
    table = spark.table(name)
    facts = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE TABLE EXTENDED {name}").collect()}
    if facts.get("Type") != "EXTERNAL":
        raise ValueError(f"{name} keeps its own files; dropping it would lose them")
    rows = spark.read.schema(table.schema).format(facts["Provider"]).load(facts["Location"])
    spark.sql(f"DROP TABLE {name}")
    return rows


def build_manifest(tables: dict[str, DataFrame], folder: str) -> DataFrame:
    """One JSON row: tables in the given order with file and row count."""
    spark = next(iter(tables.values())).sparkSession
    entries = [
        F.struct(
            F.lit(name).alias("table"),
            F.lit(f"{folder}/{name}.parquet").alias("file"),
            df.agg(F.count(F.lit(1)).alias("n")).scalar().alias("rows"),
        )
        for name, df in tables.items()
    ]
    doc = F.struct(F.lit("1.0").alias("version"), F.lit(len(tables)).alias("table_count"), F.array(*entries).alias("files"))
    return spark.range(1).select(F.to_json(doc).alias("manifest"))


def load_manifest(spark: SparkSession, manifest: str, target: str) -> list[dict]:
    """Load the listed tables in order: ``truncate`` entries replace the target folder, the others append."""
    done = []
    for item in json.loads(manifest)["files"]:
        df = spark.read.parquet(item["file"])
        mode = "overwrite" if item.get("truncate", True) else "append"
        df.write.mode(mode).parquet(f"{target}/{item['table']}")
        done.append({"table": item["table"], "mode": mode})
    return done

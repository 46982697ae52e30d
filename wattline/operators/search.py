"""Search texts, typo-tolerant match, vector similarity and document chunks; ranked lookup is in ``text_index``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wattline.operators.anchors import topk


def customer_text(customers: DataFrame) -> DataFrame:
    parts = [F.coalesce(F.col(c), F.lit("")) for c in ("full_name", "segment", "city", "account_status")]
    return customers.select("customer_id", "segment", "city", "account_status", F.concat(F.concat_ws(" ", *parts), F.lit(" customer")).alias("search_text"))


def meter_text(context: DataFrame) -> DataFrame:
    cols = ["meter_id", "county", "transformer_id", "circuit_id", "substation_id", "substation_name", "segment"]
    return context.select("meter_id", "county", "segment", F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in cols]).alias("search_text"))


def grams(text: Column, size: int = 3) -> Column:
    """Distinct character n-grams of the padded lower-case text."""
    padded = F.concat(F.lit("  "), F.lower(text), F.lit(" "))
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(padded) - size + 1))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(padded, i, F.lit(size))))


def fuzzy_search(docs: DataFrame, key: str, text: str, query: str, least: float = 0.3, n: int = 10) -> DataFrame:
    """Character 3-gram overlap as a filter, edit distance as the ranking."""
    q = grams(F.lit(query))
    g = grams(F.col(text))
    shared = F.size(F.array_intersect(g, q)).cast("double")
    overlap = shared / (F.size(g) + F.size(q) - shared)
    rows = docs.select(key, text, overlap.alias("similarity")).where(F.col("similarity") >= least)
    rows = rows.withColumn("edit_distance", F.levenshtein(F.lower(F.col(text)), F.lit(query.lower())))
    return topk(rows, [F.col("edit_distance").asc(), F.col("similarity").desc(), F.col(key).asc()], n)


def cosine(a: Column, b: Column) -> Column:
    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, p: s + p)

    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def nearest_vectors(df: DataFrame, key: str, vector: str, query: Column, k: int = 10) -> DataFrame:
    """The k rows most similar to one query vector: a scan with a distributed top-k."""
    rows = df.select(key, cosine(F.col(vector), query).alias("similarity"))
    return topk(rows, [F.col("similarity").desc_nulls_last(), F.col(key).asc()], k)


def chunk_text(docs: DataFrame, key: str, text: str, size: int = 1500, overlap: int = 200) -> DataFrame:
    """Word chunks of ``size`` words every ``size - overlap`` words, over the whole text."""
    step = max(1, size - overlap)
    words = F.array_remove(F.split(F.col(text), r"\s+"), "")
    rows = docs.withColumn("_w", words).where(F.size("_w") > 0)
    starts = F.sequence(F.lit(0), F.size("_w") - 1, F.lit(step))
    out = rows.select(key, "_w", F.posexplode(starts).alias("chunk_index", "_s"))
    piece = F.slice("_w", F.col("_s") + 1, F.lit(size))
    return out.select(
        F.concat(F.col(key).cast("string"), F.lit("_"), F.lpad(F.col("chunk_index").cast("string"), F.greatest(F.lit(4), F.length(F.col("chunk_index").cast("string"))), F.lit("0"))).alias("chunk_id"),
        key, "chunk_index", F.concat_ws(" ", piece).alias("chunk_text"), F.size(piece).alias("token_count"),
    )


def doc_identity(df: DataFrame, path: str) -> DataFrame:
    """Stable id and title from a path."""
    p = F.col(path)
    name = F.regexp_replace(F.element_at(F.split(p, "/"), -1), r"\.pdf$", "")
    return df.withColumns({"document_id": F.substring(F.md5(p), 1, 16), "title": F.initcap(F.regexp_replace(name, "_", " "))})


def ingest_report(files: DataFrame, size: str, text: str, max_bytes: int = 50 * 1024 * 1024) -> DataFrame:
    """Status per file: too large is skipped, empty is an error."""
    return files.withColumn(
        "status",
        F.when(F.col(size) > max_bytes, "SKIPPED").when(F.coalesce(F.trim(F.col(text)), F.lit("")) == "", "ERROR").otherwise("SUCCESS"),
    )


def usable_chunks(chunks: DataFrame, source: str) -> DataFrame:
    return chunks.where((F.col("source") == source) & F.col("text").isNotNull())

"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from wattline.llm import (
    checks, filter_audit, mixing, near_dedup, onebit_search, page_text, piece_codec, quality_classifier, quality_rules, suffix_dedup, token_counts, toxicity, vector_codes,
    window_dedup,
)
from wattline.llm.common import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, check: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if check:
            CHECKS[name] = check
        return fn

    return add


@query("op7_line_frequency_rules", checks.quality_rules())
def op7_line_frequency_rules(spark: SparkSession, folder: str) -> DataFrame:
    out = quality_rules.judged(documents(spark, folder))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words")


@query("op8_source_mix", checks.mixing())
def op8_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_report(documents(spark, folder))


@query("op2_quality_discriminant")
def op2_quality_discriminant(spark: SparkSession, folder: str) -> DataFrame:
    out = quality_classifier.scored(documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet"))
    return out.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


@query("op4_toxic_segments")
def op4_toxic_segments(spark: SparkSession, folder: str) -> DataFrame:
    out = toxicity.scored(documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet"))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))


@query("op9_piece_encoding")
def op9_piece_encoding(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return piece_codec.digests(documents(spark, folder), public_tokenizers.path("piece_bpe_32k.model"))


@query("op1_minhash_odd_sketch")
def op1_minhash_odd_sketch(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, folder)).drop("text_key")


@query("op5_doubling_windows")
def op5_doubling_windows(spark: SparkSession, folder: str) -> DataFrame:
    return window_dedup.deduplicated_rows(documents(spark, folder)).drop("text_key")


@query("op3_sparse_suffixes")
def op3_sparse_suffixes(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.deduplicated_rows(documents(spark, folder))


@query("op6_onebit_codes")
def op6_onebit_codes(spark: SparkSession, folder: str) -> DataFrame:
    return onebit_search.search(spark.read.parquet(f"{folder}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


@query("op10_host_suffix_text")
def op10_host_suffix_text(spark: SparkSession, folder: str) -> DataFrame:
    return page_text.main_texts(spark.read.parquet(f"{folder}/pages.parquet"))


@query("op11_digest_cache_counts")
def op11_digest_cache_counts(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return token_counts.token_counts(documents(spark, folder), public_tokenizers.path("byte_bpe_50k.json"))


@query("op12_filter_interactions", checks.filter_audit())
def op12_filter_interactions(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.audit(documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet"))


@query("op13_dictionary_codes", checks.vector_codes())
def op13_dictionary_codes(spark: SparkSession, folder: str) -> DataFrame:
    return vector_codes.compressed(spark.read.parquet(f"{folder}/embeddings.parquet"))

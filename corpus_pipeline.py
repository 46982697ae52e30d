"""A corpus from raw documents in five stages; each works on all that the one before has kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wattline.llm import mixing, near_dedup, piece_codec, quality_rules, window_dedup
from wattline.session import scratch_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without the lines that many documents of their source share."""
    return quality_rules.cleaned(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return near_dedup.deduplicated(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 50 or more words that a smaller id has too."""
    return window_dedup.deduplicated(docs)


def source_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes: a row per document and pass, its text the words taken."""
    return mixing.mix_texts(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed texts as ids of the vocabulary, with digests of ids and decoded text."""
    import public_tokenizers

    return piece_codec.digests(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality_rules", quality),
    ("near_dedup", near_copies),
    ("substring_dedup", repeated_passages),
    ("source_mix", source_weights),
    ("piece_encoding", pieces),
]

#: Shingle links, removed windows and the library's ids have no SQL form that runs on whole tables; tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

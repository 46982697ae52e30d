"""Token counts from a cache that is keyed by digests of content and tokenizer.

The cache is a Parquet folder with one part per tokenizer digest (vocabulary file and library version) and rows (digest, n_tokens), where
``digest`` is the SHA-256 of the normalised content: a null as the empty text, malformed UTF-8 with replacement characters, which is
what a tokenizer would see. Documents are joined to it by digest. Contents that it lacks are encoded once each, however many documents
hold them, and appended; the counts of all documents then come from the cache. A run that is cut off leaves a cache of right rows, and
two runs that append the same contents leave equal rows, which a read takes as one.

A warm run shuffles digests, and of the texts only those whose hash bucket holds a missing digest. Copies of a text meet in the partial
aggregate of each task before they are shuffled.

Defined cases: a null text has 0 bytes and counts as an empty one; rows with equal or null ids keep a row each; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from wattline.llm.common import likely_among, stored
from wattline.session import scratch_path

#: Tokens above which a document does not fit a model's context.
LIMIT = 1024
#: Texts that a task encodes at a time.
ROWS = 256
CACHED = "digest binary, n_tokens long"


def tokenizer_digest(file: str) -> str:
    """SHA-256 of a vocabulary file and the version of the library that reads it."""
    out = hashlib.sha256(_library(file).__version__.encode())
    with open(file, "rb") as f:
        out.update(f.read())
    return out.hexdigest()


def _library(file: str):
    if file.endswith(".json"):
        import tokenizers

        return tokenizers
    if file.endswith(".model"):
        import sentencepiece

        return sentencepiece
    raise ValueError(f"no library for {file}: a .json or .model file is needed")


_COUNTERS: dict[str, Callable[[list[str]], list[int]]] = {}


def counter(file: str) -> Callable[[list[str]], list[int]]:
    """Counts of a list of texts by the file's library: nothing added, cut off or padded; one for each vocabulary and Python worker."""
    if file not in _COUNTERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks are the parallel work
        library = _library(file)
        if file.endswith(".json"):
            own = library.Tokenizer.from_file(file)
            own.no_truncation()
            own.no_padding()
            _COUNTERS[file] = lambda texts: [len(e) for e in own.encode_batch_fast(texts, add_special_tokens=False)]
        else:
            pieces = library.SentencePieceProcessor(model_file=file)
            _COUNTERS[file] = lambda texts: [len(ids) for ids in pieces.encode(texts, num_threads=1, add_bos=False, add_eos=False)]
    return _COUNTERS[file]


def _encoder(file: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(file)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(count(batch.column("text").to_pylist()), pa.int64())], names=["digest", "n_tokens"])

    return run


def _cached(spark: SparkSession, folder: str) -> DataFrame | None:
    """The cache of one tokenizer, a row for each digest; None where nothing has been written yet."""
    try:
        rows = spark.read.schema(CACHED).parquet(folder)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return rows.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def fill(texts: DataFrame, tokenizer: str, folder: str) -> None:
    """Append the counts of the (digest, text) rows that the cache in ``folder`` lacks."""
    known = _cached(texts.sparkSession, folder)
    if known is not None:
        missing = stored(texts.select("digest").distinct().join(known, "digest", "left_anti"), "missing-digests")
        if missing.isEmpty():
            return
        texts = likely_among(texts, "digest", missing)
    fresh = texts.groupBy("digest").agg(F.any_value("text").alias("text"))
    if known is not None:
        fresh = fresh.join(missing, "digest", "left_semi")
    fresh.select("digest", "text").mapInArrow(_encoder(tokenizer), CACHED).write.mode("append").parquet(folder)


def token_counts(docs: DataFrame, tokenizer: str, cache: str | None = None, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every text.

    ``tokenizer`` is a file that driver and executors can read, ``cache`` a folder that they share; without one the run starts with an
    empty cache of its own below ``spark.checkpoint.dir``.
    """
    folder = f"{cache or scratch_path(docs.sparkSession, 'token-cache')}/tokenizer={tokenizer_digest(tokenizer)}"
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("raw"))
    rows = rows.select("doc_id", F.octet_length("raw").cast("long").alias("n_bytes"), F.make_valid_utf8("raw").alias("text"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("text", 256)))
    fill(rows.select("digest", "text"), tokenizer, folder)
    counts = _cached(docs.sparkSession, folder)
    if counts is None:  # no documents
        counts = docs.sparkSession.createDataFrame([], CACHED)
    found = rows.drop("text").join(counts, "digest", "left")
    tokens = F.coalesce("n_tokens", F.raise_error(F.lit("the cache lost a content while this run used it")).cast("long"))
    return found.select("doc_id", "n_bytes", tokens.alias("n_tokens")).withColumn("over_limit", F.col("n_tokens") > limit)

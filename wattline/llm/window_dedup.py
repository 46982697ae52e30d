"""Word windows that a document with a smaller id has too, by level-wise doubling.

A window of ``WINDOW`` words repeats only if its halves do. The first level looks at runs of half the length, at anchors alone: every
window has one, at the same place wherever it occurs. Anchors that two documents share survive, and only windows around them are
extended to the full length and looked up exactly; there the doubling ends, since longer repeats are unions of windows. What is
shuffled is hashes: of anchors first, of surviving windows then. Documents with equal words are one text, that of the smallest id.

Defined cases: a null text has no words; a text with fewer words than a window loses none; repeated rows are treated alike, since only
smaller ids count; rows without id neither lose words nor take any from others; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from wattline.llm import rolling
from wattline.llm.common import stored

WINDOW = 50
WORDS_KNOWN = 500_000


class _Words(dict):
    """64-bit hashes of words; forgets all when it holds too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KNOWN:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_WORDS = _Words()


def _hashed(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))


def _first_level(window: int):
    half = window // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, shas, hashes, ends = [], [], [], [0]
            for text in batch.column("text").to_pylist():
                words = (text or b"").split()
                sizes.append(len(words))
                shas.append(hashlib.sha256(b" ".join(words)).digest())
                if len(words) >= window:
                    runs = rolling.run_hashes(_hashed(words), half)
                    hashes.append(np.unique(runs[rolling.anchors(runs, window - half + 1)]))
                    ends.append(ends[-1] + len(hashes[-1]))
                else:
                    ends.append(ends[-1])
            flat = np.concatenate(hashes).view(np.int64) if hashes else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(sizes, pa.int64()), pa.array(shas, pa.binary()), lists], names=["doc_id", "text_key", "n_words", "sha", "anchors"])

    return run


def _second_level(window: int):
    half = window // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, hashes, sizes = [], [], []
            for text, shared in zip(batch.column("text").to_pylist(), batch.column("shared").to_pylist()):
                words = text.split()
                units = _hashed(words)
                runs = rolling.run_hashes(units, half)
                at = rolling.anchors(runs, window - half + 1)
                at = at[np.isin(runs[at], np.array(shared, np.int64).view(np.uint64))]
                edge = np.zeros(len(words) + 1, np.int64)  # windows that hold a surviving anchor
                np.add.at(edge, np.maximum(at - (window - half), 0), 1)
                np.add.at(edge, at + 1, -1)
                at = np.flatnonzero(np.cumsum(edge)[: len(words) - window + 1] > 0)
                starts.append(at)
                hashes.append(rolling.joined(runs[at], runs[at + half]) if window == 2 * half else rolling.run_hashes(units, window)[at])
                sizes.append(len(at))
            if sum(sizes):
                rows = pa.array(np.repeat(np.arange(len(sizes)), sizes))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(rows), batch.column("text_key").take(rows), pa.array(np.concatenate(starts), pa.int32()), pa.array(np.concatenate(hashes).view(np.int64))],
                    names=["doc_id", "text_key", "start", "h"],
                )

    return run


def _cut(window: int, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, rest = [], []
            for text, starts in zip(batch.column("text").to_pylist(), batch.column("starts").to_pylist()):
                words = text.split()
                edge = np.zeros(len(words) + 1, np.int64)
                at = np.array(starts, np.int64)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + window, -1)
                keep = np.cumsum(edge)[:-1] == 0
                kept = b" ".join([w for w, k in zip(words, keep.tolist()) if k])
                removed.append(len(words) - int(keep.sum()))
                rest.append(kept if keep_text else hashlib.sha256(kept).digest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(removed, pa.int64()), pa.array(rest, pa.binary())], names=["doc_id", "text_key", "n_removed", "rest"])

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.col("text").cast("binary").alias("text"))


def repeated_windows(docs: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Per row (doc_id, text_key, n_words, sha, first_id), and (doc_id, text_key, starts) of windows that a smaller id has too.

    ``starts`` covers the rows with the smallest id of their words; other rows repeat ``first_id`` whole.
    """
    kind = dict(docs.dtypes)["doc_id"]
    rows = stored(_keyed(docs).mapInArrow(_first_level(window), f"doc_id {kind}, text_key long, n_words long, sha binary, anchors array<long>"), "word-runs")
    firsts = stored(rows.groupBy("sha").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("one")).select("sha", "one.doc_id", "one.text_key"), "first-texts")
    named = firsts.select(F.col("sha").alias("_sha"), F.col("doc_id").alias("first_id"), F.col("text_key").alias("first_key"))
    rows = rows.join(named, rows.sha == named._sha).drop("_sha")
    own = (F.col("doc_id") == F.col("first_id")) & (F.col("text_key") == F.col("first_key"))
    texts = stored(rows.withColumn("own", F.coalesce(own, F.lit(False))).drop("first_key"), "word-texts")
    runs = texts.where("own").select("doc_id", "text_key", F.explode("anchors").alias("h"))
    shared = stored(runs.groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("h"), "shared-runs")
    held = runs.join(shared, "h").groupBy("doc_id", "text_key").agg(F.collect_set("h").alias("shared"))
    second = _keyed(docs).join(held, ["doc_id", "text_key"]).select("doc_id", "text_key", "text", "shared").mapInArrow(_second_level(window), f"doc_id {kind}, text_key long, start int, h long")
    second = stored(second, "full-windows")
    lower = stored(second.groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("h", "lo"), "lower-ids")
    hits = second.join(lower, "h").where("doc_id > lo").groupBy("doc_id", "text_key").agg(F.collect_set("start").alias("starts"))
    return texts.drop("anchors"), stored(hits, "repeated-starts")


def deduplicated_rows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, text_key, n_words, n_removed, kept_sha256) of every row."""
    kind = dict(docs.dtypes)["doc_id"]
    texts, hits = repeated_windows(docs, window)
    cut = _keyed(docs).join(hits, ["doc_id", "text_key"]).select("doc_id", "text_key", "text", "starts")
    cut = cut.mapInArrow(_cut(window, False), f"doc_id {kind}, text_key long, n_removed long, rest binary").dropDuplicates(["doc_id", "text_key"])
    copies = F.coalesce((F.col("doc_id") > F.col("first_id")) & (F.col("n_words") >= window), F.lit(False))
    out = texts.join(cut, ["doc_id", "text_key"], "left")
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select(
        "doc_id", "text_key", "n_words", F.when(copies, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(copies, empty).otherwise(F.lower(F.hex(F.coalesce("rest", "sha")))).alias("kept_sha256"),
    )


def deduplicated(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without repeated words, in the columns of ``docs``; documents that lose all their words go."""
    kind = dict(docs.dtypes)["doc_id"]
    texts, hits = repeated_windows(docs, window)
    gone = texts.where((F.col("doc_id") > F.col("first_id")) & (F.col("n_words") >= window)).select("doc_id", "text_key").distinct()
    cut = _keyed(docs).join(hits, ["doc_id", "text_key"]).select("doc_id", "text_key", "text", "starts")
    cut = cut.mapInArrow(_cut(window, True), f"doc_id {kind}, text_key long, n_removed long, rest binary").dropDuplicates(["doc_id", "text_key"])
    changes = stored(cut.select("doc_id", "text_key", F.col("rest").cast("string").alias("_rest")).unionByName(gone.withColumn("_rest", F.lit(""))), "cut-texts")
    changes = changes.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "_rest")
    own = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_own"), F.xxhash64("text").alias("_text_key"), F.col("text").alias("_text"))
    df = own.join(changes, (F.col("_own") == F.col("_id")) & (F.col("_text_key") == F.col("_key")), "left").where("_rest IS NULL OR _rest <> ''")
    text = F.coalesce("_rest", "_text")
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return df.select(*[(new[c] if c in new else F.col("_row").getField(c)).alias(c) for c in docs.columns])

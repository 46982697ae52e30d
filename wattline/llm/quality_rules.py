"""Quality rules on whole documents, with lines judged by how many documents of their host carry them.

Only DataFrame functions are used. Lines are normalised (lower case, digits to 0, white space collapsed) and hashed; a line counts once
per distinct text of its host (``source``), so exact copies of one document do not make its lines look like furniture. A short line that
is in more than ``max_documents`` texts of a host is removed. A document that keeps less than ``min_kept`` of its words is depleted and
rejected. Lines of more than ``max_line_words`` words are paragraphs: repeats of those are left to the deduplication operators.

Defined cases: a null text is an empty one, has no words and fails the base rules; a null source is a host of its own; repeated rows
get equal results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wattline.llm.common import GAP_PATTERN, GAPS, stored, words_of

MAX_DOCUMENTS = 10
MAX_LINE_WORDS = 30
MIN_KEPT = 0.3
#: Up to so many different repeated windows are looked up in a list; above that they are found by sorting. Both give the same counts.
SHORT_LIST = 64
_HASHES = "array<struct<h:bigint,w:int>>"


def line_hash(line: Column) -> Column:
    """64-bit hash of the normalised line."""
    folded = F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]", "0"), GAP_PATTERN, " ")
    return F.xxhash64(F.trim(folded))


def base_figures(docs: DataFrame) -> DataFrame:
    """One row per document: keys, the base counts and its short lines as (hash, words)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select(
        "doc_id", "source", text.alias("_t"), F.xxhash64(text, F.length(text)).alias("sig"), F.md5(text).alias("text_md5"),
        words_of(F.col("text")).alias("_w"), F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, GAPS, "")) > 0).alias("_l"),
    )
    df = df.select(
        "doc_id", "source", "sig", "text_md5", F.size("_w").cast("long").alias("n_words"),
        F.length(F.translate("_t", GAPS, "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.transform("_l", lambda x: F.struct(line_hash(x).alias("h"), F.size(words_of(x)).alias("w"))).alias("lines"),
        F.when(F.size("_w") >= 3, F.slice(F.transform("_w", lambda x, i: F.xxhash64(x, F.get("_w", i + 1), F.get("_w", i + 2))), F.lit(1), F.greatest(F.size("_w") - 2, F.lit(1)))).otherwise(F.array().cast("array<bigint>")).alias("_g"),
    )
    df = df.withColumn("_s", F.sort_array("_g"))
    df = df.withColumn("_d", F.array_distinct(F.filter("_s", lambda x, i: (i > 0) & (x == F.get("_s", i - 1))))).drop("_s")
    few = F.size("_d") <= SHORT_LIST
    df = df.withColumn("_o", F.when(few, F.array().cast("array<struct<g:bigint,i:int>>")).otherwise(F.array_sort(F.transform("_g", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))))
    listed = F.filter(F.transform("_g", lambda g, i: F.when(F.array_contains("_d", g), i)), lambda i: i.isNotNull())
    by_order = F.filter(F.transform("_o", lambda x, i: F.when((x.g == F.get("_o", i - 1).g) | (x.g == F.get("_o", i + 1).g), x.i)), lambda i: i.isNotNull())
    df = df.withColumn("_p", F.when(F.size("_d") == 0, F.array().cast("array<int>")).when(few, listed).otherwise(F.sort_array(by_order)))
    covered = F.aggregate(F.transform("_p", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("_p", i + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    return df.select("doc_id", "source", "sig", "text_md5", "n_words", "word_chars", "n_symbols", "n_dup_lines", covered.cast("long").alias("n_repeat_words"), "lines")


def frequent_lines(figures: DataFrame, max_documents: int = MAX_DOCUMENTS, max_line_words: int = MAX_LINE_WORDS) -> DataFrame:
    """(source, h) of short lines found in more than ``max_documents`` distinct texts of the host."""
    seen = figures.select("source", "sig", F.explode(F.filter("lines", lambda x: x.w <= max_line_words)).alias("x")).select("source", "sig", "x.h")
    return seen.groupBy("source", "h", "sig").agg(F.lit(1).alias("one")).groupBy("source", "h").agg(F.count("one").alias("n")).where(F.col("n") > max_documents).select("source", "h")


def judged(docs: DataFrame, max_documents: int = MAX_DOCUMENTS, max_line_words: int = MAX_LINE_WORDS, min_kept: float = MIN_KEPT) -> DataFrame:
    """Base counts, ``removed_words``, ``frequent`` (hashes of the lines to remove), ``base_failed`` and ``kept`` per row of ``docs``."""
    figures = stored(base_figures(docs), "line-figures")
    frequent = stored(frequent_lines(figures, max_documents, max_line_words), "frequent-lines")
    # A text's lines meet the frequent ones on (source, hash): a hot host spreads over its hashes, a hot hash meets one row of the smaller side.
    lines = figures.select("source", "text_md5", F.explode(F.array_distinct(F.transform("lines", lambda x: x.h))).alias("h"))
    f = frequent.select(F.col("source").alias("_s"), F.col("h").alias("_h"))
    hits = lines.join(f, lines.source.eqNullSafe(f._s) & (lines.h == f._h)).groupBy("source", "text_md5").agg(F.collect_set("h").alias("frequent"))
    hits = hits.select(F.col("source").alias("_s"), F.col("text_md5").alias("_m"), "frequent")
    out = figures.join(hits, figures.source.eqNullSafe(hits._s) & (figures.text_md5 == hits._m), "left")
    frequent_set = F.coalesce("frequent", F.array().cast("array<bigint>"))
    removed = F.aggregate(F.filter("lines", lambda x: F.array_contains("frequent", x.h) & (x.w <= max_line_words)), F.lit(0), lambda a, x: a + x.w)
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = out.withColumn("frequent", frequent_set).withColumn("removed_words", removed.cast("long")).withColumn("base_failed", base)
    left = F.col("n_words") - F.col("removed_words")
    return out.select(
        "doc_id", "source", "text_md5", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "removed_words", "frequent", "base_failed",
        (~F.col("base_failed") & (left >= min_kept * F.col("n_words"))).alias("kept"),
    )


def cleaned(docs: DataFrame, **limits) -> DataFrame:
    """The documents that pass, without their frequent lines, in the columns of ``docs``."""
    verdicts = judged(docs, **limits).where("kept").groupBy("source", "text_md5").agg(F.first("frequent").alias("_frequent"))
    verdicts = verdicts.select(F.col("source").alias("_vs"), F.col("text_md5").alias("_vm"), "_frequent")
    own = docs.select(F.struct("*").alias("_row"), F.col("source").alias("_source"), F.col("text").alias("_text"), F.md5(F.coalesce("text", F.lit(""))).alias("_md5"))
    df = own.join(verdicts, own._source.eqNullSafe(verdicts._vs) & (own._md5 == verdicts._vm))
    limit = limits.get("max_line_words", MAX_LINE_WORDS)
    short = lambda x: F.size(words_of(x)) <= limit
    kept = F.array_join(F.filter(F.split("_text", "\n"), lambda x: ~(F.array_contains("_frequent", line_hash(x)) & short(x) & (F.length(F.translate(x, GAPS, "")) > 0))), "\n")
    df = df.withColumn("_text", F.when(F.size("_frequent") == 0, F.col("_text")).otherwise(kept))
    new = {"text": F.col("_text"), "n_chars": F.length("_text").cast("long")}
    return df.select(*[(new[c] if c in new else F.col("_row").getField(c)).alias(c) for c in docs.columns])

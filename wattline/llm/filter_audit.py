"""How five document filters interact: counts for every order in which they could be applied.

Four filters look at one text. The fifth, E, fails a text that a smaller id has too, which needs all texts. A counting Bloom sketch
comes first: every text adds to two of 2^k counters, each task's partial counts are merged by one small shuffle, and of the merged
sketch the counters above one are kept as bitmaps. A text with a counter of exactly one is certainly unique and never moves. Only the
others are shuffled and grouped by their full text for the least id; a digest then brings that id back to their rows. What a document
fails is a mask of five bits, and all reports are sums over counts per part and mask.

The sketch has ``SLOTS_PER_TEXT`` counters a text, so that about one unique text in seventy takes the shuffle, and at most
``MOST_SLOTS`` (the bitmaps, which are broadcast, then have 64 MB). Beyond 33 million texts more unique texts take the shuffle; results
are the same.

Defined cases: a null text is an empty one; the part of a null ``lang`` is the empty string; a null id is not compared and so never
fails E or makes another fail it; rows with equal ids and texts don't fail each other; a document is good or toxic if any label row of
its id says so; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wattline.llm.common import GAP_PATTERN, GAPS, stored

FILTERS = "ABCDE"
MIN_WORDS = 200
#: Least per cent of words that are distinct, most per cent of characters that are capitals, and characters that fail a text.
MIN_DISTINCT = 50
MAX_CAPITALS = 3
SYMBOLS = "[#$%&*|]"
SLOTS_PER_TEXT = 16
MOST_SLOTS = 1 << 29
#: Counters of a bitmap.
SEGMENT = 1 << 15


def own_flags(docs: DataFrame) -> DataFrame:
    """``docs`` (with ``text`` not null) and the bits of the filters A to D that a text fails, as ``mask``."""
    text = F.col("text")
    trimmed = F.trim(text, F.lit(GAPS))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, GAP_PATTERN))
    rows = docs.withColumn("words", words)
    fails = [
        F.size("words") < MIN_WORDS,
        100 * F.size(F.array_distinct("words")) < MIN_DISTINCT * F.size("words"),
        100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > MAX_CAPITALS * F.length(text),
        F.rlike(text, F.lit(SYMBOLS)),
    ]
    return rows.withColumn("mask", sum((f.cast("int") * (1 << i) for i, f in enumerate(fails)), F.lit(0))).drop("words")


def _slots(text: Column, slots: int) -> list[Column]:
    """Two counters of a text, from different bits of one hash."""
    h = F.xxhash64(text)
    return [h.bitwiseAND(F.lit(slots - 1)), F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(slots - 1))]


def possible_repeats(docs: DataFrame, slots: int | None = None) -> DataFrame:
    """The rows of ``docs`` (with ``text`` not null) whose counters are all above one: each text that occurs twice is among them."""
    if slots is None:
        slots = min(MOST_SLOTS, max(SEGMENT, 1 << math.ceil(math.log2(SLOTS_PER_TEXT * max(1, docs.count())))))
    both = _slots(F.col("text"), slots)
    counted = docs.select(F.explode(F.array(*both)).alias("slot")).groupBy("slot").count().where("count > 1")
    segments = counted.groupBy((F.col("slot") / SEGMENT).cast("int").alias("segment")).agg(F.bitmap_construct_agg(F.col("slot") % SEGMENT).alias("bits"))
    segments = stored(segments, "repeat-sketch")
    rows = docs
    for i, slot in enumerate(both):
        found = segments.select(F.col("segment").alias(f"_segment{i}"), F.col("bits").alias(f"_bits{i}"))
        rows = rows.withColumn(f"_slot{i}", slot).join(F.broadcast(found), (F.col(f"_slot{i}") / SEGMENT).cast("int") == F.col(f"_segment{i}"))
        at = (F.col(f"_slot{i}") % SEGMENT).cast("int")
        byte = F.conv(F.hex(F.substring(f"_bits{i}", F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
        rows = rows.where(F.bit_get(byte, at % 8) == 1)
    return rows.select(*docs.columns)


def least_ids(docs: DataFrame) -> DataFrame:
    """(digest, first_id) of every text that more than one row has; the rows are grouped by their full text."""
    rows = possible_repeats(docs.select("doc_id", "text"))
    firsts = rows.groupBy("text").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return firsts.select(F.sha2("text", 256).alias("digest"), "first_id")


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents by the filters that they fail."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("")).alias("part"))
    firsts = least_ids(rows)
    flagged = own_flags(rows).select("doc_id", "part", "mask", F.sha2("text", 256).alias("digest")).join(firsts, "digest", "left")
    copy = F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False))
    flagged = flagged.select("doc_id", "part", (F.col("mask") + copy.cast("int") * 16).alias("mask"))
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    marked = flagged.join(marks, "doc_id", "left")
    return marked.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))


def outcomes(spark: SparkSession) -> DataFrame:
    """What each step of each order does with each mask: 120 orders, 5 steps and 32 masks."""
    number = F.col("id")
    digits = F.array(*[(F.floor(number / 5**i) % 5).cast("int") for i in range(len(FILTERS))])
    orders = spark.range(5 ** len(FILTERS)).select(digits.alias("filters")).where(F.size(F.array_distinct("filters")) == len(FILTERS))
    letters = F.array_join(F.transform("filters", lambda d: F.substring(F.lit(FILTERS), d + 1, F.lit(1))), "")
    steps = orders.select(letters.alias("filter_order"), "filters", F.posexplode("filters").alias("at", "filter"))
    bit = F.expr("shiftleft(1, filter)")
    before = F.aggregate(F.slice("filters", F.lit(1), F.col("at")), F.lit(0), lambda total, d: total + F.call_function("shiftleft", F.lit(1), d))
    steps = steps.select("filter_order", (F.col("at") + 1).cast("int").alias("step"), bit.alias("bit"), before.alias("before"), F.explode(F.sequence(F.lit(0), F.lit(31))).alias("mask"))
    fails, gone = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0
    return steps.select(
        "filter_order", "step", "mask", (~fails & ~gone).alias("kept"), (fails & ~gone).alias("removed"), (fails & gone).alias("redundant"),
        (F.col("mask") == F.col("bit")).alias("alone"), F.when(fails, F.floor(120 / F.bit_count("mask"))).otherwise(0).cast("long").alias("first_in"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part, order and step: (part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)."""
    counts = stored(masks(docs, labels), "filter-masks")
    rows = counts.join(F.broadcast(outcomes(docs.sparkSession)), "mask")
    total = lambda column, when: F.sum(F.when(F.col(when), F.col(column)).otherwise(0)).cast("long")
    return rows.groupBy("part", "filter_order", "step").agg(
        total("n", "kept").alias("kept"), total("n", "removed").alias("removed"), total("n", "redundant").alias("redundant"), total("n", "alone").alias("unique_fails"),
        total("good", "removed").alias("good_lost"), total("toxic", "removed").alias("toxic_lost"), F.sum(F.col("n") * F.col("first_in")).cast("long").alias("shapley"),
    )

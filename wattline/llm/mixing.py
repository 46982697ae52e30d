"""Mixing sources to target weights over fixed-length blocks of words.

Only DataFrame functions are used. Each source's documents lie behind each other in a pseudorandom order and are cut into blocks of
``BLOCK`` words. Targets share ``volume`` times all words by weight, stop at ``most`` times a source and hand the excess on. The output
has shards of ``SHARD`` slots. Every slot draws its source, so a shard's counts are multinomial; where the draws of all shards together
miss a source's exact number of slots, surplus slots are handed to the sources that lack some. Slot ``k`` of a source reads block
``permuted(k)`` of pass ``k div blocks``, and the last slot of a source takes only the words that its target still lacks.

Documents are never gathered by source: the order within a source is cut into buckets of about ``BUCKET`` documents by hash range, and
only bucket totals are summed up per source.

Defined cases: a null or empty text has size 0 and takes nothing; a null source is one source, ordered last; repeated rows are documents
of their own; without words nothing is taken; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from wattline.llm.common import number_from_hash, stored, words_of

BLOCK = 128
SHARD = 256
BUCKET = 1024
ROUNDS = 8
CELLS = 4096
SLOTS_A_TASK = 25_000
WEIGHTS = (3, 1, 2)
VOLUME = 1.5
MOST = 2


def shuffled_index(k: Column, n: Column, source: Column, turn: Column, backwards: bool = False) -> Column:
    """A permutation of 0..n-1 by swap-or-not rounds: each round maps x to (c - x) mod n or leaves it, as a bit of the larger one says."""

    def step(x: Column, i: Column) -> Column:
        i = F.lit(ROUNDS - 1) - i if backwards else i
        key = F.concat_ws("|", source, turn, i)
        partner = F.pmod(number_from_hash(F.md5(key)) - x, n)
        bit = F.substring(F.md5(F.concat_ws("|", key, F.greatest(x, partner))), 1, 1) < "8"
        return F.when(bit, partner).otherwise(x)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), k, step)


def doc_digest() -> Column:
    """Digest of a document's id, source and text; it orders the documents of a source."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("doc_id", "source", "text")]
    return F.md5(F.concat(parts[0], F.lit(":"), parts[1], F.lit(":"), parts[2]))


def sized(docs: DataFrame) -> DataFrame:
    """Documents with their size and a place in the pseudorandom order of their source."""
    return docs.select("doc_id", "source", F.size(words_of(F.col("text"))).cast("long").alias("size"), doc_digest().alias("digest"))


def source_plan(sizes: DataFrame, weights=WEIGHTS, volume: float = VOLUME, most: int = MOST) -> DataFrame:
    """One row per source: number, words, target, whole passes, rest, blocks and slots."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("s", F.row_number().over(by_name) - 1)
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), F.col("s") % len(weights) + 1).cast("long"))
    # Sources reach their limit in the order of limit / weight; the level that is left for the others after each of them decides who is capped.
    order = Window.orderBy((F.lit(most) * F.col("source_size") / F.col("weight")), "s")
    everything = Window.partitionBy()
    per = per.withColumn("_all", F.lit(volume) * F.sum("source_size").over(everything)).withColumn("_w", F.sum("weight").over(everything))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_full", F.coalesce(F.sum(F.lit(most) * F.col("source_size")).over(before), F.lit(0))).withColumn("_used", F.coalesce(F.sum("weight").over(before), F.lit(0)))
    per = per.withColumn("_level", (F.col("_all") - F.col("_full")) / (F.col("_w") - F.col("_used")))
    capped = F.col("_level") * F.col("weight") >= F.lit(most) * F.col("source_size")
    per = per.withColumn("_free", F.min(F.when(~capped, F.struct(F.lit(most) * F.col("source_size") / F.col("weight"), "s", "_level"))).over(everything)["_level"])
    per = per.withColumn("target", F.when(capped, (F.lit(most) * F.col("source_size")).cast("double")).otherwise(F.col("_free") * F.col("weight")))
    per = per.withColumn("words", F.floor(F.col("target") + 0.5))
    per = per.withColumn("blocks", F.ceil(F.col("source_size") / BLOCK)).withColumn("passes", F.when(F.col("source_size") > 0, F.expr("words div source_size")).otherwise(F.lit(0).cast("long")))
    per = per.withColumn("rest", F.when(F.col("source_size") > 0, F.col("words") - F.col("passes") * F.col("source_size")).otherwise(F.lit(0).cast("long")))
    per = per.withColumn("short", F.col("blocks") * BLOCK - F.col("source_size"))  # words that the last block lacks
    last = shuffled_index(F.col("blocks") - 1, F.greatest("blocks", F.lit(1).cast("long")), F.col("s").cast("string"), F.col("passes").cast("string"), backwards=True)
    per = per.withColumn("last_at", last)
    plain = F.ceil(F.col("rest") / BLOCK)
    # If the last, shorter block is among the first slots of the unfinished pass, its missing words come from one more slot at most.
    more = F.when((F.col("last_at") < plain) & (plain * BLOCK - F.col("short") < F.col("rest")), 1).otherwise(0)
    per = per.withColumn("slots", F.col("passes") * F.col("blocks") + plain + more)
    return per.select("source", "s", "source_size", "target", "blocks", "passes", "rest", "short", "last_at", "slots")


def placed(sizes: DataFrame, plan: DataFrame) -> DataFrame:
    """Documents with the word offset at which they begin in their source."""
    buckets = -(-sizes.count() // BUCKET) or 1
    h = number_from_hash(F.col("digest"))
    df = sizes.withColumn("_b", F.floor(h / F.lit(float(1 << 60)) * buckets))
    totals = df.groupBy("source", "_b").agg(F.sum("size").alias("_n"))
    up_to = Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_from", F.coalesce(F.sum("_n").over(up_to), F.lit(0)))
    per = plan.withColumnRenamed("source", "_ps")
    totals = totals.join(per, totals.source.eqNullSafe(per._ps)).drop("_ps", "_n")
    totals = totals.withColumnRenamed("source", "_ts").withColumnRenamed("_b", "_tb")
    inside = Window.partitionBy("source", "_b").orderBy("digest", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    df = df.join(totals, df.source.eqNullSafe(totals._ts) & (df._b == totals._tb))
    return df.withColumn("start", F.col("_from") + F.col("_in")).drop("_b", "_ts", "_tb", "_from", "_in")


def drawn(plan: DataFrame) -> DataFrame:
    """Multinomial counts per output shard: (shard, s, n), and ``first``, the slot number of the source with which the shard begins."""
    spark = plan.sparkSession
    total = plan.agg(F.coalesce(F.sum("slots"), F.lit(0)).alias("n")).first().n
    width = -(-total // CELLS) or 1
    upto = Window.orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    spans = plan.where("slots > 0").select("s", "slots", F.coalesce(F.sum("slots").over(upto), F.lit(0)).alias("_lo"))
    spans = spans.withColumn("_hi", F.col("_lo") + F.col("slots")).withColumn("_cell", F.explode(F.sequence(F.expr(f"_lo div {width}"), F.expr(f"(_hi - 1) div {width}"))))
    slots = spark.range(total).select((F.col("id") / SHARD).cast("long").alias("shard"), F.pmod(number_from_hash(F.md5(F.concat(F.lit("slot|"), F.col("id")))), F.lit(max(total, 1))).alias("_u"))
    slots = slots.withColumn("_c", F.expr(f"_u div {width}"))
    hits = slots.join(spans, (slots._c == spans._cell) & (slots._u >= spans._lo) & (slots._u < spans._hi))
    counts = hits.groupBy("shard", "s").agg(F.count(F.lit(1)).alias("n"))
    # Running totals over shards in two levels, so that no source is summed up by one task.
    counts = stored(counts.withColumn("_g", (F.col("shard") / 1024).cast("long")), "shard-counts")
    groups = counts.groupBy("s", "_g").agg(F.sum("n").alias("_n"))
    groups = groups.select("s", "_g", F.coalesce(F.sum("_n").over(Window.partitionBy("s").orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_from"))
    inside = Window.partitionBy("s", "_g").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_in", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return counts.join(groups, ["s", "_g"]).select("shard", "s", "n", (F.col("_from") + F.col("_in")).alias("first"))


def slots_of(plan: DataFrame) -> DataFrame:
    """Every output slot: (shard, s, k), where k runs from 0 to the source's number of slots."""
    counts = drawn(plan)
    wanted = plan.select("s", "slots")
    got = counts.groupBy("s").agg(F.sum("n").alias("got"))
    both = wanted.join(got, "s", "left").fillna(0, ["got"])
    flat = counts.select("shard", "s", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("k"))
    flat = flat.join(wanted, "s")
    fitting = flat.where("k < slots").select("shard", "s", "k")
    over = both.where("got > slots").select("s", F.coalesce(F.sum(F.col("got") - F.col("slots")).over(Window.orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_from"))
    surplus = flat.where("k >= slots").join(over, "s").select("shard", (F.col("_from") + F.col("k") - F.col("slots")).alias("_r"))
    under = both.where("got < slots").withColumn("_from", F.coalesce(F.sum(F.col("slots") - F.col("got")).over(Window.orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    lacking = under.select("s", "got", "_from", F.explode(F.sequence(F.col("got"), F.col("slots") - 1)).alias("k")).select("s", "k", (F.col("_from") + F.col("k") - F.col("got")).alias("_r"))
    return fitting.unionByName(surplus.join(lacking, "_r").select("shard", "s", "k"))


def mixture(plan: DataFrame) -> DataFrame:
    """The mix as blocks: (shard, s, block, turn, taken), where ``taken`` is the number of words read from the start of the block."""
    total = plan.agg(F.coalesce(F.sum("slots"), F.lit(0)).alias("n")).first().n
    # The rows are small but each is hashed many times: they are dealt to more tasks than their bytes alone would get.
    df = slots_of(plan).join(plan.drop("source", "target"), "s").repartition(total // SLOTS_A_TASK + 1, "s", "k")
    df = df.withColumn("turn", F.expr("k div blocks")).withColumn("_j", F.expr("k % blocks"))
    df = df.withColumn("block", shuffled_index(F.col("_j"), F.col("blocks"), F.col("s").cast("string"), F.col("turn").cast("string")))
    length = F.when(F.col("block") == F.col("blocks") - 1, BLOCK - F.col("short")).otherwise(F.lit(BLOCK).cast("long"))
    before = F.col("_j") * BLOCK - F.when(F.col("_j") > F.col("last_at"), F.col("short")).otherwise(0)
    room = F.when(F.col("turn") < F.col("passes"), length).otherwise(F.greatest(F.lit(0).cast("long"), F.least(length, F.col("rest") - before)))
    return df.withColumn("taken", room).where("taken > 0").select("shard", "s", "block", "turn", "taken")


def mixed(docs: DataFrame, weights=WEIGHTS, volume: float = VOLUME, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """Placed documents, and the pieces that the mix takes: (s, start, digest, turn, at, n), with ``at`` counted in words of the document."""
    sizes = stored(sized(docs), "doc-sizes")
    plan = stored(source_plan(sizes, weights, volume, most), "source-plan")
    where = stored(placed(sizes, plan), "placed-docs")
    spans = where.where("size > 0").select("s", "start", "size", "digest", F.explode(F.sequence((F.col("start") / BLOCK).cast("long"), ((F.col("start") + F.col("size") - 1) / BLOCK).cast("long"))).alias("block"))
    pieces = spans.join(mixture(plan), ["s", "block"])
    lo = F.greatest(F.col("start"), F.col("block") * BLOCK)
    hi = F.least(F.col("start") + F.col("size"), F.col("block") * BLOCK + F.col("taken"))
    pieces = pieces.select("s", "start", "digest", "turn", "shard", (lo - F.col("start")).alias("at"), (hi - lo).alias("n")).where("n > 0")
    return where, pieces


def mix_report(docs: DataFrame, **how) -> DataFrame:
    """Per document: size, source_size, target and the words that the mix takes of it."""
    where, pieces = mixed(docs, **how)
    taken = pieces.groupBy("s", "start").agg(F.sum("n").alias("taken"))
    out = where.where("size > 0").join(taken, ["s", "start"], "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))
    return out.unionByName(where.where("size = 0").select("doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken")))


def mix_texts(docs: DataFrame, **how) -> DataFrame:
    """The mix in the columns of ``docs``: one row per document and pass, its text the words taken in that pass, joined by one space."""
    where, pieces = mixed(docs, **how)
    held = pieces.groupBy("s", "start", "digest", "turn").agg(F.sort_array(F.collect_list(F.struct("at", "n"))).alias("_cuts")).select("digest", "turn", "_cuts")
    own = docs.select(F.struct("*").alias("_row"), F.col("text").alias("_text"), doc_digest().alias("digest"))
    # Equal rows share a digest and lie behind each other; each has cuts of its own.
    first = own.groupBy("digest").agg(F.first("_row").alias("_row"), F.first("_text").alias("_text"))
    df = first.join(held, "digest").withColumn("_words", words_of(F.col("_text")))
    text = F.array_join(F.flatten(F.transform("_cuts", lambda c: F.slice("_words", (c.at + 1).cast("int"), c.n.cast("int")))), " ")
    df = df.select("_row", text.alias("_new"))
    new = {"text": F.col("_new"), "n_chars": F.length("_new").cast("long")}
    return df.select(*[(new[c] if c in new else F.col("_row").getField(c)).alias(c) for c in docs.columns])

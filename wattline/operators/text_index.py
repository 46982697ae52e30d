"""An inverted index in Parquet files, and ranked search (BM25) that reads the postings of a question's terms only.

The index is written once. Its rows are blocks of at most ``BLOCK`` postings of one term, best first, in folders by hash bucket of the
term and sorted by it inside, so that a question opens the folders of its terms and the file statistics drop the row groups of others.
A posting is a document number, its key, its columns and its impact: the part of the score that depends on the document. A block also has
its term's weight and its best impact. A bucket has lanes, more with more postings; the blocks of a common term lie in all of them, best first
in each.

With a large index a question reads the best block of each term first. The n-th best sum over those is a score that every result must
reach, and blocks whose best impact can't reach it, even with the best of all other terms, are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from wattline.operators.anchors import topk
from wattline.session import scratch_path

K1 = 1.2
B = 0.75
BLOCK = 1 << 7
BUCKETS = 32
#: Postings that a lane, a part of a bucket, has room for; a term with a quarter of them is dealt over all lanes.
LANE = 500_000
#: Postings above which a question looks at the best blocks first.
LARGE = 20_000_000


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def terms_of(question: str) -> list[str]:
    return sorted({t for t in re.split(r"[\W_]+", question.lower()) if t})


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def build(docs: DataFrame, key: str, text: str, columns: list[str], path: str, buckets: int = BUCKETS) -> TextIndex:
    """Write an index of ``docs`` below ``path``. Every row is a document of its own; a null text has no words and no part in the mean length."""
    spark = docs.sparkSession
    kept = [key, *[c for c in dict.fromkeys(columns) if c != key]]
    rows = docs.select(F.struct(*kept).alias("doc"), F.sort_array(tokens(F.col(text))).alias("words"))
    rows.withColumn("no", F.monotonically_increasing_id()).write.parquet(f"{path}/documents")  # numbers stay what they are
    rows = spark.read.parquet(f"{path}/documents")
    total, mean = rows.agg(F.count(F.lit(1)), F.avg(F.size("words"))).first()
    # Words of a document are sorted, so equal ones end where the next one differs: they are counted in their row and nothing is shuffled.
    last = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: (i == F.size("words") - 1) | (F.get("words", i) != F.get("words", i + 1)))
    ends = rows.where(F.size("words") > 0).select("no", "doc", "words", F.size("words").alias("length"), last.alias("ends"))
    runs = F.transform("ends", lambda e, j: F.struct(F.get("words", e).alias("term"), (e - F.coalesce(F.get("ends", j - 1), F.lit(-1))).cast("double").alias("tf")))
    counted = ends.select("no", "doc", "length", F.inline(runs))
    impact = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / (mean or 1.0)))
    postings = counted.select("term", "no", "doc", impact.alias("impact"))
    postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.max("impact").alias("best")).write.parquet(f"{path}/terms")
    of_term = spark.read.parquet(f"{path}/terms")
    lanes = max(1, -(-(of_term.agg(F.sum("df")).first()[0] or 0) // (buckets * LANE)))
    # A posting moves once: to its bucket and lane. The few terms with many postings are spread over all lanes of their bucket.
    common = of_term.where(F.col("df") > LANE // 4).select("term", F.lit(True).alias("_common"))
    lane = F.pmod(F.when(F.col("_common"), F.xxhash64("no")).otherwise(F.xxhash64("term", F.lit("lane"))), F.lit(lanes)).cast("int")
    place = ["bucket", "lane"]
    placed = postings.join(F.broadcast(common), "term", "left").select(_bucket(F.col("term"), buckets).alias("bucket"), lane.alias("lane"), "term", "no", "doc", "impact")
    # The terms' own numbers come along as a row in every lane that has postings of the term, so blocks need no join and stay where they are.
    weight = F.log(F.lit(1.0) + (F.lit(float(total)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    every = F.when(F.col("df") > LANE // 4, F.sequence(F.lit(0), F.lit(lanes - 1))).otherwise(F.array(F.pmod(F.xxhash64("term", F.lit("lane")), F.lit(lanes)).cast("int")))
    known = of_term.select(_bucket(F.col("term"), buckets).alias("bucket"), F.explode(every).alias("lane"), "term", weight.alias("weight"), "best")
    ordered = placed.unionByName(known, allowMissingColumns=True).repartition(*place).sortWithinPartitions(*place, "term", F.desc_nulls_first("impact"), "no")
    # Rows of a sorted partition are numbered one after the other, so every BLOCK of them hold the best postings left of one term or few.
    numbered = ordered.withColumn("block", F.floor(F.monotonically_increasing_id() / BLOCK))
    entry = F.when(F.col("no").isNotNull(), F.struct(F.col("impact"), "no", "doc"))
    numbers = [F.max(c).alias(c) for c in ("weight", "best")]
    blocks = numbered.groupBy(*place, "term", "block").agg(F.sort_array(F.collect_list(entry), asc=False).alias("entries"), *numbers)
    of_all = Window.partitionBy(*place, "term")
    final = blocks.withColumns({c: F.max(c).over(of_all) for c in ("weight", "best")}).where(F.size("entries") > 0)
    final = final.select("bucket", "term", "block", "weight", F.col("entries")[0]["impact"].alias("most"), "best", "entries")
    final.sortWithinPartitions("bucket", "term", "block").write.partitionBy("bucket").parquet(f"{path}/blocks")
    about = spark.createDataFrame([(key, kept[1:], buckets, total)], "key string, columns array<string>, buckets int, documents long")
    about.withColumn("postings", of_term.agg(F.sum("df")).scalar()).write.parquet(f"{path}/about")
    return TextIndex(spark, path)


class TextIndex:
    """An index that has been written."""

    def __init__(self, spark: SparkSession, path: str):
        self.documents_path = f"{path}/documents"
        about = spark.read.parquet(f"{path}/about").first()
        self.key, self.columns, self.buckets, self.documents, self.postings = about["key"], about["columns"], about["buckets"], about["documents"], about["postings"] or 0
        self.blocks = spark.read.parquet(f"{path}/blocks") if self.postings else None

    def blocks_of(self, terms: list[str]) -> DataFrame:
        """The blocks of some terms. The buckets are folded to literals, so only their folders are opened."""
        return self.blocks.where(F.col("bucket").isin(*[_bucket(F.lit(t), self.buckets) for t in terms]) & F.col("term").isin(terms))

    def _scored(self, blocks: DataFrame, terms: list[str], filters: dict[str, object]) -> DataFrame:
        rows = blocks.select("term", "weight", F.explode("entries").alias("_e"))
        rows = rows.select(F.col("term").alias("_term"), (F.col("weight") * F.col("_e.impact")).alias("_part"), F.col("_e.no").alias("_no"), "_e.doc.*")
        for column, value in filters.items():
            rows = rows.where(F.col(column) == value)
        # A column for each term, added in one order: equal texts get equal scores.
        parts = rows.groupBy("_no", self.key, *self.columns).agg(*[F.max(F.when(F.col("_term") == t, F.col("_part"))).alias(f"_s{i}") for i, t in enumerate(terms)])
        score = sum((F.coalesce(f"_s{i}", F.lit(0.0)) for i in range(len(terms))), F.lit(0.0))
        return parts.select(self.key, *self.columns, score.alias("score"))

    def search(self, question: str, filters: dict[str, object] | None = None, n: int = 10, look_first: bool | None = None) -> DataFrame:
        """(key, columns, score) of the ``n`` best documents, ties by key. Filters restrict the results and not the statistics.

        ``look_first``: read the best blocks first and leave out those that can't matter; by default with a large index. Results are
        the same.
        """
        terms, filters = terms_of(question), filters or {}
        if not terms or self.blocks is None:
            return self._nothing()
        blocks = self.blocks_of(terms)
        if self.postings > LARGE if look_first is None else look_first:
            blocks = self._reaching(blocks, terms, filters, n)
        order = [F.col("score").desc(), F.col(self.key).asc()]
        return topk(self._scored(blocks, terms, filters).where("score > 0"), order, n)

    def _reaching(self, blocks: DataFrame, terms: list[str], filters: dict[str, object], n: int) -> DataFrame:
        heads = blocks.where("most = best")
        sums = self._scored(heads, terms, filters).select("score").orderBy(F.desc("score")).limit(n).collect()
        if len(sums) < n:
            return blocks
        # A document of a block scores at most the block's best and the best of each other term; sums may be off by rounding.
        bests = heads.select("term", (F.col("weight") * F.col("best")).alias("b")).distinct().agg(F.sum("b")).first()[0]
        return blocks.where(F.lit(bests) - F.col("weight") * F.col("best") + F.col("weight") * F.col("most") >= sums[-1]["score"] * (1 - 1e-9))

    def _nothing(self) -> DataFrame:
        return SparkSession.active().read.parquet(self.documents_path).limit(0).select("doc.*", F.lit(0.0).alias("score"))


_BUILT: dict[tuple, TextIndex] = {}


def index_of(docs: DataFrame, key: str, text: str, columns: list[str]) -> TextIndex:
    """The index of a table that is read from files: built in the shared folder the first time, and again when its list of files changes."""
    spark = docs.sparkSession
    name = (spark.sparkContext.applicationId, key, text, tuple(columns), tuple(sorted(docs.inputFiles())))
    if name not in _BUILT:
        _BUILT[name] = build(docs, key, text, columns, scratch_path(spark, "text-index"))
    return _BUILT[name]

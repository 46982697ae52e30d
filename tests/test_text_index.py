"""Ranked search from an index against a plain scorer."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from wattline.operators import text_index


def plain(docs, question, n, keep=lambda d: True):
    words = [[w for w in re.split(r"[\W_]+", t.lower()) if w] if t is not None else None for _, t, _ in docs]
    lengths = [len(w) for w in words if w is not None]
    mean = sum(lengths) / len(lengths)
    out = []
    for d, w in zip(docs, words):
        score = 0.0
        for term in sorted(set(re.split(r"[\W_]+", question.lower())) - {""}):
            df = sum(term in x for x in words if x)
            tf = (w or []).count(term)
            if tf:
                score += math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))
        if score > 0 and keep(d):
            out.append((d[0], round(score, 8)))
    return sorted(out, key=lambda x: (-x[1], x[0]))[:n]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(rng.choices(words, weights=[60 / (k + 1) for k in range(60)], k=rng.choice([1, 8, 40, 90]))), rng.choice(["en", "de", None])) for i in range(900)]
    return docs + [(901, "Pump pump, VALVE!", "en"), (902, "valve", "en"), (903, None, "en"), (904, "", "de"), (905, docs[5][1], docs[5][2]), (5, docs[5][1], docs[5][2])]


@pytest.fixture(scope="module")
def index(spark, corpus, tmp_path_factory):
    df = spark.createDataFrame(corpus, "id int, text string, term string").repartition(5)
    path = str(tmp_path_factory.mktemp("index") / "a")
    text_index.build(df, "id", "text", ["term"], path, buckets=8)
    return text_index.TextIndex(spark, path)  # opened anew


@pytest.mark.parametrize("first", [False, True])
@pytest.mark.parametrize("question", ["valve pump", "w0", "w0 w1 w2", "w59 w0", "W41, w40; nothing", "nothing at all", "", "-- !!"])
def test_search_equals_plain_scorer(index, corpus, question, first):
    for n in (3, 20, 2000):
        got = [(r["id"], round(r["score"], 8)) for r in index.search(question, n=n, look_first=first).collect()]
        assert sorted(got, key=lambda x: (-x[1], x[0])) == plain(corpus, question, n)


@pytest.mark.parametrize("first", [False, True])
def test_filters_restrict_results_only(index, corpus, first):
    got = [(r["id"], round(r["score"], 8), r["term"]) for r in index.search("w0 w3 w50", {"term": "de"}, 15, first).collect()]
    assert [x[:2] for x in got] == plain(corpus, "w0 w3 w50", 15, lambda d: d[2] == "de") and {x[2] for x in got} == {"de"}


def test_blocks_are_small_and_hold_the_best_first(index, corpus):
    rows = index.blocks.where("term = 'w0'").orderBy("block").select("most", F.size("entries").alias("n"), "entries.impact").collect()
    n = sum(t is not None and "w0" in t.split() for _, t, _ in corpus)
    assert max(r["n"] for r in rows) <= text_index.BLOCK and len(rows) > 2 and sum(r["n"] for r in rows) == n
    flat = [x for r in rows for x in r["impact"]]
    assert flat == sorted(flat, reverse=True)


def test_a_question_opens_its_buckets_only(index):
    plan = index.blocks_of(["w1"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and re.search(r"bucket#\d+ = \d|bucket#\d+ IN \(\d", plan)
    scanned = index.blocks_of(["w1"]).select(F.input_file_name()).distinct().count()
    assert scanned < len(index.blocks.inputFiles())


def test_large_questions_read_fewer_blocks(spark, tmp_path):
    docs = spark.range(20000).select("id", F.concat(F.lit("common "), F.when(F.col("id") % 5000 == 7, "rare rare rare").otherwise(F.repeat(F.lit("filler "), (F.col("id") % 50).cast("int")))).alias("text"))
    index = text_index.build(docs, "id", "text", [], str(tmp_path / "b"), buckets=4)
    blocks = index.blocks_of(["filler"])
    assert index._reaching(blocks, ["filler"], {}, 3).count() < blocks.count() / 10
    assert {r["id"] for r in index.search("rare common", n=4, look_first=True).collect()} == {7, 5007, 10007, 15007}


def test_an_index_of_no_words(spark, tmp_path):
    docs = spark.createDataFrame([(1, None), (2, " ")], "id int, text string")
    for i, df in enumerate((docs, docs.limit(0))):
        index = text_index.build(df, "id", "text", [], str(tmp_path / str(i)))
        assert index.search("a").collect() == [] and index.search("a").columns == ["id", "score"]


def test_the_index_of_a_table_is_built_once(spark, tmp_path):
    spark.createDataFrame([(1, "pump")], "id int, text string").write.parquet(str(tmp_path / "t"))
    first = text_index.index_of(spark.read.parquet(str(tmp_path / "t")), "id", "text", [])
    assert text_index.index_of(spark.read.parquet(str(tmp_path / "t")), "id", "text", []) is first
    spark.createDataFrame([(2, "valve")], "id int, text string").write.mode("append").parquet(str(tmp_path / "t"))
    second = text_index.index_of(spark.read.parquet(str(tmp_path / "t")), "id", "text", [])
    assert second is not first and [r["id"] for r in second.search("valve").collect()] == [2]


def test_lanes_hold_all_postings(spark, corpus, tmp_path, monkeypatch):
    """A small lane size: common terms lie in several lanes of their bucket, and each block knows its term's numbers."""
    monkeypatch.setattr(text_index, "LANE", 200)
    df = spark.createDataFrame(corpus, "id int, text string, term string").repartition(3)
    index = text_index.build(df, "id", "text", ["term"], str(tmp_path / "lanes"), buckets=4)
    for first in (False, True):
        got = [(r["id"], round(r["score"], 8)) for r in index.search("w0 w1 w59", n=20, look_first=first).collect()]
        assert sorted(got, key=lambda x: (-x[1], x[0])) == plain(corpus, "w0 w1 w59", 20)
    rows = index.blocks.groupBy("term").agg(F.sum(F.size("entries")).alias("n"), F.max("most").alias("most"), F.min("best").alias("best"), F.count_distinct("weight").alias("weights")).collect()
    assert all(r["most"] == r["best"] and r["weights"] == 1 for r in rows) and sum(r["n"] for r in rows) == index.postings

"""Token counts, filter interactions and vector codes against plain versions on small inputs."""

import hashlib
import itertools
import math
import random
import re

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from wattline.llm import filter_audit, token_counts, vector_codes

JSON, MODEL = "byte_bpe_50k.json", "piece_bpe_32k.model"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(file, texts):
    if file.endswith(".json"):
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(public_tokenizers.path(file))
        return [len(own.encode(t, add_special_tokens=False).ids) for t in texts]
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(file))
    return [len(own.encode(t)) for t in texts]


def odd_docs(spark):
    texts = ["a <|endoftext|> b", "<|endoftext|>" * 3, "é́ ﬁ 日本語 \u0000 x", "a <|endoftext|> b", None, "", "   \n\n\t ", "Ａ" * 2000, "ab " * 30000]
    return spark.createDataFrame([(i if i != 3 else None, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, digest string")


@pytest.mark.parametrize("file", [JSON, "word_bpe_49k.json", MODEL])
def test_token_counts_equal_the_library(spark, edge_docs, file):
    for docs in (edge_docs, odd_docs(spark)):
        rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
        expected = sorted(((i, len(t.encode()), n, n > 1024) for (i, t), n in zip(rows, plain_counts(file, [t for _, t in rows]))), key=repr)
        got = token_counts.token_counts(docs, public_tokenizers.path(file))
        assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
        assert sorted(map(tuple, got.collect()), key=repr) == expected


def test_only_distinct_misses_are_encoded_and_appended(spark, edge_docs, tmp_path):
    file, cache = public_tokenizers.path(JSON), str(tmp_path / "cache")
    part = f"{cache}/tokenizer={token_counts.tokenizer_digest(file)}"
    cold = token_counts.token_counts(edge_docs.where("doc_id < 9"), file, cache).collect()
    stored = spark.read.parquet(part)
    texts = {r["text"] or "" for r in edge_docs.where("doc_id < 9").collect()}
    assert len(cold) == 9 and stored.count() == len(texts)

    # Stored counts are used: a changed one shows, and the contents that it knows are not appended again.
    wrong = spark.createDataFrame([(hashlib.sha256(b"one two three").digest(), 777)], token_counts.CACHED)
    wrong.write.mode("append").parquet(part)
    warm = token_counts.token_counts(edge_docs, file, cache)
    assert {r["n_tokens"] for r in warm.where("doc_id = 7").collect()} == {777}
    assert warm.count() == edge_docs.count()
    every = {r["text"] or "" for r in edge_docs.collect()}
    assert spark.read.parquet(part).count() == len(every) + 1
    again = token_counts.token_counts(edge_docs, file, cache).count()
    assert again == edge_docs.count() and spark.read.parquet(part).count() == len(every) + 1

    # Another tokenizer has counts of its own.
    other = public_tokenizers.path(MODEL)
    assert token_counts.token_counts(edge_docs.where("doc_id = 7"), other, cache).first()["n_tokens"] != 777


def test_malformed_bytes_count_as_replacements(spark):
    docs = spark.sql("SELECT 1L AS doc_id, cast(unhex('61FF62') AS string) AS text")
    row = token_counts.token_counts(docs, public_tokenizers.path(JSON)).first()
    assert row["n_bytes"] == 3 and row["n_tokens"] == plain_counts(JSON, ["a�b"])[0]


def test_a_file_of_another_kind_is_refused():
    with pytest.raises(ValueError, match="no library"):
        token_counts.tokenizer_digest("vocabulary.txt")


def plain_audit(docs, labels):
    good, toxic = ({i for i, q, t in labels if i is not None and (q, t)[k] == 1} for k in (0, 1))
    fails = []
    for i, text, lang in docs:
        t = text or ""
        words = WORD.findall(t)
        own = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t))}
        own["E"] = i is not None and any(j is not None and j < i and (other or "") == t for j, other, _ in docs)
        fails.append((lang or "", {f for f, x in own.items() if x}, i in good, i in toxic))
    orders = ["".join(p) for p in itertools.permutations("ABCDE")]
    out, shapley = {}, {}
    for part in {x[0] for x in fails}:
        for order in orders:
            kept = [x for x in fails if x[0] == part]
            all_rows = list(kept)
            for step, f in enumerate(order, 1):
                gone = [x for x in kept if f in x[1]]
                kept = [x for x in kept if f not in x[1]]
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
                out[part, order, step] = (len(kept), len(gone), sum(f in x[1] for x in all_rows) - len(gone), sum(x[1] == {f} for x in all_rows), sum(x[2] for x in gone), sum(x[3] for x in gone))
    return sorted((part, order, step, *row, shapley[part, order[step - 1]]) for (part, order, step), row in out.items())


def audit_rows(docs, labels):
    return sorted(map(tuple, filter_audit.audit(docs, labels).collect()))


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_filter_audit_equals_plain_version(spark, edge_docs):
    marks = [(1, 1, 0), (1, 0, 1), (2, 1, 1), (7, None, None), (12, 0, 1), (15, 1, 0), (17, 1, None), (None, 1, 1), (99, 1, 1)]
    docs = edge_docs.withColumn("mask", F.lit("clash")).withColumn("first_id", F.lit("clash"))
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    assert audit_rows(docs, labels_of(spark, marks)) == plain_audit(rows, marks)


def test_filter_audit_of_random_texts(spark):
    rng = random.Random(4)
    pool = [" ".join(rng.choice(["aa", "Bb", "c#c", "dd", "ee", "ff" + str(k)]) for k in range(rng.choice([3, 150, 250]))) for _ in range(25)]
    docs = [(rng.choice([None, *range(60)]), rng.choice(pool), rng.choice(["en", "de", "", None])) for _ in range(120)]
    marks = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    assert audit_rows(df, labels_of(spark, marks)) == plain_audit(docs, marks)


def test_filter_audit_of_no_documents(spark, no_docs):
    assert audit_rows(no_docs, labels_of(spark, [])) == []


def test_sketch_keeps_every_repeat_and_clears_most_others(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.when(F.col("id") < 3000, F.col("id")).otherwise(F.col("id") % 50)).alias("text"))
    for slots in (None, 1 << 15, 64):  # the last is far too small: everything passes, nothing is lost
        kept = {r["doc_id"] for r in filter_audit.possible_repeats(docs, slots).select("doc_id").collect()}
        assert kept >= {*range(50), *range(3000, 4000)}
        assert slots == 64 or len(kept) < 1050 + 400
    firsts = {r["first_id"] for r in filter_audit.least_ids(docs).collect()}
    assert firsts == set(range(50))


def plain_codes(rows, parts=8, entries=16, rounds=6):
    kept = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    size = -(-max((len(v) for _, v, _ in kept), default=0) // parts)
    cut = [[[math.floor(4096 * x) for x in (list(v) + [0] * (size * parts))[p * size : (p + 1) * size]] for p in range(parts)] for _, v, _ in kept]
    order = sorted(range(len(kept)), key=lambda n: (kept[n][0] is None, kept[n][0] or 0, kept[n][1]))[:entries]
    books = [[cut[n][p] for n in order] for p in range(parts)]

    def assign():
        out = []
        for row in cut:
            far = [[sum((a - b) ** 2 for a, b in zip(row[p], e)) for e in books[p]] for p in range(parts)]
            out.append([(min(f), f.index(min(f))) for f in far])
        return out

    for _ in range(rounds):
        at = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [row[p] for row, a in zip(cut, at) if a[p][1] == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own)]
    at = assign()
    errors = [sum(d for d, _ in a) for a in at]
    digest = hashlib.sha256(",".join(str(x) for p in books for e in p for x in e).encode()).hexdigest()
    totals = {}
    for (_, _, label), e in zip(kept, errors):
        totals[label] = totals.get(label, 0) + e
    return sorted(((i, "".join("%02x" % k for _, k in a), e, totals[label], digest) for (i, _, label), a, e in zip(kept, at, errors)), key=repr)


def coded(spark, rows, partitions=3):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(partitions, "vec_id")
    df = df.withColumns({c: F.lit("clash") for c in ("code", "error", "same", "at")})
    return sorted(map(tuple, vector_codes.compressed(df).collect()), key=repr)


def vectors(seed, n, size):
    rng = random.Random(seed)
    return [(i, [rng.randrange(-40, 40) / 64 for _ in range(size)], rng.choice([1, 2, None])) for i in range(n)]


@pytest.mark.parametrize("n, size", [(120, 16), (7, 16), (60, 5), (40, 24)])
def test_codes_equal_plain_version(spark, n, size):
    rows = vectors(n, n, size)
    assert coded(spark, rows) == plain_codes(rows)


def test_codes_of_odd_vectors(spark):
    rows = vectors(5, 30, 16)
    same = rows[3][1]
    rows += [(50, None, 1), (51, [0.5, None] * 8, 1), (52, [float("nan")] * 16, 2), (53, [float("-inf")] + [0.0] * 15, 2), (54, [0.0] * 16, 3), (55, [], 3), (56, [0.25] * 3, None)]
    rows += [(3, same, 1), (3, same, 1), (3, [0.125] * 16, 1), (None, [0.1] * 16, 1), (-9, [-0.001] * 16, None)]
    assert coded(spark, rows) == plain_codes(rows)


def test_codes_of_no_vectors_and_of_empty_ones(spark):
    assert coded(spark, [(1, None, 1)]) == []
    rows = [(1, [], 1), (2, [], None)]
    assert coded(spark, rows) == plain_codes(rows)


def test_components_that_would_overflow_are_refused(spark):
    with pytest.raises(Exception, match="not supported"):
        coded(spark, [(1, [20000.0] * 8, 1)])

"""Operators over documents on null, empty, long, repeated and clashing rows, against plain versions."""

import hashlib
import itertools
from collections import Counter

import duckdb
import pandas as pd

from wattline.llm import checks, mixing, near_dedup, piece_codec, quality_classifier, quality_rules, suffix_dedup, toxicity, window_dedup


def listed(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


def texts_of(df):
    return [(r.doc_id, (r.text or "").encode()) for r in df.select("doc_id", "text").collect()]


def in_duckdb(df, sql):
    con = duckdb.connect()
    frame = df.select("doc_id", "text", "source").toPandas()
    frame["doc_id"] = frame["doc_id"].astype("Int64")
    con.register("frame", frame.astype({"text": object, "source": object}).where(pd.notna(frame), None))
    con.execute("CREATE TABLE documents AS SELECT doc_id::BIGINT AS doc_id, text::VARCHAR AS text, source::VARCHAR AS source FROM frame")
    res = con.execute(sql)
    return [c[0] for c in res.description], res.fetchall()


def shingles(text):
    w = text.lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_near_duplicates(edge_docs):
    rows = texts_of(edge_docs)
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and sets[j] and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
            parent[root(i)] = root(j)
    expected = Counter()
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        component = min(ids) if ids and sets[i] else doc_id
        expected[(doc_id, len(sets[i]), component, doc_id == component)] += 1
    out = near_dedup.near_duplicates(edge_docs)
    assert listed(out, "doc_id", "n_shingles", "component_id", "kept") == expected
    kept = near_dedup.deduplicated(edge_docs)
    assert kept.columns == edge_docs.columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} >= {1, 4, 5, 7} and 2 not in {r.doc_id for r in kept.select("doc_id").collect()}


def test_blocks_find_links_that_no_centre_has(spark, monkeypatch):
    """Chains of copies in small blocks, so that every way through buckets is taken."""
    monkeypatch.setattr(near_dedup, "BLOCK", 3)
    words = [f"v{i}" for i in range(200)]
    rows = []
    for i in range(40):
        changed = list(words)
        for k in range(i % 8 + 1):
            changed[(i * 11 + k * 23) % 200] = f"x{i}_{k}"
        rows.append((i, " ".join(changed)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [shingles(t.encode()) for _, t in rows]
    parent = list(range(40))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(40), 2):
        both = len(sets[i] & sets[j])
        if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
            a, b = sorted((root(i), root(j)))
            parent[b] = a
    assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs).collect()} == {i: root(i) for i in range(40)}


def test_repeated_windows(edge_docs):
    rows = texts_of(edge_docs)
    first = {}
    for i, t in rows:
        w = t.split()
        for k in range(len(w) - 49):
            if i is not None:
                g = tuple(w[k : k + 50])
                first[g] = min(i, first.get(g, i))
    expected = Counter()
    for i, t in rows:
        w = t.split()
        keep = [True] * len(w)
        for k in range(len(w) - 49):
            if i is not None and first[tuple(w[k : k + 50])] < i:
                keep[k : k + 50] = [False] * 50
        expected[(i, len(w), len(w) - sum(keep), hashlib.sha256(b" ".join(x for x, y in zip(w, keep) if y)).hexdigest())] += 1
    assert listed(window_dedup.deduplicated_rows(edge_docs), "doc_id", "n_words", "n_removed", "kept_sha256") == expected
    cut = window_dedup.deduplicated(edge_docs)
    assert cut.columns == edge_docs.columns and 2 not in {r.doc_id for r in cut.collect()}


def removed_bytes(rows):
    seen = Counter(t[k : k + 400] for _, t in rows for k in range(len(t) - 399))
    out = Counter()
    for i, t in rows:
        gone = bytearray(len(t))
        for k in range(len(t) - 399):
            if seen[t[k : k + 400]] > 1:
                gone[k : k + 400] = b"\1" * 400
        rest = bytes(x for x, g in zip(t, gone) if not g)
        spans = sum(1 for k in range(len(t)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[(i, len(t), len(t) - len(rest), spans, hashlib.sha256(rest).hexdigest())] += 1
    return out


def test_repeated_bytes(edge_docs, monkeypatch):
    short = edge_docs.where("doc_id IS NULL OR doc_id <> 17")
    columns = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    expected = removed_bytes(texts_of(short))
    assert listed(suffix_dedup.deduplicated_rows(short), *columns) == expected
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 4000)  # many buckets, so that equal suffixes meet across boundaries
    assert listed(suffix_dedup.deduplicated_rows(short), *columns) == expected


def test_multikey_order_is_byte_order():
    import numpy as np

    rows = np.random.default_rng(1).integers(0, 3, (2000, 463)).astype(np.uint8)
    rows[500:900, :200] = rows[3, :200]
    rows[600:640] = rows[5]
    got = [rows[i].tobytes() for i in suffix_dedup.multikey_order(rows)]
    assert got == sorted(r.tobytes() for r in rows)


def test_line_rules(edge_docs, spark):
    shared = "shared furniture line 1"
    rows = [(100 + i, shared + "\n" + " ".join(f"u{i}_{k}" for k in range(60)) + "\n" + shared.replace("1", str(i)), "en", "hot", 1) for i in range(14)]
    rows += [(200, "\n".join([shared] * 16) + "\nleft over", "en", "hot", 1), (201, "\n".join([shared] * 16), "en", "cold", 1)]
    docs = edge_docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    out = quality_rules.judged(docs)
    names, expected = in_duckdb(docs, checks.quality_rules())
    assert listed(out, *names) == Counter(expected)
    verdict = {r.doc_id: (r.removed_words, r.kept) for r in out.collect() if r.doc_id}
    assert verdict[100] == (8, True) and verdict[200][1] is False and verdict[201][0] == 0
    kept = quality_rules.cleaned(docs)
    assert kept.columns == docs.columns and shared not in {r.doc_id: r.text for r in kept.collect()}[101]


def test_repeated_words_found_by_list_and_by_sorting(edge_docs, monkeypatch):
    columns = ("doc_id", "n_repeat_words")
    by_list = listed(quality_rules.base_figures(edge_docs), *columns)
    monkeypatch.setattr(quality_rules, "SHORT_LIST", 0)
    assert listed(quality_rules.base_figures(edge_docs), *columns) == by_list


def test_mix(edge_docs):
    out = mixing.mix_report(edge_docs)
    names, expected = in_duckdb(edge_docs, checks.mixing())
    assert listed(out, *names) == Counter(expected)
    assert all(r.taken <= 2 * r.size for r in out.collect())
    mixed = mixing.mix_texts(edge_docs)
    assert mixed.columns == edge_docs.columns
    words = sum(len((r.text or "").split()) for r in mixed.collect())
    assert abs(words - sum(r.taken for r in out.collect())) <= 5  # words of other white space are not cut here


def test_slots_are_exact_permutations(edge_docs):
    plan = mixing.source_plan(mixing.sized(edge_docs))
    slots = mixing.slots_of(plan).groupBy("s").agg({"k": "count"}).collect()
    wanted = {r.s: r.slots for r in plan.collect() if r.slots}
    assert {r.s: r["count(k)"] for r in slots} == wanted
    blocks = mixing.mixture(plan).groupBy("s", "turn", "block").count().where("count > 1")
    assert blocks.count() == 0


def test_pieces(edge_docs):
    import public_tokenizers
    import sentencepiece

    model = public_tokenizers.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=model)
    rows = [(i, t.decode()) for i, t in texts_of(edge_docs)]
    got = listed(piece_codec.digests(edge_docs, model), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "agrees")
    expected = Counter()
    for i, t in rows:
        ids = lib.encode(t)
        expected[(i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest(), True)] += 1
    assert got == expected


def test_pieces_of_odd_texts_match_the_library():
    import random

    import public_tokenizers

    own = piece_codec.Codec(public_tokenizers.path("piece_bpe_32k.model"))
    pick = random.Random(4)
    for _ in range(400):
        text = "".join(pick.choice("ab cé▁ \n\t日😀.,0thein<>\x00") for _ in range(pick.randint(0, 50)))
        ids = own.library.encode(text)
        assert own.encode(text) == ids and own.decode(ids) == own.library.decode(ids)


def test_classifiers_without_labels(edge_docs, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one_class = spark.createDataFrame([(1, 1, None), (3, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int")
    for labels in (none, one_class):
        assert {r.score for r in quality_classifier.scored(edge_docs, labels).collect()} == {0.5}
        assert {r.score for r in toxicity.scored(edge_docs, labels).collect()} == {0.0}


def test_classifiers_learn(spark):
    rows, labels = [], []
    for i in range(200):
        bad = i % 3 == 0
        rows.append((i, " ".join((f"BUY{k}!!!" if bad else f"plain{k}.") for k in range(i % 40 + 20)) + (" vile filth" if i % 4 == 0 else "")))
        labels.append((i, int(not bad), int(i % 4 == 0)))
    rows += [(500, None), (501, ""), (502, "vile filth")]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    quality = {r.doc_id: r.score for r in quality_classifier.scored(docs, labels).collect()}
    toxic = {r.doc_id: r.score for r in toxicity.scored(docs, labels).collect()}
    assert sum((quality[i] >= 0.7) == (i % 3 != 0) for i in range(200)) >= 195
    assert sum((toxic[i] >= 0.3) == (i % 4 == 0) for i in range(200)) >= 195
    assert toxic[502] > toxic[501] and 0 <= quality[500] <= 1 and quality[500] == quality[501]


def test_segments_are_all_maximal():
    import random

    def plain(scores):
        if not any(s > 0 for s in scores):
            return []
        sums = list(itertools.accumulate(scores, initial=0.0))
        best = max(((sums[j] - sums[i], -(j - i), i, j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)))
        _, _, i, j = best
        return plain_part(scores, 0, i) + [(i, j - 1)] + plain_part(scores, j, len(scores))

    def plain_part(scores, lo, hi):
        return [(a + lo, b + lo) for a, b in plain(scores[lo:hi])]

    pick = random.Random(3)
    for _ in range(300):
        scores = [pick.choice([2.0, 1.25, -0.5, -0.15, -0.15, -0.15, -1.0]) + pick.random() * 1e-3 * 0 for _ in range(pick.randint(1, 25))]
        given = [(i, s) for i, s in enumerate(scores) if s != -0.15]
        assert [x[:2] for x in toxicity.segments(given, -0.15)] == plain(scores)


def test_empty_tables(no_docs, spark):
    import public_tokenizers

    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    frames = [
        near_dedup.near_duplicates(no_docs), near_dedup.deduplicated(no_docs), quality_classifier.scored(no_docs, labels), suffix_dedup.deduplicated_rows(no_docs), toxicity.scored(no_docs, labels),
        window_dedup.deduplicated_rows(no_docs), window_dedup.deduplicated(no_docs), quality_rules.judged(no_docs), quality_rules.cleaned(no_docs), mixing.mix_report(no_docs), mixing.mix_texts(no_docs),
        piece_codec.digests(no_docs, public_tokenizers.path("piece_bpe_32k.model")),
    ]
    assert [f.count() for f in frames] == [0] * len(frames)


def test_chance_law_counts_tokens_as_they_are_used(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    texts = {i: " ".join(rng.choice([f"w{j}" for j in range(50)], 40 if i % 2 else 900)) + (" vile nasty" if i % 3 == 0 or i % 20 == 1 else "") for i in range(600)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    labels = spark.createDataFrame([(i, None, int(i % 3 == 0)) for i in texts], "doc_id long, quality int, toxic int")
    own = toxicity.fitted(docs, labels)
    ids = toxicity.training_ids(labels.select("doc_id", "toxic"), "toxic", toxicity.TRAINING_ROWS).where("y = 0").collect()
    tokens = [t for r in ids for t in toxicity.tokens_of(texts[r.doc_id].encode())]
    assert {b"vile", b"nasty"} <= set(own.scores) and 0 < own.lam < 19
    assert abs(np.mean([np.exp(own.lam * own.scores.get(t, toxicity.DRIFT)) for t in tokens]) - 1) < 1e-6

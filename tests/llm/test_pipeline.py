"""The pipeline's stages in order on odd documents."""

import hashlib
import random
import re
from collections import Counter

import corpus_pipeline
from test_text_operators import in_duckdb

from wattline.llm import checks, quality_rules


def test_stages(edge_docs, no_docs, spark, tmp_path):
    for start, some in ((edge_docs, True), (no_docs, False)):
        docs = start
        for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
            path = str(tmp_path / f"{name}-{some}")
            stage(spark, docs, "unused").write.parquet(path)
            after = spark.read.parquet(path)
            if number < len(corpus_pipeline.STAGES) - 1:
                assert after.columns == docs.columns
            docs = after
        assert (docs.count() > 0) is some


def test_run_reads_documents(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 100 and out.where("NOT agrees").count() == 0


# ---------------------------------------------------------------- every stage against a plain version

def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def corpus(spark):
    """Documents of two sources with lines that many share, copies, near copies, passages of 60 words and texts without words."""
    rng = random.Random(11)
    prose = lambda n: " ".join("w%x" % rng.randrange(1 << 40) for _ in range(n))
    passage, notice = prose(60), "Call 555 0%d now for offers"
    rows = []
    for i in range(40):
        source = "a" if i % 3 else "b"
        lines = [prose(40), notice % i, prose(30)]
        if i % 5 == 0:
            lines.insert(1, passage)
        if i % 7 == 0:
            lines += ["same words again here"] * 3
        rows.append((i, "\n".join(lines), "en", source))
    rows += [(100 + i, rows[i][1], "en", rows[i][3]) for i in range(4)]  # copies
    rows += [(110 + i, rows[20 + i][1].replace(words(rows[20 + i][1])[8], "other", 1), None, "a") for i in range(4)]  # near copies
    rows += [(200, None, "en", "a"), (201, "", "en", "a"), (202, "too short", "en", None), (203, prose(90), "de", None), (None, prose(70), "de", "b"), (204, "x y z " * 60, "en", "a")]
    return spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(6)


def texts(rows):
    return Counter((r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in rows)


def plain_quality(rows):
    def key(line):
        return re.sub(r"[\x20\x09-\x0D]+", " ", re.sub("[0-9]", "0", line.lower())).strip()

    def countable(line):
        return 0 < len(words(line)) <= quality_rules.MAX_LINE_WORDS

    holders = {}
    for r in rows:
        for line in (r["text"] or "").split("\n"):
            if countable(line):
                holders.setdefault((r["source"], key(line)), set()).add(r["text"])
    often = {k for k, own in holders.items() if len(own) > quality_rules.MAX_DOCUMENTS}
    out = Counter()
    for r in rows:
        w, lines = words(r["text"]), (r["text"] or "").split("\n")
        grams = Counter(zip(w, w[1:], w[2:]))
        again = {p for i in range(len(w) - 2) if grams[w[i], w[i + 1], w[i + 2]] > 1 for p in (i, i + 1, i + 2)}
        left = [x for x in lines if not (countable(x) and (r["source"], key(x)) in often)]
        removed = len(w) - sum(len(words(x)) for x in left)
        if len(w) < 50 or 100 * len(again) > 50 * len(w) or len(w) - removed < quality_rules.MIN_KEPT * len(w):
            continue
        text = "\n".join(left)
        out[(r["doc_id"], text, r["lang"], r["source"], len(text))] += 1
    return out


def plain_near_copies(rows):
    def shingles(text):
        w = [x.lower() for x in words(text)]
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, group = [shingles(r["text"]) for r in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                group = [group[j] if g == group[i] else g for g in group]
    out = Counter()
    for i, r in enumerate(rows):
        ids = [x["doc_id"] for x, g in zip(rows, group) if g == group[i] and x["doc_id"] is not None]
        if not ids or not sets[i] or r["doc_id"] == min(ids):
            out.update(texts([r]))
    return out


def plain_passages(rows, size=50):
    first = {}
    for r in rows:
        w = words(r["text"])
        for i in range(len(w) - size + 1):
            window = tuple(w[i : i + size])
            if r["doc_id"] is not None:
                first[window] = min(first.get(window, r["doc_id"]), r["doc_id"])
    out = Counter()
    for r in rows:
        w, gone = words(r["text"]), set()
        for i in range(len(w) - size + 1):
            if r["doc_id"] is not None and first[tuple(w[i : i + size])] < r["doc_id"]:
                gone.update(range(i, i + size))
        text = " ".join(x for i, x in enumerate(w) if i not in gone) if gone else r["text"]
        if text or not gone:
            out[(r["doc_id"], text, r["lang"], r["source"], len(text or ""))] += 1
    return out


def check_mix(spark, before, after):
    """Words taken per document are those of the mix's SQL; every text is words of its document in their order."""
    columns, rows = in_duckdb(before, checks.mixing())
    taken = Counter()
    for r in (dict(zip(columns, x)) for x in rows):
        taken[r["doc_id"]] += r["taken"]
    got, own = Counter(), {}
    for r in before.collect():
        own.setdefault(r["doc_id"], []).append(words(r["text"]))
    for r in after.collect():
        mine = words(r["text"])
        got[r["doc_id"]] += len(mine)

        def inside(w):
            rest = iter(w)
            return all(x in rest for x in mine)

        assert any(inside(w) for w in own[r["doc_id"]])
    assert +got == +taken


def test_every_stage_equals_its_plain_version(spark, tmp_path):
    import public_tokenizers
    import sentencepiece

    frames = [corpus(spark)]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, frames[-1], "unused").write.parquet(path)
        frames.append(spark.read.parquet(path))
    rows = [f.collect() for f in frames]
    plain = [plain_quality, plain_near_copies, plain_passages]
    for number, version in enumerate(plain):
        assert texts(rows[number + 1]) == version(rows[number]), corpus_pipeline.STAGES[number][0]
        assert sum(version(rows[number]).values()) < len(rows[number]) or number == 2
    assert texts(rows[3]) != texts(rows[2])  # passages went
    check_mix(spark, frames[3], frames[4])
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    wanted = Counter()
    for r in rows[4]:
        ids = library.encode(r["text"] or "")
        wanted[(r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows[5]) == wanted

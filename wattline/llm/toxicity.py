"""Toxicity by maximum-scoring segments over token log-odds.

Tokens get the log-odds of being in toxic against other labelled documents under an informative Dirichlet prior (the token's share of
all labelled documents); those that differ clearly, by their z value, keep their log-odds as score, every other token a small negative
one. One linear scan per text finds all maximal-scoring segments. Under chance, a best segment's score has an extreme-value law: with
``lam`` solving E[exp(lam * score)] = 1 over tokens of other documents, a segment of score S in n tokens has the expected count
n * exp(-lam * S). Segments whose expected count is below ``EXPECTED`` are toxic passages. A logistic fit over the best segment and the
sum of all significant ones gives a probability. It is fitted on at most ``TRAINING_ROWS`` labelled documents, which with the least z bounds the
token scores too; every document is scored. Chance is that of the tokens as often as they are used in those documents.

Defined cases: a null or empty text has no segments and the score of such texts; equal texts have equal scores; with no labels of a class
all scores are 0; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wattline.llm.labelled import held_out, logistic_fit, sigmoid, training_ids

TRAINING_ROWS = 40_000
#: Documents that the prior weighs as many as, as a share of the labelled ones; least log-odds and z of a token that gets a score of its own.
PRIOR = 0.25
LEAST_ODDS = 1.2
LEAST_Z = 3.5
DRIFT = -0.15
EXPECTED = 0.5
#: White space and ASCII punctuation end a token; letters are lower-cased.
_MARKS = bytes(i for i in range(128) if not chr(i).isalnum())
_FOLD = bytes.maketrans(_MARKS, b" " * len(_MARKS))


def tokens_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).lower().split()


def segments(scores: list[tuple[int, float]], drift: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, last, score) of a sequence in which positions that are not listed score ``drift`` < 0.

    The linear scan of Ruzzo and Tompa: each positive run is joined to the nearest earlier candidate that starts lower and ends lower.
    """
    out: list[list[float]] = []  # first, last, total before, total after
    total, at = 0.0, -1
    for i, s in scores:
        total += drift * (i - at - 1)
        before, total, at = total, total + s, i
        if s <= 0:
            continue
        new = [i, i, before, total]
        while True:
            j = len(out) - 1
            while j >= 0 and out[j][2] >= new[2]:
                j -= 1
            if j < 0 or out[j][3] >= new[3]:
                out.append(new)
                break
            new = [out[j][0], new[1], out[j][2], new[3]]
            del out[j:]
    return [(int(a), int(b), d - c) for a, b, c, d in out]


@dataclass
class Detector:
    """Token scores, the extreme-value rate and the logistic scale."""

    scores: dict[bytes, float]
    lam: float
    weights: list[float] = field(default_factory=list)

    def passages(self, tokens: list[bytes]) -> list[tuple[int, int, float]]:
        """(first token, last token, log of 1 / expected count) of the significant segments."""
        if not tokens or self.scores.keys().isdisjoint(tokens):
            return []
        known = [(i, self.scores[t]) for i, t in enumerate(tokens) if t in self.scores]
        n = np.log(len(tokens))
        found = ((a, b, self.lam * s - n) for a, b, s in segments(known, DRIFT))
        return [x for x in found if x[2] > -np.log(EXPECTED)]

    @staticmethod
    def evidence(found: list[tuple[int, int, float]]) -> tuple[float, float, float]:
        best = max((x[2] for x in found), default=0.0)
        return np.log1p(best), np.log1p(sum(x[2] for x in found)), float(len(found) > 0)

    def score(self, evidence: np.ndarray) -> np.ndarray:
        if not self.weights:
            return np.zeros(len(evidence))
        w = np.array(self.weights)
        return sigmoid(evidence @ w[:-1] + w[-1])


def _distinct_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, documents with it that are toxic, that are not, uses in the latter) of a batch; the null token has all uses."""
    for batch in batches:
        counts: dict[bytes | None, list[int]] = {None: [0, 0, 0]}
        for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist()):
            for t, n in Counter(tokens_of(text or b"")).items():
                found = counts.setdefault(t, [0, 0, 0])
                found[1 - y] += 1
                if not y:
                    found[2] += n
                    counts[None][2] += n
        a = np.array(list(counts.values()), dtype=np.int64).reshape(-1, 3)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), type=pa.binary()), *(pa.array(a[:, i]) for i in range(3))], names=["token", "toxic", "other", "uses"])


def _rate(mean_exp, top: float = 20.0) -> float:
    """The positive root of mean_exp(x) = 1."""
    lo, hi = 1e-6, top
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if mean_exp(mid) < 1.0 else (lo, mid)
    return lo


def fitted(docs: DataFrame, labels: DataFrame, bound: int = TRAINING_ROWS) -> Detector:
    ids = training_ids(labels.select("doc_id", "toxic"), "toxic", bound)
    sample = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(ids), "doc_id").select("text", "y")  # at most ``bound`` ids
    sizes = {r.y: r.n for r in ids.groupBy("y").agg(F.count("*").alias("n")).collect()}
    pos, neg = sizes.get(1, 0), sizes.get(0, 0)
    if not pos or not neg:
        return Detector({}, 1.0)
    counts = sample.mapInArrow(_distinct_tokens, "token binary, toxic long, other long, uses long").groupBy("token").agg(F.sum("toxic").alias("a"), F.sum("other").alias("b"), F.sum("uses").alias("uses"))
    # Document counts: a token is present or not, so the odds are those of a document of the class having it.
    share = (F.col("a") + F.col("b")) / float(pos + neg)
    prior = PRIOR * (pos + neg)
    a, b = F.col("a") + prior * share, F.col("b") + prior * share
    odds = F.log(a / F.greatest(F.lit(pos + prior) - a, F.lit(0.5))) - F.log(b / F.greatest(F.lit(neg + prior) - b, F.lit(0.5)))
    z = odds / F.sqrt(1 / a + 1 / b)
    clear = (F.abs("z") >= LEAST_Z) & (F.abs("odds") >= LEAST_ODDS)
    found = counts.select("token", "uses", odds.alias("odds"), z.alias("z")).where(F.col("token").isNull() | clear).select("token", "uses", "odds").collect()
    uses = max(1, sum(r.uses for r in found if r.token is None))
    rows = sorted((bytes(r.token), float(r.odds), r.uses) for r in found if r.token is not None)
    scores = {t: odds for t, odds, _ in rows}
    p, s = np.array([n / uses for *_, n in rows]), np.array([odds for _, odds, _ in rows])
    rest = max(0.0, 1.0 - p.sum())
    lam = _rate(lambda x: float((p * np.exp(np.minimum(x * s, 500.0))).sum() + rest * np.exp(x * DRIFT)))
    own = Detector(scores, lam)

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            e = [own.evidence(own.passages(tokens_of(t or b""))) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(e, type=pa.list_(pa.float64())), batch.column("y")], names=["e", "y"])

    rows = sample.mapInArrow(evidence, "e array<double>, y int").groupBy("e", "y").agg(F.count("*").alias("n")).limit(2 * bound).toPandas()
    e, y, n = np.array(rows["e"].tolist()).reshape(-1, 3), rows["y"].to_numpy(), rows["n"].to_numpy()
    own.weights = logistic_fit(np.repeat(e, n, axis=0), np.repeat(y, n)).tolist()
    return own


def scored(docs: DataFrame, labels: DataFrame, bound: int = TRAINING_ROWS) -> DataFrame:
    """(doc_id, held_out, score, passages) of every document; passages are (first token, last token, evidence)."""
    own = fitted(docs, labels, bound)
    kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("evidence", pa.float64())]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            passages = [own.passages(tokens_of(t or b"")) for t in batch.column("text").to_pylist()]
            found = [[{"first": a, "last": b, "evidence": float(x)} for a, b, x in p] for p in passages]
            e = np.array([own.evidence(p) for p in passages]).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(own.score(e)), pa.array(found, type=kind)], names=["doc_id", "score", "passages"])

    id_kind = dict(docs.dtypes)["doc_id"]
    out = docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(score, f"doc_id {id_kind}, score double, passages array<struct<first:int,last:int,evidence:double>>")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "passages")

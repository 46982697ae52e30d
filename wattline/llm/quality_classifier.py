"""Quality by regularised quadratic discriminant analysis over transformed document statistics.

Every text becomes a vector of log ratios (length, word length, capitals, symbols, repeats ...). Each class has a mean and a covariance
shrunk towards the pooled one and towards its diagonal; its Cholesky factor is computed once, and a score is the difference of the two
Gaussian log densities, put on the scale of probabilities by a logistic fit. The classifier is fitted on at most ``TRAINING_ROWS``
labelled documents; every document is scored.

Defined cases: a null text is an empty one; an empty text has the statistics of zero counts and a score like any other; equal texts have
equal scores; with fewer than two rows of a class all scores are 0.5; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wattline.llm.common import stored
from wattline.llm.labelled import held_out, logistic_fit, sigmoid, training_ids

TRAINING_ROWS = 50_000
POOLED = 0.1
DIAGONAL = 0.05
_KINDS = {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "symbol": b"#*$%&|<>{}[]\\~^_=+@", "stop": b".?;:", "comma": b",", "cry": b"!", "line": b"\n", "other": range(128, 256)}
_MASKS = np.array([[1.0 if i in set(v) else 0.0 for v in _KINDS.values()] for i in range(256)])


def statistics(text: bytes) -> list[float]:
    """Transformed statistics of one text."""
    upper, lower, digit, symbol, stop, comma, cry, line, other = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _MASKS
    words = text.split()
    n, letters = len(words), upper + lower + other
    lines = [x for x in text.split(b"\n") if x.strip()]
    pairs = len(set(zip(words, words[1:])))
    log = np.log
    return [
        log(n + 1.0), log((letters + 1.0) / (n + 1.0)), log((upper + 0.5) / (lower + other + 1.0)), log((digit + 0.5) / (n + 1.0)), log((symbol + 0.5) / (n + 1.0)),
        log((stop + 0.5) / (n + 1.0)), log((comma + 0.5) / (n + 1.0)), log((cry + 0.5) / (n + 1.0)), log((line + 1.0) / (n + 1.0)),
        log((len(set(words)) + 1.0) / (n + 1.0)), log((pairs + 1.0) / (n + 1.0)), log((len(set(lines)) + 1.0) / (len(lines) + 1.0)),
        log((sum(len(w) <= 3 for w in words) + 0.5) / (n + 1.0)), log((max(map(len, words), default=0) + 1.0)),
    ]


def _stat_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [statistics(t or b"") for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, type=pa.list_(pa.float64()))], names=["doc_id", "stats"])


def document_statistics(docs: DataFrame) -> DataFrame:
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(_stat_rows, f"doc_id {kind}, stats array<double>")


@dataclass
class Discriminant:
    """Two Gaussian classes with cached Cholesky factors, and the logistic scale of their difference."""

    means: list[np.ndarray]
    factors: list[np.ndarray]
    offsets: list[float]
    centre: np.ndarray
    spread: np.ndarray
    slope: float = 1.0
    intercept: float = 0.0

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, pooled: float = POOLED, diagonal: float = DIAGONAL) -> Discriminant | None:
        if min((y == 0).sum(), (y == 1).sum()) < 2:
            return None
        centre, spread = x.mean(0), x.std(0) + 1e-6
        z = (x - centre) / spread
        parts = [z[y == c] for c in (0, 1)]
        covs = [np.cov(p, rowvar=False, bias=True) for p in parts]
        common = sum(len(p) * c for p, c in zip(parts, covs)) / len(z)
        factors, offsets = [], []
        for c in covs:
            c = (1 - pooled) * c + pooled * common
            c = (1 - diagonal) * c + diagonal * np.diag(np.diag(c)) + 1e-4 * np.eye(len(c))
            factor = np.linalg.cholesky(c)
            factors.append(factor)
            offsets.append(-np.log(np.diag(factor)).sum())
        own = cls([p.mean(0) for p in parts], factors, offsets, centre, spread)
        w = logistic_fit(own.difference(x)[:, None], y)
        own.slope, own.intercept = float(w[0]), float(w[1])
        return own

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 minus that of class 0, from Mahalanobis distances, damped where it is large."""
        z = (x - self.centre) / self.spread
        logs = []
        for mean, factor, offset in zip(self.means, self.factors, self.offsets):
            white = np.linalg.solve(factor, (z - mean).T)
            logs.append(offset - 0.5 * (white * white).sum(0))
        d = logs[1] - logs[0]
        return np.sign(d) * np.log1p(np.abs(d))

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * self.difference(x) + self.intercept)


def fitted(stats: DataFrame, labels: DataFrame, bound: int = TRAINING_ROWS) -> Discriminant | None:
    ids = training_ids(labels.select("doc_id", "quality"), "quality", bound)
    rows = stats.join(F.broadcast(ids), "doc_id").select("stats", "y").limit(2 * bound).toPandas()  # ids are at most ``bound`` rows
    if not len(rows):
        return None
    return Discriminant.fit(np.array(rows["stats"].tolist(), dtype=float), rows["y"].to_numpy())


def scored(docs: DataFrame, labels: DataFrame, bound: int = TRAINING_ROWS) -> DataFrame:
    """(doc_id, held_out, score) of every document."""
    stats = stored(document_statistics(docs), "doc-statistics")
    model = fitted(stats, labels, bound)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.array(batch.column("stats").to_pylist(), dtype=float)
            s = model.score(x) if model else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s)], names=["doc_id", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    return stats.mapInArrow(score, f"doc_id {kind}, score double").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score")

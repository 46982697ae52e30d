"""Nearest neighbours from randomly rotated one-bit codes.

A vector minus its nearest centroid is rotated by a seeded random matrix and kept as one sign bit per dimension, with two scalars: its
length and its inner product with its own code. A query is rotated too and cut into bit planes, so that its inner product with a code is
a few population counts of packed words. The scalars turn this into an unbiased estimate of the true inner product with a known error
bound. Only vectors whose lower bound of the distance does not exceed the best exact distances found so far are reranked in double
precision on the original vectors.

All queries meet all rows in blocks: vectors are packed into blocks of ``ROWS`` where they are read and dealt to shards, and blocks of
``QUERIES`` queries are sent to every shard; each block hands on its nearest few, which are merged per query. The centroids are fitted on
at most ``SAMPLE`` vectors; every vector is indexed.

Defined cases: null, empty, zero or non-finite vectors take no part; vectors of another length than the query's are no candidates; rows
with equal ids are the same vector for a query of that id; ties go to the smaller id; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from wattline.llm.common import stored

ROWS = 8192
QUERIES = 128
SAMPLE = 8192
CENTROIDS = 4
PLANES = 8
#: Standard errors that a bound allows for.
ERRORS = 3.5


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


@lru_cache(maxsize=8)
def rotation(size: int) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng(size).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def fit_centroids(sample: np.ndarray, count: int = CENTROIDS, rounds: int = 12) -> np.ndarray:
    """Lloyd's rounds from rows picked by seed."""
    count = min(count, len(sample))
    centres = sample[np.random.default_rng(5).choice(len(sample), count, replace=False)].astype(np.float64)
    for _ in range(rounds):
        nearest = ((centres**2).sum(1) - 2 * sample @ centres.T).argmin(1)
        for k in range(count):
            if (nearest == k).any():
                centres[k] = sample[nearest == k].mean(0)
    return centres


def packed_signs(rotated: np.ndarray) -> np.ndarray:
    bits = np.packbits(rotated > 0, axis=1)
    return np.ascontiguousarray(np.pad(bits, ((0, 0), (0, -bits.shape[1] % 8)))).view(np.uint64)


def encode(vectors: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed codes, residual lengths and inner products of the unit residuals with their codes."""
    size = vectors.shape[1]
    rotated = (vectors - centre) @ rotation(size).T
    length = np.linalg.norm(rotated, axis=1)
    own = np.abs(rotated).sum(1) / np.sqrt(size) / np.maximum(length, 1e-30)
    return packed_signs(rotated), length, np.where(length > 0, own, 1.0)


def estimates(codes: np.ndarray, length: np.ndarray, own: np.ndarray, query: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(estimated, lower bound) of the squared distances of one query to the coded vectors."""
    size = len(query)
    rotated = rotation(size) @ (query - centre)
    q_length = np.linalg.norm(rotated)
    if q_length == 0:
        return length**2, length**2
    unit = rotated / q_length
    low, step = unit.min(), max((unit.max() - unit.min()) / (2**PLANES - 1), 1e-12)
    levels = np.rint((unit - low) / step).astype(np.int64)
    ones = np.bitwise_count(codes).sum(1, dtype=np.int64)
    dot = np.zeros(len(codes), np.int64)
    for p in range(PLANES):
        plane = packed_signs(((levels >> p) & 1)[None, :])
        dot += np.bitwise_count(codes & plane).sum(1, dtype=np.int64) << p
    # The code of a vector is (2 * bit - 1) / sqrt(size) in each dimension.
    with_code = (2 * (step * dot + low * ones) - (step * levels + low).sum()) / np.sqrt(size)
    cosine = with_code / own
    error = ERRORS * np.sqrt(np.maximum(1 - own**2, 0) / own**2 / max(size - 1, 1)) + step / 2 * np.sqrt(size) / own
    base = length**2 + q_length**2
    return base - 2 * length * q_length * np.clip(cosine, -1, 1), base - 2 * length * q_length * np.clip(cosine + error, -1, 1)


def nearest(ids: np.ndarray, vectors: np.ndarray, coded: tuple, centre: np.ndarray, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, distances) of the ``k`` nearest rows of a block: some by estimate first, then all that the bounds leave in."""
    guess, least = estimates(*coded, query, centre)
    other = ids != query_id
    if not other.any():
        return ids[:0], guess[:0]
    guess, least = np.where(other, guess, np.inf), np.where(other, least, np.inf)
    exact = np.full(len(ids), np.inf)

    def rerank(at):
        exact[at] = np.sqrt(((vectors[at] - query) ** 2).sum(1))

    some = np.argpartition(guess, min(2 * k, len(guess) - 1))[: 2 * k]
    rerank(some[other[some]])
    limit = np.sort(exact)[min(k, len(exact)) - 1]
    more = np.flatnonzero((least <= limit**2 * (1 + 1e-9) + 1e-12) & np.isinf(exact) & other) if np.isfinite(limit) else np.flatnonzero(np.isinf(exact) & other)
    rerank(more)
    best = np.lexsort((ids, exact))[:k]
    best = best[np.isfinite(exact[best])]
    return ids[best], exact[best]


def _packed(ids: np.ndarray, vectors: np.ndarray) -> tuple[bytes, bytes, int]:
    return ids.tobytes(), np.ascontiguousarray(vectors).tobytes(), vectors.shape[1]


def _pack(rows: int, shards: int, every: bool):
    """Pack the vectors of a task into blocks of one length; ``every``: a copy of each block for every shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}
        made = [0]

        def block(size: int) -> pa.RecordBatch:
            ids, vectors = held.pop(size)
            a = np.array(ids, np.int64)
            one = [a.tobytes(), np.array(vectors, np.float64).tobytes(), size]
            made[0] += 1
            to = range(shards) if every else [int(a[0] * 2654435761 + made[0]) % shards]
            columns = [pa.array(list(to), pa.int32())] + [pa.array([x] * len(to), kind) for x, kind in zip(one, (pa.binary(), pa.binary(), pa.int32()))]
            return pa.RecordBatch.from_arrays(columns, names=["shard", "ids", "vectors", "size"])

        for batch in batches:
            for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("embedding").to_pylist()):
                ids, vectors = held.setdefault(len(v), ([], []))
                ids.append(i)
                vectors.append(v)
                if len(ids) == rows:
                    yield block(len(v))
        for size in list(held):
            yield block(size)

    return run


def search(embeddings: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` nearest other vectors of each query row."""
    rows = embeddings.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    count = rows.count()
    shards = int(np.ceil(np.sqrt(count) / 8)) or 1
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toPandas()["embedding"]
    by_size: dict[int, list] = {}
    for v in sample:
        by_size.setdefault(len(v), []).append(v)
    centres = {size: fit_centroids(np.array(v, np.float64)) for size, v in by_size.items()}
    kinds = "shard int, ids binary, vectors binary, size int"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, parts = None, []
        for batch in batches:
            for row in range(batch.num_rows):
                size, raw = batch.column("size")[row].as_py(), batch.column("ids")[row].as_py()
                if raw != current:  # the pairs of one data block follow each other
                    current = raw
                    ids = np.frombuffer(raw, np.int64)
                    vectors = np.frombuffer(batch.column("vectors")[row].as_py(), np.float64).reshape(-1, size)
                    own = centres.get(size, np.zeros((1, size)))
                    near = ((own**2).sum(1) - 2 * vectors @ own.T).argmin(1)
                    parts = []
                    for c in np.unique(near):
                        at = np.flatnonzero(near == c)
                        parts.append((ids[at], vectors[at], encode(vectors[at], own[c]), own[c]))
                q_ids = np.frombuffer(batch.column("q_ids")[row].as_py(), np.int64)
                q_vectors = np.frombuffer(batch.column("q_vectors")[row].as_py(), np.float64).reshape(-1, size)
                out = ([], [], [])
                for q, v in zip(q_ids, q_vectors):
                    found = [nearest(*p, int(q), v, k) for p in parts]
                    near_ids, far = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
                    best = np.lexsort((near_ids, far))[:k]
                    out[0].append(np.full(len(best), q))
                    out[1].append(near_ids[best])
                    out[2].append(far[best])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["query_id", "vec_id", "score"])

    data = stored(rows.mapInArrow(_pack(ROWS, shards, False), kinds), "vector-blocks")
    queries = rows.where(is_query).mapInArrow(_pack(QUERIES, shards, True), kinds)
    queries = stored(queries.select("shard", "size", F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors")), "query-blocks")
    pairs = data.repartition(shards, "shard").join(queries.repartition(shards, "shard").hint("shuffle_hash"), ["shard", "size"])
    found = pairs.select("ids", "vectors", "size", "q_ids", "q_vectors").mapInArrow(scan, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

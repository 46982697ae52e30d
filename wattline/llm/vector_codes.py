"""Vectors as short codes: one byte a part, from integer codebooks.

A component x becomes the integer floor(4096 x). Vectors are cut into equal parts, and each part position has a codebook of at most 16
entries that a few rounds of exact integer averaging move. Vectors are packed once into blocks; a block has a dictionary of the distinct
integers of each dimension and stores its components as positions in it. A round tabulates, for each dimension, the squared differences
of every integer of the dictionary to all entries; the distance of a part is then a gather from each of its dimensions' tables and a
sum. Integers in a dictionary are far fewer than components, so squares are taken once per integer and not once per vector.

Every round is one job over the blocks. A task adds up its own blocks first, so that what is merged is bounded by the codebook's size,
however many rows there are; the driver holds the codebooks and nothing else.

Defined cases: a null vector, or one with a null or non-finite component, is dropped; zero and empty vectors stay. Vectors shorter than
the longest, and a longest one whose length isn't a multiple of the parts, count as followed by zeros. With fewer rows than entries the
codebooks have that many entries. Rows with equal ids are different rows, by vector in the starting codebooks; null ids come last there.
Components beyond 16,384 in size would overflow the exact sums and raise an error. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from wattline.llm.common import stored

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
#: Vectors of a block; positions in its dictionaries fit 16 bits.
ROWS = 8192
#: Integers of this size and above are refused.
LARGEST = 1 << 26


def whole(vector: Column) -> Column:
    """True for a vector of finite components, none of them null."""
    fine = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(fine, F.lit(False))


def integers(vectors: list, width: int) -> np.ndarray:
    """floor(4096 x) of every component, with zeros up to ``width``."""
    out = np.zeros((len(vectors), width))
    for row, v in zip(out, vectors):
        row[: len(v)] = v
    out = np.floor(out * SCALE)
    if out.size and np.abs(out).max() >= LARGEST:
        raise ValueError(f"components of {LARGEST // SCALE} and more are not supported")
    return out.astype(np.int64)


def _packer(width: int, ids: pa.DataType, labels: pa.DataType):
    """Blocks of a task's vectors, each with its dictionaries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0

        def block(rows: pa.Table) -> pa.RecordBatch:
            values = integers(rows.column("embedding").to_pylist(), width)
            dictionaries, codes = [], np.empty((width, len(values)), np.uint16)
            for d in range(width):
                known, at = np.unique(values[:, d], return_inverse=True)
                dictionaries.append(known)
                codes[d] = at
            one = [
                pa.array([rows.column("vec_id").to_pylist()], pa.list_(ids)), pa.array([rows.column("label").to_pylist()], pa.list_(labels)),
                pa.array([[len(d) for d in dictionaries]], pa.list_(pa.int32())), pa.array([np.concatenate([*dictionaries, np.zeros(0, np.int64)]).tobytes()], pa.binary()), pa.array([codes.tobytes()], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(one, names=["vec_ids", "labels", "sizes", "dictionary", "codes"])

        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count >= ROWS:
                rows = pa.Table.from_batches(held)
                full = count - count % ROWS
                for at in range(0, full, ROWS):
                    yield block(rows.slice(at, ROWS))
                held, count = rows.slice(full).to_batches(), count - full
        if count:
            yield block(pa.Table.from_batches(held))

    return run


class Block:
    """Dictionary codes of some vectors."""

    def __init__(self, batch: pa.RecordBatch, row: int, width: int):
        sizes = batch.column("sizes")[row].as_py()
        self.dictionaries = np.split(np.frombuffer(batch.column("dictionary")[row].as_py(), np.int64), np.cumsum(sizes)[:-1]) if width else []
        self.codes = np.frombuffer(batch.column("codes")[row].as_py(), np.uint16).reshape(width, -1) if width else np.zeros((0, len(batch.column("vec_ids")[row])), np.uint16)

    def nearest(self, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) by part and vector. ``books``: parts, entries, positions."""
        parts, entries, size = books.shape
        at, far = np.empty((parts, self.codes.shape[1]), np.int64), np.empty((parts, self.codes.shape[1]), np.int64)
        for p in range(parts):
            total = np.zeros((self.codes.shape[1], entries), np.int64)
            for j in range(size):
                d = p * size + j
                table = (self.dictionaries[d][:, None] - books[p, :, j][None, :]) ** 2
                total += table[self.codes[d]]
            at[p] = total.argmin(1)  # the first of equals
            far[p] = total.min(1)
        return at, far

    def sums(self, at: np.ndarray, books: np.ndarray) -> np.ndarray:
        """By part and entry: the sums of its components, then their count."""
        parts, entries, size = books.shape
        out = np.zeros((parts, entries, size + 1), np.int64)
        for p in range(parts):
            for j in range(size):
                d = p * size + j
                # Uses of each integer by entry, times the integer.
                n = len(self.dictionaries[d])
                uses = np.bincount(at[p] * n + self.codes[d], minlength=entries * n).reshape(entries, n)
                out[p, :, j] = uses @ self.dictionaries[d]
            out[p, :, size] = np.bincount(at[p], minlength=entries)
        return out


def _adder(books: np.ndarray, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for row in range(batch.num_rows):
                block = Block(batch, row, width)
                own = block.sums(block.nearest(books)[0], books)
                total = own if total is None else total + own
        if total is not None:
            flat = total.ravel()
            used = np.flatnonzero(flat)
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(flat[used], pa.int64())], names=["at", "total"])

    return run


def _coder(books: np.ndarray, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                at, far = Block(batch, row, width).nearest(books)
                codes = [bytes(c).hex() for c in at.T.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([batch.column("vec_ids")[row].values, batch.column("labels")[row].values, pa.array(codes, pa.string()), pa.array(far.sum(0), pa.int64())], names=["vec_id", "label", "code", "error"])

    return run


def fit(blocks: DataFrame, books: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks after ``rounds`` rounds: entries become the floored means of their parts, unused entries stay."""
    parts, entries, size = books.shape
    for _ in range(rounds):
        rows = blocks.mapInArrow(_adder(books, parts * size), "at long, total long").groupBy("at").agg(F.sum("total").alias("total")).collect()
        total = np.zeros(parts * entries * (size + 1), np.int64)
        for r in rows:
            total[r["at"]] = r["total"]
        total = total.reshape(parts, entries, size + 1)
        count = total[:, :, size:]
        books = np.where(count > 0, total[:, :, :size] // np.maximum(count, 1), books)
    return books


def compressed(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every whole vector."""
    kinds = dict(embeddings.dtypes)
    rows = embeddings.select("vec_id", "label", "embedding").where(whole(F.col("embedding")))
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).select("embedding").toPandas()["embedding"]
    longest = rows.agg(F.max(F.size("embedding"))).first()[0] or 0
    size = -(-longest // parts)
    width = parts * size
    arrow = {f.name: f.type for f in embeddings.select("vec_id", "label").limit(0).toArrow().schema}
    packed = rows.mapInArrow(_packer(width, arrow["vec_id"], arrow["label"]), f"vec_ids array<{kinds['vec_id']}>, labels array<{kinds['label']}>, sizes array<int>, dictionary binary, codes binary")
    blocks = stored(packed, "vector-blocks")
    start = integers(list(first), width).reshape(len(first), parts, size).transpose(1, 0, 2)
    books = fit(blocks, start, rounds) if len(first) else start
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    coded = stored(blocks.mapInArrow(_coder(books, width), f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"), "vector-codes")
    by_label = coded.groupBy(F.col("label").alias("same")).agg(F.sum("error").alias("label_error"))
    out = coded.join(by_label, F.col("label").eqNullSafe(F.col("same")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))

"""Near-duplicate documents: banded MinHash, odd sketches for candidates, exact links on full shingle sets, components.

Texts with equal shingle sets are one node. A node has ``SAMPLES`` MinHash values; runs of ``ROWS`` of them are its band keys, and all of
them are folded into an odd sketch, a bitmap in which every value flips one bit. The number of ones in the XOR of two sketches estimates
the similarity closely near 1; pairs that share a band and are estimated above ``LEAST_ESTIMATE`` are compared on their full sets.

Groups are never paired off whole. In a first pass every node of a band bucket is compared only with a few centres, one per bucket, and
links are joined to components. Only buckets in which nodes of different components still meet are compared further, in blocks of
``BLOCK`` nodes by ``BLOCK``, without pairs of one component and each pair in the first band that it shares. So a large group of copies
costs its size once, and the rest is exact. A link of similarity 0.85 is missed by all bands with a chance below 3e-8.

Defined cases: a null, empty or blank text has no shingles and is linked with nothing; a text of fewer than five words has one; repeated
rows are copies of each other (all rows with the smallest id are kept); a row without id takes the smallest id of its component, and is
kept only where that has none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from wattline.llm.common import stored
from wattline.llm.components import components

SHINGLE = 5
SAMPLES = 192
ROWS = 4
BANDS = 24
BITS = 1024
LEAST_ESTIMATE = 0.73
BLOCK = 256
#: A link: at least this share of the union, in hundredths.
PERCENT = 85
WORDS_KNOWN = 500_000

_RANDOM = np.random.default_rng(20)
_WORD_FACTORS = _RANDOM.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) | np.uint64(1)
_SAMPLE_FACTORS = _RANDOM.integers(1, 1 << 31, SAMPLES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_BAND_FACTORS = _RANDOM.integers(1, 1 << 63, ROWS, dtype=np.uint64) | np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class _Words(dict):
    """64-bit hashes of words; forgets all when it holds too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KNOWN:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_WORDS = _Words()


def word_hashes(text: bytes) -> np.ndarray:
    words = text.lower().split()
    return np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))


def shingle_set(text: bytes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text; bytes.lower and bytes.split fold and cut ASCII only."""
    h = word_hashes(text)
    n = len(h)
    if not n:
        return h
    width = min(SHINGLE, n)
    total = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        total = mixed(total * _WORD_FACTORS[0] + h[k : n - width + 1 + k] * _WORD_FACTORS[k])
    return np.unique(total)


def samples(shingles: np.ndarray) -> np.ndarray:
    """MinHash values, in steps that keep the table of products small."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 1024):
        np.minimum(out, (x[at : at + 1024, None] * _SAMPLE_FACTORS).min(0), out=out)
    return out


def band_keys(values: np.ndarray) -> np.ndarray:
    grouped = values[: BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        key = mixed(key * _BAND_FACTORS[0] + grouped[:, k] * _BAND_FACTORS[k] + np.uint64(k))
    return key.view(np.int64)


def odd_sketch(values: np.ndarray) -> bytes:
    """Each (place, value) flips one of ``BITS`` bits."""
    at = mixed(values.astype(np.uint64) + (np.arange(SAMPLES, dtype=np.uint64) << np.uint64(32))) % np.uint64(BITS)
    return np.packbits(np.bincount(at.astype(np.int64), minlength=BITS) & 1).tobytes()


def estimated(ones: np.ndarray) -> np.ndarray:
    """Similarity from the number of ones in the XOR of two sketches."""
    share = np.minimum(2.0 * ones / BITS, 0.999)
    return 1.0 + BITS / (4.0 * SAMPLES) * np.log1p(-share)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, keys, bands, sketches = [], [], [], []
        for text in batch.column("text").to_pylist():
            s = shingle_set(text or b"")
            sizes.append(len(s))
            if len(s):
                values = samples(s)
                keys.append(int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).view(np.int64)))
                bands.append(band_keys(values))
                sketches.append(odd_sketch(values))
            else:
                keys.append(None)
                bands.append(None)
                sketches.append(None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_key"), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.binary())],
            names=["doc_id", "text_key", "n", "node", "bands", "sketch"],
        )


def signed(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, n, node, bands, sketch); node is the hash of the whole shingle set."""
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(_signed, f"doc_id {kind}, text_key long, n long, node long, bands array<long>, sketch binary")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingle_set(t or b"").tobytes() for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.binary())], names=["node", "shingles"])


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sets share enough of their union."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= PERCENT * (len(x) + len(y) - both)


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = [similar(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)) for a, b in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))


def links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) whose full sets are similar enough."""
    a = sets.select(F.col("node").alias("u"), F.col("shingles").alias("sa"))
    b = sets.select(F.col("node").alias("v"), F.col("shingles").alias("sb"))
    return pairs.join(a, "u").join(b, "v").select("u", "v", "sa", "sb").mapInArrow(_linked, "u long, v long")


def _ones(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1)


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (u, v) whose sketches are close."""
    for batch in batches:
        if batch.num_rows:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for c in ("ka", "kb"))
            near = estimated(_ones(a, b)) >= LEAST_ESTIMATE
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], names=["u", "v"]).filter(pa.array(near))


def _block_links(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components that links of a block cell join. Rows arrive sorted by cell; a cell holds two blocks at most.

    Components that an earlier link of the cell has joined are one from then on, so a cell names fewer joins than it has rows.
    """
    held: list[pa.RecordBatch] = []

    def cell_links(rows: pa.Table) -> pa.RecordBatch | None:
        comp, side, band = (rows[c].to_numpy() for c in ("component", "side", "band"))
        n = len(comp)
        if n < 2 or (comp == comp[0]).all():
            return None
        sketch = np.frombuffer(b"".join(rows["sketch"].to_pylist()), np.uint64).reshape(n, -1)
        bands = np.frombuffer(rows["bands"].combine_chunks().flatten().to_numpy().tobytes(), np.int64).reshape(n, BANDS)
        sets = [np.frombuffer(x, np.uint64) for x in rows["shingles"].to_pylist()]
        within = rows["within"][0].as_py()
        now, found = comp.copy(), []
        for i in np.arange(n - 1) if within else np.flatnonzero(side == 0):
            others = np.arange(i + 1, n) if within else np.flatnonzero(side == 1)
            others = others[now[others] != now[i]]
            if not len(others):
                continue
            others = others[estimated(_ones(sketch[others], sketch[i])) >= LEAST_ESTIMATE]
            others = others[(bands[others] == bands[i]).argmax(1) == band[i]]  # a pair belongs to the first band that it shares
            for j in others:
                if now[i] != now[j] and similar(sets[i], sets[j]):
                    found.append((comp[i], comp[j]))
                    now[now == now[j]] = now[i]
        if not found:
            return None
        u, v = np.array(found, np.int64).T
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    def flush() -> Iterator[pa.RecordBatch]:
        if held:
            out = cell_links(pa.Table.from_batches(held))
            held.clear()
            if out is not None and out.num_rows:
                yield out

    current = None
    for batch in frames:
        cells = batch.column("cell").to_numpy()
        if not len(cells):
            continue
        cuts = np.flatnonzero(np.diff(cells)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(cells)]):
            if cells[lo] != current:
                yield from flush()
                current = cells[lo]
            held.append(batch.slice(lo, hi - lo))
    yield from flush()


def block_links(members: DataFrame, nodes: DataFrame, comps: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (u, v) of components between which a bucket holds a link."""
    labelled = members.join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
    labelled = stored(labelled.select("bucket", "band", "node", "component"), "bucket-components")
    # Two nodes of the largest component of a bucket are never compared: its blocks meet only those of the others.
    counts = labelled.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    shape = counts.groupBy("bucket").agg(F.max_by("component", "n").alias("_main"), F.max("n").alias("_m"), F.sum("n").alias("_all")).where("_m < _all")
    few, many = F.ceil((F.col("_all") - F.col("_m")) / BLOCK).cast("int"), F.ceil(F.col("_m") / BLOCK).cast("int")
    rows = labelled.join(stored(shape.select("bucket", "_main", few.alias("_few"), many.alias("_many")), "mixed-buckets"), "bucket")
    main, spread = F.col("component") == F.col("_main"), F.xxhash64("node")
    rows = rows.withColumn("_b", F.when(main, F.col("_few") + F.pmod(spread, F.col("_many"))).otherwise(F.pmod(spread, F.col("_few"))).cast("int"))
    rows = rows.withColumn("_o", F.explode(F.sequence(F.lit(0), F.when(main, F.col("_few")).otherwise(F.col("_few") + F.col("_many")) - 1)))
    lo, hi = F.least("_b", "_o"), F.greatest("_b", "_o")
    rows = rows.select(
        F.xxhash64("bucket", lo, hi).alias("cell"), "band", "node", "component", F.when(F.col("_b") == lo, 0).otherwise(1).alias("side"), (lo == hi).alias("within"),
    )
    rows = rows.join(nodes.select("node", "bands", "sketch"), "node").join(sets, "node").drop("node")
    return rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(_block_links, "u long, v long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, text_key, kept) of every document."""
    rows = stored(signed(docs), "shingle-signatures")
    nodes = rows.where("node IS NOT NULL").groupBy("node").agg(F.min(F.struct("doc_id", "text_key")).alias("one"), F.min("doc_id").alias("least_id"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    nodes = stored(nodes, "shingle-nodes")
    keys = nodes.select("node", F.posexplode("bands").alias("band", "bucket"))
    buckets = keys.groupBy("bucket").agg(F.count("*").alias("size"), F.min_by("node", F.xxhash64("node", "bucket")).alias("centre")).where("size > 1")
    members = stored(keys.join(stored(buckets, "buckets"), "bucket"), "bucket-members")
    wanted = nodes.join(members.select("node").distinct(), "node", "left_semi").select("node", "one.doc_id", "one.text_key")
    texts = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_key"), F.col("text").cast("binary").alias("text"))
    found = texts.join(wanted, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_key") == F.col("text_key"))).select("node", "text")
    sets = stored(found.mapInArrow(_sets, "node long, shingles binary").dropDuplicates(["node"]), "shingle-sets")

    stars = members.where("node <> centre").select(F.least("node", "centre").alias("u"), F.greatest("node", "centre").alias("v")).distinct()
    ka = nodes.select(F.col("node").alias("u"), F.col("sketch").alias("ka"))
    kb = nodes.select(F.col("node").alias("v"), F.col("sketch").alias("kb"))
    close = stored(stars.join(ka, "u").join(kb, "v").select("u", "v", "ka", "kb").mapInArrow(_close, "u long, v long"), "close-stars")
    comps = stored(components(links(close, sets)), "star-components")
    lifted = block_links(members, nodes, comps, sets)
    upper = stored(components(lifted), "upper-components").select(F.col("node").alias("component"), F.col("component").alias("top"))
    final = comps.join(upper, "component", "left").select("node", F.coalesce("top", "component").alias("component"))
    final = final.unionByName(upper.join(comps.select("component").distinct(), "component", "left_anti").select(F.col("component").alias("node"), F.col("top").alias("component")))
    named = nodes.select("node", "least_id").join(final, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = stored(named, "node-components")
    least = stored(named.groupBy("component").agg(F.min("least_id").alias("component_id")), "component-ids")
    ids = stored(named.select("node", "component").join(least, "component").select("node", "component_id"), "node-ids")
    out = rows.select("doc_id", "text_key", "n", "node").join(ids, "node", "left")
    component_id = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), component_id.alias("component_id"), "text_key")
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents that are kept, in the columns of ``docs``; all rows of a kept id and text stay."""
    gone = near_duplicates(docs).where("NOT kept").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    return docs.join(gone, docs.doc_id.eqNullSafe(gone._id) & (F.xxhash64(docs.text) == gone._key), "left_anti")

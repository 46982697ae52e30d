"""Byte strings that occur twice anywhere, found by sorting sparse suffixes.

Every string of ``LENGTH`` bytes has an anchor: the place of its least hash of ``GRAM`` bytes, the same wherever the string occurs. Only
strings whose anchor hash occurs twice can repeat. Their possible starts are cut into units of ``UNIT`` starts, aligned to the anchor, so
that equal strings lie in equally aligned units. For a unit ending at byte t the suffix from t is sorted, followed by the bytes before t
backwards: sampled splitters range-partition the suffixes by their leading bytes (and by place where those are equal, so that no group is
too large for a task), each bucket is sorted by multikey quicksort, and neighbours are compared, also across buckets. What a suffix shares
with its neighbours, forwards and backwards, says for each start of the unit that its string repeats or that it cannot; the few starts
that stay open at the edges of repeats are looked up: their strings are hashed once per distinct unit and counted.

Texts that occur twice are removed whole (if long enough) and take part once. All occurrences of a string are removed, the first too.

Defined cases: a null text is an empty one; a text shorter than ``LENGTH`` keeps all; repeated rows are copies of each other; texts are
taken to be UTF-8 (the byte 0xFF marks ends); other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from wattline.llm import rolling
from wattline.llm.common import likely_among, stored

LENGTH = 400
GRAM = 32
UNIT = 64
CORE = LENGTH - UNIT + 1
KEY = LENGTH + UNIT - 1
#: Bytes of suffixes that a sorting task holds, rows that multikey quicksort leaves to a plain sort, and starts hashed at a time.
BUCKET_BYTES = 12_000_000
PLAIN = 48
STRETCH = 1 << 20

_BEFORE = np.full(UNIT - 1, 255, np.uint8)
_AFTER = np.full(KEY, 255, np.uint8)
#: Offsets into a text padded by _BEFORE: LENGTH bytes from t on, then the bytes before t backwards.
_OFFSETS = np.concatenate([np.arange(UNIT - 1, KEY), np.arange(UNIT - 2, -1, -1)])


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the ``GRAM`` bytes from every byte on."""
    n = len(data)
    eight = np.ndarray(shape=(n - 7,), dtype="<u8", buffer=data, strides=(1,))
    sixteen = rolling.joined(eight[:-8], eight[8:])
    return rolling.joined(sixteen[:-16], sixteen[16:])


def _stretches(data: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(first start, gram hashes) for stretches of possible starts; a stretch has the hashes that its starts need."""
    starts = len(data) - LENGTH + 1
    for at in range(0, starts, STRETCH):
        yield at, gram_hashes(np.ascontiguousarray(data[at : min(at + STRETCH, starts) + LENGTH - 1]))


def anchor_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct anchor hashes of a text and how often they occur."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for at, h in _stretches(data):
        places = rolling.anchors(h, LENGTH - GRAM + 1)
        found.append((places + at, h[places]))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    places, first = np.unique(np.concatenate([p for p, _ in found]), return_index=True)
    return np.unique(np.concatenate([h for _, h in found])[first], return_counts=True)


def anchored_starts(data: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first start, last start) of runs of starts whose leftmost anchor has one of the ``shared`` hashes."""
    out = []
    for at, h in _stretches(data):
        width, have = LENGTH - GRAM + 1, 1
        least, place = h, np.arange(len(h))
        while have < width:
            step = min(have, width - have)
            right = least[step:] < least[: len(least) - step]
            place = np.where(right, place[step:], place[: len(place) - step])
            least = np.where(right, least[step:], least[: len(least) - step])
            have += step
        cuts = np.flatnonzero(np.diff(place)) + 1
        lo, hi = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(place)]]) - 1
        keep = np.isin(least[lo], shared)
        out.append((place[lo][keep] + at, lo[keep] + at, hi[keep] + at))
    return tuple(np.concatenate(x) for x in zip(*out))


def units(data: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(t, first start, last start, key) of the units of a text."""
    anchor, lo, hi = anchored_starts(data, shared)
    first, last = (anchor - hi) // UNIT, (anchor - lo) // UNIT
    n = last - first + 1
    row = np.repeat(np.arange(len(n)), n)
    step = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    t = anchor[row] - UNIT * step
    a, b = np.maximum(lo[row], t - UNIT + 1), np.minimum(hi[row], t)
    # Two anchors can share a unit: one row for it, over the starts of both.
    t, at = np.unique(t, return_inverse=True)
    lowest, highest = np.full(len(t), len(data)), np.full(len(t), -1)
    np.minimum.at(lowest, at, a)
    np.maximum.at(highest, at, b)
    padded = np.concatenate([_BEFORE, data, _AFTER])
    return t, lowest, highest, padded[t[:, None] + _OFFSETS]


def multikey_order(rows: np.ndarray) -> np.ndarray:
    """Order of byte rows by multikey quicksort on eight bytes at a time: smaller, equal (which moves on) and larger than a pivot."""
    n, width = rows.shape
    digits = np.ascontiguousarray(np.pad(rows, ((0, 0), (0, -width % 8)))).view(">u8").astype(np.uint64)
    order, stack = np.arange(n), [(0, n, 0)]
    while stack:
        lo, hi, depth = stack.pop()
        if hi - lo < 2 or depth == digits.shape[1]:
            continue
        part = order[lo:hi]
        if hi - lo <= PLAIN:
            order[lo:hi] = sorted(part.tolist(), key=lambda i: rows[i, 8 * depth :].tobytes())
            continue
        digit = digits[part, depth]
        pivot = np.sort(digit[:: max(1, len(digit) // 15)])[len(digit[:: max(1, len(digit) // 15)]) // 2]
        less, more = digit < pivot, digit > pivot
        small, same, large = part[less], part[~(less | more)], part[more]
        order[lo:hi] = np.concatenate([small, same, large])
        one, two = lo + len(small), lo + len(small) + len(same)
        stack += [(lo, one, depth), (one, two, depth + 1), (two, hi, depth)]
    return order


def common_prefixes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each pair of rows."""
    out = np.empty(len(a), np.int32)
    for at in range(0, len(a), 8192):
        differ = a[at : at + 8192] != b[at : at + 8192]
        out[at : at + 8192] = np.where(differ.any(1), differ.argmax(1), a.shape[1])
    return out


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), KEY)


#: What names a text: two hashes of it. Rows with one name are copies.
_TEXT = ["k1", "k2"]
_TEXT_KIND = "k1 long, k2 int"


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.xxhash64("doc_id").alias("id"), F.xxhash64(text).alias("k1"), F.hash(text).alias("k2"), text.cast("binary").alias("text"))


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, shas, hashes, counts, ends = [], [], [], [], [0]
        for text in batch.column("text").to_pylist():
            h, n = anchor_hashes(np.frombuffer(text, np.uint8))
            sizes.append(len(text))
            shas.append(hashlib.sha256(text).digest())
            hashes.append(h)
            counts.append(n > 1)
            ends.append(ends[-1] + len(h))
        ends = pa.array(ends, pa.int32())
        h = pa.array(np.concatenate(hashes).view(np.int64) if hashes else [], pa.int64())
        n = pa.array(np.concatenate(counts) if counts else [], pa.bool_())
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("doc_id", "id", *_TEXT)), pa.array(sizes, pa.int64()), pa.array(shas, pa.binary()), pa.ListArray.from_arrays(ends, h), pa.ListArray.from_arrays(ends, n)],
            names=["doc_id", "id", *_TEXT, "n_bytes", "sha", "hashes", "again"],
        )


def _unit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            data = np.frombuffer(batch.column("text")[i].as_py(), np.uint8)
            t, a, b, keys = units(data, np.array(batch.column("shared")[i].as_py(), np.int64).view(np.uint64))
            for at in range(0, len(t), 4096):
                part = slice(at, at + 4096)
                n = len(t[part])
                flat = pa.FixedSizeBinaryArray.from_buffers(pa.binary(KEY), n, [None, pa.py_buffer(np.ascontiguousarray(keys[part]))])
                yield pa.RecordBatch.from_arrays(
                    [*(pa.repeat(batch.column(c)[i], n) for c in _TEXT), pa.array(t[part], pa.int64()), pa.array(a[part], pa.int64()), pa.array(b[part], pa.int64()), flat.cast(pa.binary())],
                    names=[*_TEXT, "t", "a", "b", "key"],
                )


def _sorted_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One bucket in order, each row with the prefixes it shares with its neighbours; the outer ones are open."""
    table = pa.Table.from_batches(got) if (got := list(batches)) else None
    if table is None or not table.num_rows:
        return
    keys = _matrix(table["key"].combine_chunks())
    order = multikey_order(keys)
    keys, n = keys[order], len(order)
    right, left = common_prefixes(keys[:-1, :LENGTH], keys[1:, :LENGTH]), common_prefixes(keys[:-1, LENGTH:], keys[1:, LENGTH:])
    place = np.arange(n)
    first, last = place == 0, place == n - 1
    # Keys stay where a lookup may need them: once per distinct key, in groups of one core that do not agree on all bytes forwards. What
    # the outer groups of a bucket hold is not known here.
    group = np.concatenate([[0], np.cumsum(right < CORE)])
    mixed = np.zeros(group[-1] + 1, bool)
    mixed[group[:-1][(right >= CORE) & (right < LENGTH)]] = True
    mixed[[0, -1]] = True
    like_before = np.concatenate([[False], (right == LENGTH) & (left == KEY - LENGTH)])
    keep_key = (mixed[group] & ~like_before) | first | last
    shares = np.maximum(np.concatenate([[0], right]), np.concatenate([right, [0]])) >= CORE
    rows = np.flatnonzero(shares | first | last)
    kept = [keys[i].tobytes() if keep_key[i] else None for i in rows]
    edge = first * 1 + last * 2
    out = table.drop_columns(["key"]).take(pa.array(order[rows]))
    more = {
        "key": pa.array(kept, pa.binary()), "edge": pa.array(edge[rows], pa.int32()), "part": pa.array(np.full(len(rows), TaskContext.get().partitionId(), np.int32)),
        "core": pa.array(np.array([xxhash.xxh3_64_intdigest(keys[i, :CORE].tobytes()) for i in rows], np.uint64).view(np.int64)),
        "ahead": pa.array(np.array([xxhash.xxh3_64_intdigest(keys[i, :LENGTH].tobytes()) for i in rows], np.uint64).view(np.int64)),
        "right_up": pa.array(np.concatenate([[0], right])[rows], pa.int32()), "left_up": pa.array(np.concatenate([[0], left])[rows], pa.int32()),
        "right_down": pa.array(np.concatenate([right, [0]])[rows], pa.int32()), "left_down": pa.array(np.concatenate([left, [0]])[rows], pa.int32()),
    }
    for name, column in more.items():
        out = out.append_column(name, column)
    yield from out.combine_chunks().to_batches(max_chunksize=8192)


_SORTED_KIND = "key binary, edge int, part int, core long, ahead long, right_up int, left_up int, right_down int, left_down int"


def _boundary_prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            a, b = _matrix(batch.column("last")), _matrix(batch.column("first"))
            right, left = common_prefixes(a[:, :LENGTH], b[:, :LENGTH]), common_prefixes(a[:, LENGTH:], b[:, LENGTH:])
            yield pa.RecordBatch.from_arrays([batch.column("upper"), batch.column("lower"), pa.array(right, pa.int32()), pa.array(left, pa.int32())], names=["upper", "lower", "right", "left"])


def _window_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of the strings of a unit that start ``near`` to ``far`` bytes before its end, with the start of each."""
    for batch in batches:
        row, start, hashes = [], [], []
        for i, (key, t, near, far) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("key", "t", "near", "far")))):
            piece = key[LENGTH:][::-1] + key[:LENGTH]
            for o in range(near, far + 1):
                text = piece[UNIT - 1 - o : KEY - o]
                if text[0] != 255 and text[-1] != 255:
                    row.append(i)
                    start.append(t - o)
                    hashes.append(xxhash.xxh3_64_intdigest(text))
        at = pa.array(row, pa.int64())
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in _TEXT), pa.array(start, pa.int64()), pa.array(np.array(hashes, np.uint64).view(np.int64))], names=[*_TEXT, "start", "h"])


def sorted_suffixes(rows: DataFrame) -> DataFrame:
    """Units that share a core with another, with the bytes shared forwards (right) and backwards (left) with both neighbours."""
    buckets = int(rows.agg(F.count("*")).first()[0] * KEY // BUCKET_BYTES) + 1
    kinds = ", ".join(f"{c} {t}" for c, t in rows.drop("key").dtypes)
    ranged = rows.repartitionByRange(buckets, "key", "t", *_TEXT)
    done = stored(ranged.mapInArrow(_sorted_bucket, f"{kinds}, {_SORTED_KIND}"), "sorted-suffixes")
    ends = done.where("edge > 0").groupBy("part").agg(F.max(F.when(F.col("edge") % 2 == 1, F.col("key"))).alias("first"), F.max(F.when(F.col("edge") >= 2, F.col("key"))).alias("last"))
    by_part = Window.orderBy("part")  # two keys for each bucket
    pairs = ends.select(F.lag("part").over(by_part).alias("upper"), F.lag("last").over(by_part).alias("last"), F.col("part").alias("lower"), "first").where("upper IS NOT NULL")
    pairs = stored(pairs.mapInArrow(_boundary_prefixes, "upper int, lower int, right int, left int"), "bucket-boundaries")
    up = pairs.select(F.col("lower").alias("part"), F.col("right").alias("_ru"), F.col("left").alias("_lu"))
    down = pairs.select(F.col("upper").alias("part"), F.col("right").alias("_rd"), F.col("left").alias("_ld"))
    outer = done.where("edge > 0").join(up, "part", "left").join(down, "part", "left")
    new = {}
    for side, is_end, right, left in (("up", F.col("edge") % 2 == 1, "_ru", "_lu"), ("down", F.col("edge") >= 2, "_rd", "_ld")):
        new[f"right_{side}"] = F.when(is_end, F.coalesce(right, F.lit(0))).otherwise(F.col(f"right_{side}"))
        new[f"left_{side}"] = F.when(is_end, F.coalesce(left, F.lit(0))).otherwise(F.col(f"left_{side}"))
    both = done.where("edge = 0").unionByName(outer.withColumns(new).select(*done.columns))
    return both.withColumn("right", F.greatest("right_up", "right_down")).where(F.col("right") >= CORE).drop("edge", "part")


def repeated_starts(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """(k1, k2, lo, hi): runs of starts of strings that occur elsewhere; ``rows`` are those of ``_anchor_rows``."""
    grams = rows.select("id", *_TEXT, F.explode(F.arrays_zip("hashes", "again")).alias("x")).select("id", *_TEXT, F.col("x.hashes").alias("h"), F.col("x.again").alias("again"))
    # A gram counts if two texts have it or one has it twice; copies of a text are one text.
    shared = grams.groupBy("h").agg(F.min("k1").alias("lo"), F.max("k1").alias("hi"), F.max("again").alias("again")).where("again OR lo <> hi").select("h")
    held = grams.join(stored(shared, "repeated-grams"), "h").groupBy(*_TEXT).agg(F.min("id").alias("id"), F.collect_set("h").alias("shared"))
    held = stored(held, "texts-with-grams")
    found = likely_among(_keyed(docs), "k1", held).join(held, ["id", *_TEXT]).select(*_TEXT, "text", "shared").dropDuplicates(_TEXT)
    done = sorted_suffixes(stored(found.mapInArrow(_unit_rows, f"{_TEXT_KIND}, t long, a long, b long, key binary"), "suffix-units"))

    # In bytes before the end of a unit: a neighbour that shares r bytes forwards and l backwards has the strings from LENGTH - r to l.
    def shared_from(side):
        return F.lit(LENGTH) - F.col(f"right_{side}")

    sure = None
    for side in ("up", "down"):
        run = done.select(*_TEXT, F.greatest(F.col("a"), F.col("t") - F.col(f"left_{side}")).alias("lo"), F.least(F.col("b"), F.col("t") - shared_from(side)).alias("hi")).where("lo <= hi")
        sure = run if sure is None else sure.unionByName(run)
    # No string needs more than the most that is shared forwards; what the neighbours with that much have is known.
    backwards = F.greatest(*[F.when(F.col(f"right_{side}") == F.col("right"), F.col(f"left_{side}")).otherwise(F.lit(-1)) for side in ("up", "down")])
    near = F.greatest(F.lit(LENGTH) - F.col("right"), backwards + 1)
    judged = done.withColumn("near", F.greatest(near, F.col("t") - F.col("b"))).withColumn("far", F.least(F.lit(UNIT - 1).cast("long"), F.col("t") - F.col("a")))
    # Where all units of a core agree on all bytes forwards, the neighbours share the most backwards too, and nothing is open.
    cores = judged.groupBy("core").agg((F.min("ahead") != F.max("ahead")).alias("mixed"), F.min(F.when(F.col("near") <= F.col("far"), F.col("near"))).alias("near"), F.max(F.when(F.col("near") <= F.col("far"), F.col("far"))).alias("far"))
    cores = stored(cores.where("mixed AND near IS NOT NULL").select("core", "near", "far"), "open-cores")
    partners = judged.where("key IS NOT NULL").drop("near", "far").join(cores, "core").groupBy(F.xxhash64("key").alias("whole")).agg(F.min(F.struct("t", *_TEXT, "key", "near", "far")).alias("u")).select("u.*")
    hashes = stored(partners.mapInArrow(_window_hashes, f"{_TEXT_KIND}, start long, h long"), "string-hashes")
    where = F.xxhash64(*_TEXT, "start")
    twice = stored(hashes.groupBy("h").agg(F.min(where).alias("x"), F.max(where).alias("y")).where("x <> y").select("h"), "repeated-strings")
    looked = hashes.join(twice, "h").select(*_TEXT, F.col("start").alias("lo"), F.col("start").alias("hi"))
    return sure.unionByName(looked)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept, spans, shas = [], [], []
        for text, runs in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist()):
            at = np.array([(r["lo"], r["hi"] + LENGTH) for r in runs], np.int64)
            edge = np.zeros(len(text) + 1, np.int64)
            np.add.at(edge, at[:, 0], 1)
            np.add.at(edge, at[:, 1], -1)
            gone = np.cumsum(edge)[:-1] > 0
            rest = np.frombuffer(text, np.uint8)[~gone].tobytes()
            kept.append(len(rest))
            spans.append(int((np.diff(np.concatenate([[False], gone]).astype(np.int8)) == 1).sum()))
            shas.append(hashlib.sha256(rest).digest())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in _TEXT), pa.array(kept, pa.int64()), pa.array(spans, pa.int64()), pa.array(shas, pa.binary())], names=[*_TEXT, "n_kept", "n_spans", "rest"])


def deduplicated_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    kind = dict(docs.dtypes)["doc_id"]
    rows = stored(_keyed(docs).mapInArrow(_anchor_rows, f"doc_id {kind}, id long, {_TEXT_KIND}, n_bytes long, sha binary, hashes array<long>, again array<boolean>"), "byte-anchors")
    runs = repeated_starts(rows, docs).groupBy(*_TEXT).agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))
    texts = stored(rows.groupBy(*_TEXT).agg(F.count("*").alias("copies"), F.min("id").alias("id")), "distinct-texts")
    held = stored(texts.where("copies = 1").join(runs, _TEXT).select("id", *_TEXT, "runs"), "repeated-runs")
    cut = likely_among(_keyed(docs), "k1", held).join(held, ["id", *_TEXT]).select(*_TEXT, "text", "runs").mapInArrow(_cut, f"{_TEXT_KIND}, n_kept long, n_spans long, rest binary")
    out = rows.drop("hashes", "again").join(stored(texts.drop("id").join(cut, _TEXT, "left"), "judged-texts"), _TEXT)
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= LENGTH)
    zero, none = F.lit(0).cast("long"), F.lit(hashlib.sha256(b"").hexdigest())
    return out.select(
        "doc_id", "n_bytes", F.when(whole, F.col("n_bytes")).otherwise(F.coalesce(F.col("n_bytes") - F.col("n_kept"), zero)).alias("n_removed"),
        F.when(whole, F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", zero)).alias("n_spans"),
        F.when(whole, none).otherwise(F.lower(F.hex(F.coalesce("rest", "sha")))).alias("kept_sha256"),
    )

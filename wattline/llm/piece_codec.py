"""Encoding and decoding with merge-type SentencePiece vocabularies.

No piece has white space after its first other character, so a text falls into chunks (white space, then the rest of a word) that are
merged independently. A chunk starts as its characters; an agenda holds the adjacent pairs that form a piece, best score first and
leftmost among equals, and each merge puts the pairs with its new neighbours on the agenda. What is no piece at the end becomes byte
pieces. The new chunks of a batch share their steps: they are rows of a matrix of symbols, the agenda is a matrix of the pairs' ranks, and
a step merges every row's best pair. Long chunks have a heap each. Every chunk that a task meets for the first time is compared with the
sentencepiece library, a batch of them at a time; if they ever differ, the library's ids are used and the row's ``agrees`` is false.

Defined cases: a null text is an empty one and has no ids; equal texts get equal rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

SPACE = "▁"
#: Chunks that a task remembers, and rows that it works on at a time.
REMEMBERED = 500_000
ROWS = 512
#: Lengths of the chunks that share a matrix; longer ones have a heap.
LENGTHS = (8, 16, 32, 64)
_NONE = np.iinfo(np.int32).max
_CHUNK = re.compile(f"{SPACE}+[^{SPACE}]*")


class Codec:
    """A vocabulary read through the library, with its own encoder and decoder."""

    def __init__(self, model: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model)
        lib = self.library
        size = lib.vocab_size()
        self.pieces = [lib.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))]
        self.ids = {self.pieces[i]: i for i in plain}
        self.scores = {self.pieces[i]: lib.get_score(i) for i in plain}
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("pieces of this vocabulary cross words")
        self.bytes_of = [p.replace(SPACE, " ").encode() for p in self.pieces]
        self.byte_ids = {}
        for i in range(size):
            if lib.is_byte(i):
                value = int(self.pieces[i][1:-1], 16)
                self.byte_ids[value], self.bytes_of[i] = i, bytes([value])
            elif lib.is_control(i):
                self.bytes_of[i] = b""
        self._tables()
        self.known: dict[str, tuple[bytes, bytes]] = {}
        self.again: set[str] = set()
        self.differing: set[str] = set()

    def _tables(self) -> None:
        """Symbols (pieces and the characters in them) by number, and for each pair of symbols that forms a piece its rank and the piece."""
        symbols = list(dict.fromkeys([*self.ids, *{c for p in self.ids for c in p}]))
        number = {p: i for i, p in enumerate(symbols)}
        self.vocabulary = np.array([self.ids.get(p, -1) for p in symbols] + [-1], np.int64)
        order = {x: i for i, x in enumerate(sorted({-x for x in self.scores.values()}))}
        pairs = [(number[a] * (len(symbols) + 1) + number[b], order[-self.scores[p]], number[p]) for p in self.ids for i in range(1, len(p)) if (a := p[:i]) in number and (b := p[i:]) in number]
        pairs.sort()
        self.keys, self.ranks, self.made = (np.array(x, kind) for x, kind in zip(zip(*pairs), (np.int64, np.int32, np.int32)))
        self.unknown = len(symbols)  # forms no pair
        self.of_code = np.full(0x110000, self.unknown, np.int32)
        for p, i in number.items():
            if len(p) == 1:
                self.of_code[ord(p)] = i

    def _ranked(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, piece) of pairs of symbols; no piece has the last rank."""
        key = left.astype(np.int64) * (self.unknown + 1) + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        found = self.keys[at] == key
        return np.where(found, self.ranks[at], _NONE), self.made[at]

    def _matrix(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge the rows of a matrix of symbols; ``sizes`` says how many a row has. Returns both as they are at the end."""
        width = symbols.shape[1]
        rank, _ = self._ranked(symbols[:, :-1], symbols[:, 1:])
        rank[np.arange(width - 1)[None, :] >= (sizes - 1)[:, None]] = _NONE
        done, out, out_sizes = np.arange(len(symbols)), symbols.copy(), sizes.copy()
        places = np.arange(width)[None, :]
        while len(done):
            at = rank.argmin(1)  # the leftmost of equals
            rows = np.arange(len(done))
            open_ = rank[rows, at] != _NONE
            if not open_.all():
                out[done[~open_]], out_sizes[done[~open_]] = symbols[~open_], sizes[~open_]
                done, symbols, sizes, rank, at = done[open_], symbols[open_], sizes[open_], rank[open_], at[open_]
                rows = np.arange(len(done))
                if not len(done):
                    break
            _, piece = self._ranked(symbols[rows, at], symbols[rows, at + 1])
            # What stands right of the pair moves one place to the left.
            moved = np.minimum(places + (places > at[:, None]), width - 1)
            symbols, sizes = np.take_along_axis(symbols, moved, 1), sizes - 1
            symbols[rows, at] = piece
            moved = np.minimum(places[:, :-1] + (places[:, :-1] >= at[:, None]), width - 2)
            rank = np.take_along_axis(rank, moved, 1)
            rank[:, -1] = _NONE
            right = at < sizes - 1
            rank[rows[right], at[right]] = self._ranked(piece[right], symbols[rows[right], at[right] + 1])[0]
            rank[rows[~right], np.minimum(at[~right], width - 2)] = _NONE
            left = at > 0
            rank[rows[left], at[left] - 1] = self._ranked(symbols[rows[left], at[left] - 1], piece[left])[0]
        return out, out_sizes

    def many(self, chunks: list[str]) -> list[list[int]]:
        """The ids of many chunks."""
        out: list[list[int] | None] = [None] * len(chunks)
        lengths = np.fromiter(map(len, chunks), np.int64, len(chunks))
        shortest = 0
        for width in LENGTHS:
            own = np.flatnonzero((lengths > shortest) & (lengths <= width))
            shortest = width
            if not len(own):
                continue
            codes = np.frombuffer("".join([chunks[i] for i in own]).encode("utf-32-le"), np.uint32)
            sizes = lengths[own]
            held = np.arange(width)[None, :] < sizes[:, None]
            symbols = np.full((len(own), width), self.unknown, np.int32)
            symbols[held] = self.of_code[codes]
            symbols, sizes = self._matrix(symbols, sizes)
            held = np.arange(width)[None, :] < sizes[:, None]
            ids = np.where(held, self.vocabulary[symbols], 0)
            odd = (ids < 0).any(1)
            for i, row, n, alone in zip(own.tolist(), ids.tolist(), sizes.tolist(), odd.tolist()):
                if not alone:
                    out[i] = row[:n]
        return [ids if ids is not None else self.chunk_ids(c) for ids, c in zip(out, chunks)]

    def merged(self, chunk: str) -> list[str]:
        """The pieces of a chunk: merge the best pair on the agenda until none is left."""
        scores, parts, n = self.scores, list(chunk), len(chunk)
        # A pair is (lost score, left place, right place, both together): the least is the next.
        agenda = [(-scores[pair], i, i + 1, pair) for i in range(n - 1) if (pair := chunk[i : i + 2]) in scores]
        if not agenda:
            return parts
        heapq.heapify(agenda)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pop, push = heapq.heappop, heapq.heappush
        while agenda:
            _, left, right, pair = pop(agenda)
            if after[left] != right or not parts[left] or not parts[right] or parts[left] + parts[right] != pair:
                continue
            parts[left], parts[right] = pair, ""
            following, previous = after[right], before[left]
            after[left] = following
            if following < n:
                before[following] = left
                new = pair + parts[following]
                if new in scores:
                    push(agenda, (-scores[new], left, following, new))
            if previous >= 0:
                new = parts[previous] + pair
                if new in scores:
                    push(agenda, (-scores[new], previous, left, new))
        return [p for p in parts if p]

    def chunk_ids(self, chunk: str) -> list[int]:
        ids: list[int] = []
        for piece in self.merged(chunk):
            known = self.ids.get(piece)
            ids += [known] if known is not None else [self.byte_ids[b] for b in piece.encode()]
        return ids

    def raw(self, ids) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids])

    def decode(self, ids) -> str:
        """The text of ids, without the space that encoding puts before a text."""
        out = self.raw(ids).decode("utf-8", errors="replace")
        return out[1:] if out.startswith(" ") else out

    @staticmethod
    def chunks(text: str) -> list[str]:
        """The words of a text, each standing for a chunk of one more white-space mark in front."""
        if not text:
            return []
        words = text.split(" ")
        if SPACE not in text and "" not in words:
            return words
        return [c[1:].replace(SPACE, " ") for c in _CHUNK.findall(SPACE + text.replace(" ", SPACE))]

    def learn(self, words: set[str]) -> None:
        """Encode words that are new here and hold them against the library."""
        fresh = words.difference(self.known)
        if len(self.known) + len(fresh) > REMEMBERED:
            # Words that came back since the last time stay; the many that occur once go.
            stay = self.again if len(self.again) < REMEMBERED // 2 else set()
            self.known = {w: self.known[w] for w in stay | (words - fresh)}
            self.again, self.differing = set(), self.differing & self.known.keys()
        self.again |= words - fresh
        fresh = list(fresh)
        theirs = self.library.encode([w for w in fresh if w], num_threads=1) if fresh else []
        checked = iter(theirs)
        for w, ids in zip(fresh, self.many([SPACE + w.replace(" ", SPACE) for w in fresh])):
            expected = next(checked) if w else [self.library.piece_to_id(SPACE)]
            if ids != expected:
                self.differing.add(w)
                ids = expected
            self.known[w] = (array("i", ids).tobytes(), self.raw(ids))

    def encode(self, text: str) -> list[int]:
        words = self.chunks(text)
        self.learn(set(words))
        return np.frombuffer(b"".join([self.known[w][0] for w in words]), dtype=np.int32).tolist()


_CODECS: dict[str, Codec] = {}


def codec(model: str) -> Codec:
    """One codec for each vocabulary and Python worker."""
    if model not in _CODECS:
        _CODECS[model] = Codec(model)
    return _CODECS[model]


def _worker(model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                texts = [own.chunks(t or "") for t in batch.column("text").to_pylist()]
                own.learn(set().union(*texts))
                known, sizes, values, decoded, agrees = own.known, [0], [], [], []
                for words in texts:
                    both = [known[w] for w in words]
                    ids = b"".join([x[0] for x in both])
                    values.append(ids)
                    sizes.append(sizes[-1] + len(ids) // 4)
                    decoded.append(b"".join([x[1] for x in both])[1:].decode("utf-8", errors="replace"))
                    agrees.append(not own.differing or own.differing.isdisjoint(words))
                flat = pa.array(np.frombuffer(b"".join(values), dtype=np.int32), type=pa.int32())
                lists = pa.ListArray.from_arrays(pa.array(sizes, type=pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, pa.array(decoded, type=pa.string()), pa.array(agrees)], names=["doc_id", "ids", "decoded", "agrees"])

    return run


def encoded(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids, decoded, agrees) of every text. ``model`` is a path that the executors can read."""
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_worker(model), f"doc_id {kind}, ids array<int>, decoded string, agrees boolean")


def digests(docs: DataFrame, model: str) -> DataFrame:
    out = encoded(docs, model)
    return out.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"), "agrees",
    )

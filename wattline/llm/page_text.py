"""Main text of web pages: markup first, then a suffix array over the pages of a host for what markup leaves open.

Each page is cut into blocks of text. Blocks in menus, headers, footers, sidebars, notices, adverts, forms and comments are furniture;
blocks in an ``article`` (or else ``main``) element are the page's main blocks; the rest is open. All blocks of a page are its token
stream: the frame (furniture and open blocks) in order, then the main blocks. The streams of a host's pages are searched for runs that
are in at least two distinct contents of the host (exact copies of a page count once): suffixes are range-partitioned by host and leading
tokens with sampled splitters, sorted, and compared with their neighbours, also across partitions. In the frame a run is any ``RUN``
tokens in a row. A main block is one run, from its first token to its last, if it has ``RUN`` tokens: text inside a paragraph is a
page's own, so main blocks go whole or stay whole, and the sort has one row for each of them.

Markup is a hint for how much a run must show. On pages without main blocks, open tokens in repeated runs are boilerplate. A main block is
boilerplate if ``MAIN_VOTES`` distinct contents vote for it; a page votes if at least half of its own words are in no repeated run, so
near copies of an article, which repeat nearly all of it, do not erase each other. Inside an article, class names and ids count as
furniture only where the whole name is one that pages use for it. The rest of the main (or else open) blocks stays. Equal suffixes are
ordered by content and page, so a host or a run of any number of pages spreads over partitions.

White space is that of HTML and the no-break space. Defined cases: a null or empty page has an empty text; broken markup is read as far as
it goes (an unclosed tag ends with its parent); repeated rows are one page; a page without host shares one with others of that kind; other
columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from wattline.llm.common import FILTER_BUCKETS, stored

RUN = 8
#: So many distinct contents of a host, each with enough words of its own, make a run inside main blocks boilerplate.
MAIN_VOTES = 3
ROWS_A_PART = 200_000
#: Pages that a task holds as Python objects at a time.
PAGES_AT_ONCE = 200
#: A decided run meets the pages that have it in so many groups.
SALTS = 16

# Element names of HTML and the words by which pages name their furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
FURNITURE = frozenset("nav footer aside form button select textarea dialog menu head title noscript template svg canvas object iframe audio video math datalist".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar note status toolbar".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus discussion dropdown "
    "footer gdpr header hidden login masthead menu menubar modal nav navbar navigation newsletter notice notices notification overlay pager pagination paywall popup "
    "promo promotion related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar topbar widget".split()
)
#: Names that also head sections of an article's own text.
IN_TEXT = frozenset("discussion header notice notices related replies reply respond search share".split())
#: Start tags that end an open element of the same kind.
SIBLINGS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|iframe|svg|title)\b[^>]*?(?:/>|>.*?(?:</\1\s*>|\Z))|<[!?][^>]*>?"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.S)
_NAME_PARTS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
KEPT, MAIN, OPEN, DROPPED = 0, 1, 2, 3


def _named_furniture(attributes: str, inside: bool = False) -> bool:
    """Whether the attributes of a tag say furniture; ``inside`` an article only whole names do, and ids only if no section of text has them."""
    if not attributes or attributes.isspace():
        return False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
        if name == "role" and value.lower() in ROLES:
            return True
        if inside:
            if name == "class" and not NAMES.isdisjoint(value.lower().split()) or name == "id" and value.lower() in NAMES - IN_TEXT:
                return True
        elif name in ("class", "id") and not NAMES.isdisjoint(_NAME_PARTS.findall(_CAMEL.sub("-", value).lower())):
            return True
    return False


def blocks(page: str) -> list[tuple[int, str]]:
    """(zone, text) of the blocks of a page in order; text with single spaces, never empty."""
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, int, bool]] = []  # name, zone inside, in a header of an article
    text: list[str] = []
    zone, heading_only = OPEN, False

    def end_block() -> None:
        if text:
            words = entities.unescape("".join(text)).split()
            text.clear()
            if words:
                out.append((zone, " ".join(words)))

    def settle() -> None:
        nonlocal zone, heading_only
        zone, heading_only = (stack[-1][1], stack[-1][2]) if stack else (OPEN, False)

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            text.append(page[at : m.start()])
        at = m.end()
        name = m.group(3) or m.group(6)
        if name is None:
            continue
        name, closing, attributes = name.lower(), m.group(2) or m.group(5), m.group(4) or m.group(7) or ""
        if closing:
            places = [i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name]
            if places:
                if any(x[0] in BLOCK for x in stack[places[0] :]):
                    end_block()
                del stack[places[0] :]
                settle()
            elif name in BLOCK:
                end_block()
            continue
        if name == "br":
            text.append(" ")
            continue
        if name in BLOCK:
            end_block()
            if name in SIBLINGS or name not in ("li", "dt", "dd", "td", "th", "tr"):
                ends = SIBLINGS.get(name, set()) | {"p"}
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in ends:
                        del stack[i:]
                        break
                    if stack[i][0] in BLOCK:
                        break
                settle()
        if name in VOID or attributes.endswith("/"):
            continue
        new, only = zone, heading_only
        if zone != DROPPED:
            if name in FURNITURE or _named_furniture(attributes, zone in (KEPT, MAIN)):
                new = DROPPED
            elif name == "header":
                new, only = (DROPPED, True) if zone in (KEPT, MAIN) else (DROPPED, False)
            elif name == "article":
                new = KEPT
            elif name == "main" and zone == OPEN:
                new = MAIN
        elif name == "article" and not any(x[1] in (KEPT, MAIN) for x in stack) and all(x[0] in ("nav", "header", "footer", "ul", "li", "div", "body", "html") for x in stack) and not _named_furniture(attributes) and any(x[0] in ("nav", "header", "footer") for x in stack):
            new = KEPT  # an article does not belong into an unclosed menu
        if zone == DROPPED and heading_only and name in HEADINGS:
            new = next(x[1] for x in reversed(stack) if x[1] != DROPPED)
        stack.append((name, new, only))
        zone, heading_only = new, only
    if at < len(page):
        text.append(page[at:])
    end_block()
    return out


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").removeprefix("www.")
    except ValueError:
        return ""


def _digest(texts: list[str]) -> int:
    return int.from_bytes(xxhash.xxh3_64_digest("\n".join(texts).encode()), "big", signed=True)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches):
        out: dict[str, list] = {c: [] for c in ("host", "stream", "sizes", "own", "frame", "content", "main", "words")}
        for url, page in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist()):
            found = blocks(page or "")
            zones = {z for z, _ in found}
            emitted = KEPT if KEPT in zones else MAIN if MAIN in zones else OPEN
            frame, main = [x for x in found if x[0] in (OPEN, DROPPED)], [x for x in found if x[0] in (KEPT, MAIN)]
            out["host"].append(xxhash.xxh3_64_digest(host_of(url).encode()))
            out["stream"].append([t for _, t in frame + main])
            out["sizes"].append([t.count(" ") + 1 for _, t in frame + main])
            out["own"].append([z == emitted for z, _ in frame + main])
            out["frame"].append(len(frame))
            out["content"].append(_digest([t for _, t in found]))
            out["main"].append(_digest([t for _, t in main]))
            out["words"].append(sum(t.count(" ") + 1 for _, t in found))
        kinds = [pa.binary(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "url", "page")), *(pa.array(v, k) for v, k in zip(out.values(), kinds))], names=["page_id", "url", "page", *out])


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from (batch.slice(i, PAGES_AT_ONCE) for i in range(0, batch.num_rows, PAGES_AT_ONCE))


SEEDS = ((0x9E3779B97F4A7C15, 0xFF51AFD7ED558CCD), (0xC2B2AE3D27D4EB4F, 0xC4CEB9FE1A85EC53))


def _window_keys(host: int, tokens: np.ndarray) -> np.ndarray:
    """128-bit hashes, as two columns, of the host and each RUN tokens in a row."""
    n = max(0, len(tokens) - RUN + 1)
    out = np.empty((n, 2), np.uint64)
    for column, (seed, factor) in enumerate(SEEDS):
        h = np.full(n, host ^ seed, np.uint64)
        for k in range(RUN):
            h = (h ^ tokens[k : k + n]) * np.uint64(factor)
            h ^= h >> np.uint64(29)
        out[:, column] = h
    return out


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of host and run for the frame's suffixes and for whole main blocks, with content and place; ``own``: the page emits this part."""
    for batch in _slices(batches):
        known: dict[str, int] = {}
        keys, contents, pages, places, owned = [], [], [], [], []
        for page, host, stream, own, frame, content, main in zip(*(batch.column(c).to_pylist() for c in ("page", "host", "stream", "own", "frame", "content", "main"))):
            words = [w for t in stream[:frame] for w in t.split()]
            for w in set(words).difference(known):
                known[w] = xxhash.xxh3_64_intdigest(w)
            windows = _window_keys(int.from_bytes(host, "big"), np.array([known[w] for w in words], np.uint64))
            whole, starts, emitted, base = [], [], [], len(words)
            for t, is_own in zip(stream[frame:], own[frame:]):
                size = t.count(" ") + 1
                if size >= RUN:
                    digest = xxhash.xxh3_128_intdigest(host + t.encode())
                    whole.append((digest >> 64, digest & (1 << 64) - 1))
                    starts.append(base)
                    emitted.append(is_own)
                base += size
            keys += [windows, np.array(whole, np.uint64).reshape(-1, 2)]
            contents += [np.full(len(windows), content, np.int64), np.full(len(whole), main, np.int64)]
            pages.append(np.full(len(windows) + len(whole), page, np.int64))
            places += [np.arange(len(windows), dtype=np.int32), np.array(starts, np.int32)]
            owned += [np.full(len(windows), any(own[:frame])), np.array(emitted, bool)]
        if keys:
            both = np.concatenate(keys).view(np.int64)
            columns = [np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1]), *(np.concatenate(x) for x in (contents, pages, places, owned))]
            yield from pa.table(dict(zip(("k1", "k2", "content", "page", "place", "own"), columns))).to_batches(max_chunksize=65536)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Own rows of a sorted partition whose key is in several contents, with their number; all of its first and last key in any case."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    table = pa.Table.from_batches(got) if (got := list(batches)) else None
    if table is None or not table.num_rows:
        return
    k1, k2, content = (table[c].to_numpy() for c in ("k1", "k2", "content"))
    new_key = np.concatenate([[True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])])
    new_content = new_key | np.concatenate([[True], content[1:] != content[:-1]])
    group = np.cumsum(new_key) - 1
    contents = np.bincount(group, weights=new_content).astype(np.int64)[group]
    # Rows with the first or last key of the partition may go on in the next one.
    edge = (group == 0) | (group == group[-1])
    keep = np.flatnonzero((contents > 1) & table["own"].to_numpy() | edge)
    out = table.take(pa.array(keep)).append_column("contents", pa.array(contents[keep])).append_column("edge", pa.array(edge[keep])).append_column("part", pa.repeat(pa.scalar(part, pa.int32()), len(keep)))
    yield from out.combine_chunks().to_batches(max_chunksize=16384)


def repeated_runs(parsed: DataFrame) -> DataFrame:
    """(k1, k2, content, page, place) of the runs in what a page emits that another content of its host has too, in any part."""
    kinds = "k1 long, k2 long, content long, page long, place int, own boolean"
    words = parsed.agg(F.sum("words")).first()[0] or 0
    rows = parsed.select("page", "host", "stream", "own", "frame", "content", "main").mapInArrow(_suffixes, kinds)
    ranged = rows.repartitionByRange(words // ROWS_A_PART + 1, "k1", "k2", "content", "page").sortWithinPartitions("k1", "k2", "content")
    done = stored(ranged.mapInArrow(_neighbours, f"{kinds}, contents long, edge boolean, part int"), "sorted-host-suffixes", compression="zstd")
    # Two keys for each partition; a content that goes on from one partition to the next counts once.
    ends = done.where("edge").groupBy("k1", "k2", "part").agg(F.max("contents").alias("n"), F.min("content").alias("first"), F.max("content").alias("last"))
    by_key = Window.partitionBy("k1", "k2")
    again = F.coalesce((F.col("first") == F.lag("last").over(by_key.orderBy("part"))).cast("long"), F.lit(0))
    ends = ends.withColumn("n", F.col("n") - again).withColumn("n", F.sum("n").over(by_key)).where("n > 1").select("k1", "k2", "part")
    out = ["k1", "k2", "content", "page", "place"]
    return done.where("NOT edge").select(*out).unionByName(done.where("edge AND own").join(F.broadcast(ends), ["k1", "k2", "part"]).select(*out))


def _starts(runs: DataFrame, name: str) -> DataFrame:
    return runs.groupBy("page").agg(F.collect_set("place").alias(name))


def _free(sizes: list[int], frame: int, starts: list[int] | None) -> np.ndarray:
    """Which tokens of a stream are in none of the runs: RUN tokens each in the frame, whole blocks after it."""
    edge = np.zeros(sum(sizes) + 1, np.int64)
    at = np.array(starts or [], np.int64)
    base = sum(sizes[:frame])
    in_frame = at[at < base]
    np.add.at(edge, in_frame, 1)
    np.add.at(edge, in_frame + RUN, -1)
    repeated = set(at[at >= base].tolist())
    for size in sizes[frame:]:
        if base in repeated:
            edge[base] += 1
            edge[base + size] -= 1
        base += size
    return np.cumsum(edge)[:-1] == 0


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pages of which at least half of the own words are in no repeated run."""
    for batch in _slices(batches):
        pages = []
        for page, sizes, own, frame, starts in zip(*(batch.column(c).to_pylist() for c in ("page", "sizes", "own", "frame", "twice"))):
            mine = np.repeat(np.array(own, bool), sizes)
            if mine.any() and 2 * _free(sizes, frame, starts)[mine].sum() >= mine.sum():
                pages.append(page)
        yield pa.RecordBatch.from_arrays([pa.array(pages, pa.int64())], names=["page"])


def _unique_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches):
        texts = []
        for stream, owned, frame, twice, voted in zip(*(batch.column(c).to_pylist() for c in ("stream", "own", "frame", "twice", "voted"))):
            words = [t.split() for t in stream]
            free, kept, base = _free([len(w) for w in words], frame, voted if any(owned[frame:]) else twice), [], 0
            for block, is_own in zip(words, owned):
                own = free[base : base + len(block)]
                base += len(block)
                # A run that only reaches into a block from its neighbours says nothing about it: long stretches and whole blocks count.
                cuts = np.flatnonzero(np.diff(own.astype(np.int8), prepend=2, append=2))
                rest = [w for lo, hi in zip(cuts, cuts[1:]) if own[lo] or hi - lo < min(RUN, len(block)) for w in block[lo:hi]]
                if is_own and rest:
                    kept.append(" ".join(rest))
            texts.append("\n".join(kept))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "url")), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def main_texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    kinds = dict(pages.dtypes)
    ids = f"page_id {kinds['page_id']}, url {kinds['url']}"
    rows = pages.select("page_id", "url", F.xxhash64("page_id", "url", "html", F.length("html")).alias("page"), "html")
    parsed = stored(rows.mapInArrow(_parsed, f"{ids}, page long, host binary, stream array<string>, sizes array<int>, own array<boolean>, frame int, content long, main long, words long"), "parsed-pages", compression="zstd")
    runs = stored(repeated_runs(parsed), "repeated-runs")
    twice = stored(_starts(runs, "twice"), "repeated-places")
    # Pages without repeats vote for nothing, so only the others are looked at.
    votes = stored(parsed.select("page", "sizes", "own", "frame").join(twice, "page").mapInArrow(_votes, "page long").distinct(), "voting-pages")
    sure = runs.join(votes, "page").groupBy("k1", "k2", "content").agg(F.lit(1).alias("one")).groupBy("k1", "k2").agg(F.count("one").alias("n")).where(F.col("n") >= MAIN_VOTES)
    sure = stored(sure.select("k1", "k2"), "voted-runs").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    voted = _starts(runs.withColumn("salt", F.pmod("page", F.lit(SALTS)).cast("int")).join(sure, ["k1", "k2", "salt"]), "voted")
    marks = stored(twice.join(voted, "page", "left"), "marked-pages")
    # Texts of pages without marks are not shuffled.
    rows = parsed.select("page_id", "url", "page", "stream", "own", "frame")
    bucket = F.pmod(F.xxhash64("page"), F.lit(FILTER_BUCKETS))
    marked = stored(marks.select(bucket.alias("bucket")).distinct(), "marked-buckets")
    split = rows.withColumn("bucket", bucket).join(F.broadcast(marked.withColumn("marked", F.lit(True))), "bucket", "left")
    own = F.transform(F.filter(F.arrays_zip("stream", "own"), lambda x: x["own"]), lambda x: x["stream"])
    whole = split.where("marked IS NULL").select("page_id", "url", F.array_join(own, "\n").alias("text"))
    marks = split.where("marked").join(marks, "page", "left").select("page_id", "url", "stream", "own", "frame", "twice", "voted")
    out = whole.unionByName(marks.mapInArrow(_unique_runs, f"{ids}, text string"))
    return out.withColumn("n_chars", F.length("text").cast("long"))

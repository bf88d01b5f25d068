"""Exact substring removal: bytes under any 200-byte string that also starts elsewhere, by bounded interval expansion on a BWT.

Every 200-byte window has one smallest hash among its 32-byte strings (its anchor).  Equal windows have equal anchors, so
windows are cut into segments by anchor and segments meet by anchor hash.  Segments that are equal as a whole, by the anchor's hash
and 128 bits of XXH3 over all their bytes, are repeats.
Of the rest that share an anchor hash, tasks join a bounded number of segments into one text, build its Burrows-Wheeler
transform and find its longest common prefixes by increasing value, breadth first, with backward extension of suffix
intervals, up to 199: places between suffixes that are left then share 200 bytes or more.  Segments of anchors with
more of them than a task takes are compared through shuffles instead, by blocks of windows and then by window, exactly as well.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table
from .rolling import BASES, Rolling, mixed

LEAST = 200
GRAM = 32
#: Segments of one anchor that are gathered at most, and bytes of segments that are joined for one transform.
GATHER = 2000
BLOCK = 1 << 19
#: Windows that are compared as one first, where anchors have more segments than that.
TOGETHER = 13
#: Windows of a long text that are cut into segments at a time; a segment then ends there, and nothing else changes.
SLICE = 1 << 22
PLACE = np.uint64((1 << 24) - 1)
#: A segment's first window, and how many follow it (fewer than SLICE), in one number.
SPAN_BITS = 24


def segments_of(data: np.ndarray, rolling: Rolling, least: int = LEAST, digests: bool = True) -> tuple[np.ndarray, ...]:
    """(anchor hash, first window, last window) of each segment of a text, none below least bytes; with digests also two halves of a hash of all bytes."""
    out = []
    for at in range(0, len(data) - least + 1, SLICE):
        part = data[at : at + SLICE + least - 1]
        rolling.load(part)
        grams, wide = rolling.runs(GRAM), least - GRAM + 1
        # The last of equal hashes is smallest, so a window's anchor depends on its bytes alone.
        low = (grams & ~PLACE) | (PLACE - np.arange(len(grams), dtype=np.uint64))
        width = 1
        while 2 * width <= wide:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        n = len(part) - least + 1
        place = (PLACE - (np.minimum(low[:n], low[wide - width : wide - width + n]) & PLACE)).astype(np.int64)
        first = np.flatnonzero(np.diff(place, prepend=-1))
        last = np.append(first[1:], n) - 1
        found = [grams[place[first]].view(np.int64), at + first, at + last]
        if digests:
            view, digest = memoryview(np.ascontiguousarray(part)), xxhash.xxh3_128_digest
            whole = b"".join([digest(view[f:e]) for f, e in zip(first.tolist(), (last + least).tolist(), strict=True)])
            found.extend(np.frombuffer(whole, np.int64).reshape(-1, 2).T)
        out.append(found)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else tuple(np.zeros(0, np.int64) for _ in range(5 if digests else 3))


def _long_enough(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    for i, text in enumerate(texts):
        if len(data := np.frombuffer(text.as_py() or b"", np.uint8)) >= LEAST:
            yield i, data


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rolling = Rolling()
    for batch in batches:
        for _, data in _long_enough(batch.column(0)):
            yield pa.RecordBatch.from_arrays([pa.array(segments_of(data, rolling, digests=False)[0])], ["h"])


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rolling = Rolling()
    for batch in batches:
        keys = [batch.column(k).to_numpy() for k in (0, 1)]
        for i, data in _long_enough(batch.column(2)):
            h, a, b, c, d = segments_of(data, rolling)
            own = [np.full(len(h), k[i]) for k in keys]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*own, h, c, d, a << SPAN_BITS | b - a)], ["k", "l", "h", "c", "d", "ab"])


def _packed(batches: Iterator[pa.RecordBatch], rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Small batches joined."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _all_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _packed(_anchors(batches))


def _cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _packed(_segments(batches))


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by their first depth symbols or more; symbols are below 512.

    Sorted by 7 symbols first.  Then only suffixes that are still tied are sorted again, by their rank and those of the suffixes one and
    two lengths on, which triples the length.
    """
    n, step = len(symbols), 7
    padded = np.concatenate((symbols.astype(np.int64), np.zeros(step, np.int64)))
    key = np.zeros(n, np.int64)
    for k in range(step):
        key = key << 9 | padded[k : k + n]
    order = np.argsort(key)
    key = key[order]
    new = np.concatenate(([True], key[1:] != key[:-1]))[:n]
    slot, rank = np.arange(n), np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, slot, 0)) + 1
    bits = max(1, n.bit_length())
    while step < depth:
        tied = np.flatnonzero(~(new & np.append(new[1:], True)))
        if not len(tied):
            break
        at = order[tied]
        ahead = lambda d, at=at: np.where(at + d < n, rank[np.minimum(at + d, n - 1)], 0)
        key, step = (rank[at] << 2 * bits | ahead(step) << bits | ahead(2 * step), 3 * step) if 3 * bits <= 63 else (rank[at] << bits | ahead(step), 2 * step)
        by = np.argsort(key)
        order[tied], key = at[by], key[by]
        new[tied] = np.concatenate(([True], key[1:] != key[:-1]))
        rank[order[tied]] = np.maximum.accumulate(np.where(new, slot, 0))[tied] + 1
    return order


def shared_starts(symbols: np.ndarray, order: np.ndarray, least: int) -> np.ndarray:
    """Whether the suffix at each place shares least symbols or more with another one.  Symbol 0 ends a text; suffixes that meet it earlier mean nothing.

    Level by level, intervals of suffixes that begin with the same l symbols are extended by each symbol before them.  The
    end of an extended interval that was not met before is where suffixes share exactly l symbols.
    """
    n = len(symbols)
    before = symbols[order - 1]
    by_symbol = np.argsort(before.astype(np.uint16), kind="stable")
    forward = np.empty(n, np.int64)  # from a suffix to the one that begins a symbol earlier, among suffixes in order
    forward[by_symbol] = np.arange(n)
    same = before[by_symbol][1:] == before[by_symbol][:-1]
    following, previous = np.full(n, n), np.full(n, -1)
    following[by_symbol[:-1][same]] = by_symbol[1:][same]
    previous[by_symbol[1:][same]] = by_symbol[:-1][same]
    known = np.zeros(n + 1, bool)
    known[[0, n]] = True
    lo, hi = np.array([0]), np.array([n])
    for level in range(least):
        size = hi - lo
        owner = np.repeat(np.arange(len(lo)), size)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + lo[owner]
        if level:
            inner = before[at] != 0
            at, owner = at[inner], owner[inner]
        low = np.sort(forward[at[previous[at] < lo[owner]]])
        high = np.sort(forward[at[following[at] >= hi[owner]]]) + 1
        new = ~known[high]
        lo, hi = low[new], high[new]
        if not len(hi):
            break
        known[hi] = True
    found = np.empty(n, bool)
    found[order] = ~known[:-1] | ~known[1:]
    return found


def repeated_windows(texts: list[bytes], least: int = LEAST) -> list[np.ndarray]:
    """For each text, whether each of its windows stands elsewhere in texts as well."""
    joined = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64) + 1
    sizes = np.array([len(t) for t in texts])
    starts = np.cumsum(sizes + 1) - sizes - 1
    symbols = np.zeros(int(sizes.sum()) + len(texts), np.int64)
    inside = np.ones(len(symbols), bool)
    inside[starts + sizes] = False
    symbols[inside] = joined
    found = shared_starts(symbols, suffix_order(symbols, least + 2), least)
    return [found[s : s + n - least + 1] for s, n in zip(starts, sizes, strict=True)]


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.diff(flags.astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups (lists of k, l, a, n, bytes) to spans (k, l, s, e) of the segments that occur once."""
    texts, owners, size = [], [], 0

    def flush():
        out = []
        for (k, l, a, n), flags in zip(owners, repeated_windows(texts), strict=True):
            if n == 1:
                out += [(k, l, a + int(s), a + int(e) - 1 + LEAST) for s, e in zip(*_runs(flags), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(4)], ["k", "l", "s", "e"])

    for batch in batches:
        for group in batch.column(0).to_pylist():
            for x in group:
                texts.append(x["bytes"])
                owners.append((x["k"], x["l"], x["a"], x["n"]))
                size += len(x["bytes"])
            if size >= BLOCK:
                yield flush()
                texts, owners, size = [], [], 0
    if texts:
        yield flush()


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of the wanted segments of each text."""
    for batch in batches:
        rows = []
        for k, l, text, wanted in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            rows += [(k, l, w["h"], w["many"], w["n"], w["a"], text[w["a"] : w["b"] + LEAST]) for w in wanted]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["k", "l", "h", "many", "n", "a", "bytes"])


def blocks_of(data: bytes, h: int, first: Rolling, second: Rolling):
    """Blocks of windows of a segment, by their distance from its anchor: (first window, core hashes x and y, whole hash z, hashes of the windows).

    The windows of a block all hold its core, so windows that are equal have equal cores; segments may begin or end within a block.
    """
    for r in (first, second):
        r.load(np.frombuffer(data, np.uint8))
    anchor = int(np.flatnonzero(first.runs(GRAM).view(np.int64) == h)[-1])  # none follows within a window that has this anchor
    windows = first.runs(LEAST)
    block = (anchor - np.arange(len(windows))) // TOGETHER
    begin = np.flatnonzero(np.diff(block, prepend=-1))
    end = np.append(begin[1:], len(windows)) - 1
    core, core_end = anchor - TOGETHER * block[begin], anchor - TOGETHER * (block[begin] + 1) + 1 + LEAST
    x, y = first.of(core, core_end), mixed(second.of(core, core_end) + block[begin].astype(np.uint64))
    z = mixed(first.of(begin, end + LEAST) + ((anchor - begin) * 1024 + anchor - end).astype(np.uint64))
    cut_up = [windows[b : e + 1].view(np.int64) for b, e in zip(begin, end, strict=True)]
    return begin, x.view(np.int64), y.view(np.int64), z.view(np.int64), cut_up


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    first, second = Rolling(BASES[0]), Rolling(BASES[1])
    for batch in batches:
        out, lists = [[] for _ in range(7)], []
        for k, l, h, a, n, data in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            begin, x, y, z, windows = blocks_of(data, h, first, second)
            for held, value in zip(out, (np.full(len(x), k), np.full(len(x), l), a + begin, np.full(len(x), n), x, y, z), strict=True):
                held.append(value)
            lists += windows
        if lists:
            offsets = np.concatenate(([0], np.cumsum([len(w) for w in lists]))).astype(np.int32)
            w = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(lists)))
            yield pa.RecordBatch.from_arrays([*(pa.array(np.concatenate(v)) for v in out), w], ["k", "l", "s", "n", "x", "y", "z", "w"])


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    for batch in batches:
        out = []
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            text, kept, end, removed, runs = text or b"", [], 0, 0, 0
            fresh = True
            for s, e in sorted((x["s"], x["e"]) for x in spans or ()):
                if fresh or s > end:
                    kept.append(text[end:s])
                    runs, fresh = runs + 1, False
                    removed, end = removed + e - s, e
                elif e > end:
                    removed, end = removed + e - end, e
            rest = b"".join([*kept, text[end:]])
            out.append((len(text), removed, runs, hashlib.sha256(rest).hexdigest(), rest))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in out], t) for i, t in enumerate(kinds))], names)


def repeated_spans(rows: DataFrame, gather: int = GATHER) -> DataFrame:
    """(k, l, s, e): repeated bytes of texts, from rows (k, l, bytes), k and l naming a row together.  Spans of a row may overlap."""
    segments = rows.mapInArrow(_cut_up, "k long, l long, h long, c long, d long, ab long")
    anchors = rows.select("bytes").mapInArrow(_all_anchors, "h long")
    shared = cut(anchors.groupBy("h").agg(F.count("*").alias("times")).filter("times > 1").select("h"))
    met = cut(segments.join(shared, "h"))
    groups = cut(met.groupBy("h", "c", "d").agg(F.count("*").alias("n"), F.min(F.struct("k", "l", "ab")).alias("first")))
    begin, end = (lambda ab: F.shiftright(ab, SPAN_BITS)), (lambda ab: F.shiftright(ab, SPAN_BITS) + F.col(ab).bitwiseAND(F.lit((1 << SPAN_BITS) - 1)))
    whole = met.join(groups.filter("n > 1").select("h", "c", "d"), ["h", "c", "d"]).select("k", "l", begin("ab").alias("s"), (end("ab") + LEAST).alias("e"))

    unlike = cut(groups.groupBy("h").agg(F.count("*").alias("kinds")).filter("kinds > 1"))
    open_ = groups.join(unlike, "h").select("h", "n", (F.col("kinds") > gather).alias("many"), "first.k", "first.l", begin("first.ab").alias("a"), end("first.ab").alias("b"))
    wanted = open_.groupBy("k", "l").agg(F.collect_list(F.struct("h", "many", "n", "a", "b")).alias("wanted"))
    fetched = cut(rows.join(wanted, ["k", "l"]).dropDuplicates(["k", "l"]).mapInArrow(_fetch, "k long, l long, h long, many boolean, n long, a long, bytes binary"))
    few = fetched.filter("not many").groupBy("h").agg(F.collect_list(F.struct("k", "l", "a", "n", "bytes")).alias("group")).select("group")
    by_transform = few.mapInArrow(_gathered, "k long, l long, s long, e long")

    return whole.union(by_transform).union(_by_blocks(fetched.filter("many")))


def _by_blocks(segments: DataFrame) -> DataFrame:
    """(k, l, s, e) from segments of anchors that have too many for one task.

    Blocks that are equal as a whole are repeats, a row each.  Of the others with an equal core, the windows are counted.
    """
    blocks = cut(segments.select("k", "l", "h", "a", "n", "bytes").mapInArrow(_blocks, "k long, l long, s long, n long, x long, y long, z long, w array<long>"))
    kinds = cut(blocks.groupBy("x", "y", "z").agg(F.count("*").alias("times"), F.min(F.struct("k", "l", "s", "n", "w")).alias("one")))
    equal = blocks.filter("n = 1").join(kinds.filter("times > 1").select("x", "y", "z"), ["x", "y", "z"])
    unlike = cut(kinds.groupBy("x", "y").agg(F.count("*").alias("kinds")).filter("kinds > 1").select("x", "y"))
    single = (F.col("one.n") == 1) & (F.col("times") == 1)
    windows = kinds.join(unlike, ["x", "y"]).select("x", "y", "one.k", "one.l", "one.s", single.alias("single"), F.posexplode("one.w").alias("at", "window"))
    windows = cut(windows)
    twice = cut(windows.groupBy("x", "y", "window").agg(F.count("*").alias("times")).filter("times > 1").select("x", "y", "window"))
    found = windows.filter("single").join(twice, ["x", "y", "window"])
    spans = equal.select("k", "l", "s", (F.col("s") + F.size("w") - 1 + LEAST).alias("e"))
    return spans.union(found.select("k", "l", (F.col("s") + F.col("at")).alias("s"), (F.col("s") + F.col("at") + LEAST).alias("e")))


def remove_repeats(docs: DataFrame, gather: int = GATHER) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept), one row per row of docs; kept holds the remaining bytes.

    Null texts are empty; texts below 200 bytes keep all.  Rows that repeat are copies of each other, so both lose all.  Texts of any
    length are cut into segments SLICE windows at a time, which changes nothing in the result.  There are no ties: a byte goes or
    stays.  An empty table gives an empty table.  Other columns of docs are not read, so their names don't matter.
    """
    keyed = docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("bytes"), F.xxhash64("doc_id", "text").alias("k"), F.xxhash64(F.lit("l"), "text", "doc_id").alias("l"))
    spans = repeated_spans(keyed.select("k", "l", "bytes"), gather)
    by_text = spans.groupBy("k", "l").agg(F.collect_set(F.struct("s", "e")).alias("spans"))
    kind = dict(docs.dtypes)["doc_id"]
    found = keyed.join(by_text, ["k", "l"], "left").select("doc_id", "bytes", "spans")
    return found.mapInArrow(_remove, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("kept")

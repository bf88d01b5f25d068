"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked at a few differing bits, candidates pruned by the pigeonring principle.

A fingerprint is a ring of four 16-bit segments.  If two differ in at most 3 bits, some start on the ring has 0 differing
bits in its first segment, at most 1 over two, at most 2 over three and at most 3 over all four (budgets in proportion,
3/4 of a bit a segment).  So a pair meets under the 32-bit key (start, first segment, second segment up to one bit).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fresh, sized, table
from .components import connected

SHINGLE = 3
MAX_BITS = 3
SEED = 42
SEGMENTS, WIDTH = 4, 16
#: Keys with more members than this are divided by a third segment before they are gathered.
GATHER = 128
AT_ONCE = 1 << 16


def fingerprint(text: str | None, words_per_shingle: int = SHINGLE) -> int:
    """The fingerprint of a whole text; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - words_per_shingle + 1)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    begins = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    ends = (begins + sizes)[min(words_per_shingle, len(words)) - 1 :]
    counts, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for i in range(0, n, AT_ONCE):
        spans = zip(begins[i : min(n, i + AT_ONCE)].tolist(), ends[i : i + AT_ONCE].tolist(), strict=False)
        hashes = np.array([digest(joined[b:e], SEED) for b, e in spans], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = np.fromiter((fingerprint(t.as_py()) for t in batch.column(1)), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64)), batch.column(2)], ["doc_id", "fp", "text_hash"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, text_hash), one row per row of docs; fp holds the unsigned value's bits."""
    rows = docs.select(F.col("doc_id"), F.col("text").cast("string"), F.xxhash64("text").alias("text_hash"))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(_fingerprints, f"doc_id {kind}, fp long, text_hash long")


def segment(fp: np.ndarray, k: int) -> np.ndarray:
    return fp >> np.uint64(WIDTH * (k % SEGMENTS)) & np.uint64(0xFFFF)


def _variants(value: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(rows, value, cleared): value as it is, and with each of its set bits cleared.  Values that differ in one bit meet once."""
    yield np.arange(len(value)), value, False
    for k in range(WIDTH):
        bit = np.uint64(1 << k)
        rows = np.flatnonzero(value & bit)
        yield rows, value[rows] ^ bit, True


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = batch.column(0).to_numpy().view(np.uint64)
        for start in range(SEGMENTS):
            first, second = segment(fp, start), segment(fp, start + 1)
            for rows, value, cleared in _variants(second):
                key = np.uint64(start << 32) | first[rows] << np.uint64(WIDTH) | value
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(fp[rows].view(np.int64)), pa.array(np.full(len(rows), cleared))], ["key", "fp", "cleared"])


def _subkeys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Under a key, the two segments left differ in 3 bits at most: one of them in 1 at most.  sub has which, and its variant."""
    for batch in batches:
        key, fp = (batch.column(k).to_numpy().view(np.uint64) for k in (0, 1))
        start, cleared = (key >> np.uint64(32)).astype(np.int64), batch.column(2).to_numpy(zero_copy_only=False)
        for which in (2, 3):
            third = fp >> (np.uint64(WIDTH) * ((start + which) % SEGMENTS).astype(np.uint64)) & np.uint64(0xFFFF)
            for rows, value, again in _variants(third):
                sub = np.uint64(which << WIDTH) | value
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[rows].view(np.int64)), pa.array(sub.view(np.int64)), pa.array(fp[rows].view(np.int64)), pa.array(2 * cleared[rows] + again, pa.int64())],
                    ["key", "sub", "fp", "kind"],
                )


def _spread(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest label that each position reaches over the links a-b."""
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def _pairs(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, a, b): the places of all pairs within groups that lie one after the other; for small groups only."""
    begin = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(owner)) - begin[owner]
    a = np.repeat(np.arange(len(owner)), place)
    b = begin[owner[a]] + np.arange(len(a)) - np.repeat(np.cumsum(place) - place, place)
    return owner[a], a, b


def _stars(fp: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """A row from each linked member to the first one of its group, not a row for each link."""
    low = _spread(np.arange(len(fp)), a, b)
    moved = np.flatnonzero(fp != fp[low])
    return pa.RecordBatch.from_arrays([pa.array(fp[moved].view(np.int64)), pa.array(fp[low[moved]].view(np.int64))], ["a", "b"])


def chained(difference: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Whether differing bits stay within proportional budgets over the chain of segments that begins at start."""
    total, fits = np.zeros(len(difference), np.uint8), np.ones(len(difference), bool)
    for step in range(SEGMENTS):
        shift = np.uint64(WIDTH) * ((start + step) % SEGMENTS).astype(np.uint64)
        total = total + np.bitwise_count(difference >> shift & np.uint64(0xFFFF))
        fits &= total <= (step + 1) * MAX_BITS // SEGMENTS
    return fits


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs under a key are held against the chain of budgets, then the full distance."""
    for batch in batches:
        for i in range(0, batch.num_rows, 1024):
            part = batch.slice(i, 1024)
            start = (part.column(0).to_numpy().view(np.uint64) >> np.uint64(32)).astype(np.int64)
            fp = part.column(1).flatten().to_numpy().view(np.uint64)
            cleared = part.column(2).flatten().to_numpy(zero_copy_only=False)
            group, a, b = _pairs(np.diff(part.column(1).offsets.to_numpy()))
            near = (fp[a] != fp[b]) & ~(cleared[a] & cleared[b])
            total = np.zeros(len(a), np.uint8)
            for step in range(SEGMENTS):
                group, a, b, total = group[near], a[near], b[near], total[near]
                shift = np.uint64(WIDTH) * ((start[group] + step) % SEGMENTS).astype(np.uint64)
                total = total + np.bitwise_count((fp[a] ^ fp[b]) >> shift & np.uint64(0xFFFF))
                near = total <= (step + 1) * MAX_BITS // SEGMENTS
            a, b = a[near], b[near]
            whole = np.bitwise_count(fp[a] ^ fp[b]) <= MAX_BITS
            yield _stars(fp, a[whole], b[whole])


#: Under a subkey: pairs of kinds (bit 1: cleared in the second segment, bit 0: cleared in the third) and the bits left for the last segment.
KINDS = [(0, 0, 3), (0, 1, 2), (0, 2, 2), (0, 3, 1), (1, 2, 1)]
MASKS = {n: np.array([sum(1 << k for k in c) for m in range(n + 1) for c in combinations(range(WIDTH), m)], np.int64) for n in (1, 2, 3)}


def _sublinks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Under a subkey only the last 16 bits are open, so a group has at most 4 x 65,536 members: in the larger ones neighbours are looked up, not paired."""
    for batch in batches:
        sizes = np.diff(batch.column(2).offsets.to_numpy())
        for i in range(0, batch.num_rows, 1024):
            few = batch.slice(i, 1024).filter(pa.array(sizes[i : i + 1024] <= GATHER))
            fp, kind = few.column(2).flatten().to_numpy().view(np.uint64), few.column(3).flatten().to_numpy()
            start = few.column(0).to_numpy().view(np.uint64) >> np.uint64(32)
            group, a, b = _pairs(np.diff(few.column(2).offsets.to_numpy()))
            near = (kind[a] & kind[b] == 0) & chained(fp[a] ^ fp[b], start[group].astype(np.int64))
            near &= np.bitwise_count(fp[a] ^ fp[b]) <= MAX_BITS
            yield _stars(fp, a[near], b[near])
        for row in np.flatnonzero(sizes > GATHER):
            start, which = batch.column(0)[row].as_py() >> 32, batch.column(1)[row].as_py() >> WIDTH
            fp = batch.column(2)[row].values.to_numpy().view(np.uint64)
            yield _looked_up(fp, segment(fp, start + 5 - which).astype(np.int64), batch.column(3)[row].values.to_numpy())


def _looked_up(fp: np.ndarray, rest: np.ndarray, kind: np.ndarray) -> pa.RecordBatch:
    label, at = np.arange(len(fp)), {k: np.flatnonzero(kind == k) for k in range(4)}
    while True:
        new = label.copy()
        for p, q, bits in KINDS:
            for x, y in {(p, q), (q, p)}:
                if len(at[x]) and len(at[y]):
                    lowest = np.full(1 << WIDTH, len(fp))
                    np.minimum.at(lowest, rest[at[y]], label[at[y]])
                    for mask in MASKS[bits]:
                        new[at[x]] = np.minimum(new[at[x]], lowest[rest[at[x]] ^ mask])
        new = np.minimum(new, new[new])
        if (new == label).all():
            return _stars(fp, np.arange(len(fp)), label)
        label = new


def link(distinct: DataFrame, gather: int = GATHER) -> DataFrame:
    """Links (a, b) between different fingerprints (fp, no repeats) that connect just those which differ in 3 bits at most, directly or over others.

    Keys are counted before members are gathered.  Small groups are compared pair by pair inside a task, which emits one
    row per member at most; larger ones are first divided by a third segment, so that no group can exceed 4 x 65,536.
    """
    keyed = distinct.select("fp").mapInArrow(_keys, "key long, fp long, cleared boolean")
    counted = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("cleared").alias("all_cleared")).filter("n > 1 and not all_cleared")
    members = cut(keyed.join(counted.select("key", "n"), "key"))
    few = members.filter(F.col("n") <= gather).groupBy("key").agg(F.collect_list("fp").alias("fps"), F.collect_list("cleared").alias("cleared"))
    links = few.mapInArrow(_links, "a long, b long")
    many = members.filter(F.col("n") > gather).select("key", "fp", "cleared").mapInArrow(_subkeys, "key long, sub long, fp long, kind long")
    subs = many.groupBy("key", "sub").agg(F.collect_list("fp").alias("fps"), F.collect_list("kind").alias("kinds")).filter(F.size("fps") > 1)
    return links.union(subs.mapInArrow(_sublinks, "a long, b long"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, text_hash, root, component_id), one row per row of docs.

    Null and empty texts have fingerprint 0 and are linked like others.  component_id is the smallest doc_id reachable,
    null where every doc_id of the component is null.  Repeated rows share a component.  Other columns of docs are not read.
    """
    marked = cut(fingerprints(docs))
    nodes = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("low")))
    roots = cut(connected(link(nodes)))
    named = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    return marked.join(named.select("fp", "root").join(lowest, "root"), "fp")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one document of each group of near-duplicates: the smallest doc_id, then the smallest hash of the text."""
    return keep_first(docs, near_duplicates(docs))


def keep_first(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs with the first document of each root of found (doc_id, text_hash, root), which has a row per row of docs.

    Null doc_ids come last; of rows that repeat as a whole one stays.  Whatever columns docs has are returned as they are.
    """
    place = lambda: F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("text_hash"))
    found = cut(found.select("root", "doc_id", "text_hash"))
    first = found.groupBy("root").agg(F.min(place()).alias("first"), F.count("*").alias("n")).filter("n > 1")
    several = cut(found.join(first, "root").select("doc_id", "text_hash", (place() == F.col("first")).alias("kept"), "root"))
    gone = several.filter("not kept").select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")).distinct()
    (own,) = fresh([*docs.columns, "gone_id", "gone_hash"], "own_hash")
    left = docs.withColumn(own, F.xxhash64("text"))
    left = left.join(sized(gone), left["doc_id"].eqNullSafe(F.col("gone_id")) & (left[own] == F.col("gone_hash")), "left_anti")
    again = several.filter("kept").groupBy("root").agg(F.count("*").alias("n")).filter("n > 1")
    if not again.isEmpty():  # whole rows that repeat
        left = left.dropDuplicates(["doc_id", own])
    return left.drop(own)


def op2_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

"""SimHash near-duplicates at a bound on similarity: what simhash.py does, for differences that its keys can't index.

Texts whose five-word shingles have a Jaccard similarity of 0.8 differ in some 15 % of their fingerprint bits, 10 of 64, and no key
of a few whole segments survives that.  So the fingerprint is a wider ring, of eight 16-bit segments, and texts first meet under
a shingle: with all shingles in one order, rare ones first, two sets of similarity t or more share one of the first
n - ceil(t n) + 1 of both.  Pairs that meet go through the pigeonring: somewhere on the ring a chain of consecutive segments begins whose
cumulative differences stay within proportional budgets at every length.  Then comes the full Hamming distance, and for who is left
the similarity of the whole sets.  The budget (see bits_allowed) lies far above what the bound on similarity makes likely.

No group is gathered.  Members of a group are first held against one of them; groups that this leaves in several parts go on, the
members outside the largest part against all, in pairs of blocks that pass through a task in order: first each is linked to the one
most like it, then pairs of what are still different parts are taken, all of them.  There a shingle's place in the order says how many before it the other text lacks, and parities of shingles in buckets how many the two differ in at least: both
are bounds that no pair of the similarity exceeds, and in a family of copies few others are left for the whole sets.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from fractions import Fraction
from math import acos, ceil, pi, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, lean_memory, sized, trim_memory
from .components import connected
from .rolling import Rolling, mixed
from .simhash import SEED, WIDTH, keep_first

SHINGLE, LEAST = 5, 0.8
SEGMENTS = 8
BITS = SEGMENTS * WIDTH
#: Shingles that are counted together, the count there from which one is reported, and how many are put last at most.  They set the
#: order of shingles, and with it the work; the result is the same for any order.
TOGETHER, OFTEN, LISTED = 1_000_000, 4, 200_000
#: Members of a block, as expected, and pairs that are held against each other together.
BLOCK, PAIRS = 2048, 1 << 17
#: Buckets of a parity sketch: a power of two, at least twice the shingles, within these bounds.
FEWEST, MOST = 64, 1 << 16
#: Bytes of text that are cut into words together.
AT_ONCE = 1 << 20
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
NEXT_SPACE = re.compile(rb"[\x20\x09-\x0D]")
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def bits_allowed(least: float) -> int:
    """Bits that fingerprints may differ in: six standard deviations above what is expected at the similarity."""
    share = acos(2 * least / (1 + least)) / pi
    return min(BITS, ceil(BITS * share + 6 * sqrt(BITS * share * (1 - share))))


class Shingler:
    """Distinct hashes, in order, of the word shingles of whole texts; A-Z count as a-z.  None without words, one for fewer words than a shingle has."""

    def __init__(self, words: int = SHINGLE):
        self.words, self.rolling = words, Rolling()

    def _pieces(self, texts: list[bytes]) -> Iterator[tuple[list[int], list[bytes]]]:
        """Texts, and parts of long ones that end between words, up to AT_ONCE bytes together."""
        owners, parts, size = [], [], 0
        for i, text in enumerate(texts):
            at = 0
            while at < len(text):
                end = at + AT_ONCE
                if end < len(text):
                    found = NEXT_SPACE.search(text, end)
                    end = found.start() if found else len(text)
                part = text[at:end]
                at = end
                if parts and size + len(part) > AT_ONCE:
                    yield owners, parts
                    owners, parts, size = [], [], 0
                owners.append(i)
                parts.append(part)
                size += len(part) + 1
        if parts:
            yield owners, parts

    def _words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(place of the text, hash) of each word."""
        owner, found = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for owners, parts in self._pieces(texts):
            data = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
            edges = np.diff((~SPACE[data]).astype(np.int8), prepend=np.int8(0))
            begin, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
            self.rolling.load(data)
            starts = np.cumsum([0, *(len(p) + 1 for p in parts[:-1])])
            owner.append(np.array(owners)[np.searchsorted(starts, begin, "right") - 1])
            found.append(self.rolling.of(begin, end))
        return np.concatenate(owner), np.concatenate(found)

    def _joined(self, words: list[np.ndarray]) -> np.ndarray:
        h = words[0]
        for w in words[1:]:
            h = h * FACTOR + w
        return mixed(h + np.uint64(len(words)))

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        encoded = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
        owner, word = self._words(encoded)
        edge = np.searchsorted(owner, np.arange(len(texts) + 1))
        n = self.words
        whole = self._joined([word[k : max(k, len(word) - n + 1 + k)] for k in range(n)])
        out = []
        for b, e in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            out.append(np.unique(whole[b : e - n + 1]) if e - b >= n else self._joined([word[k : k + 1] for k in range(b, e)]) if e > b else word[:0])
        return out


def fingerprint(shingles: np.ndarray) -> tuple[int, int]:
    """Two halves, signed, of a 128-bit SimHash of a set: a bit is 1 if it is set in over half the hashes."""
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(shingles), 1 << 16):
        h = shingles[i : i + (1 << 16)]
        both = np.stack([h, mixed(h ^ FACTOR)], axis=1)
        counts += np.unpackbits(both.view(np.uint8).reshape(len(h), -1), axis=1, bitorder="little").sum(0, dtype=np.int64)
    low, high = np.packbits(2 * counts > len(shingles), bitorder="little").view("<i8")
    return int(low), int(high)


def parities(shingles: np.ndarray) -> bytes:
    """Bits that say whether a bucket has an odd number of the shingles.  Sets that differ in d shingles differ in d bits at most."""
    size = FEWEST
    while size < min(MOST, 2 * len(shingles)):
        size *= 2
    at = (shingles & np.uint64(size - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=size) & 1, bitorder="little").tobytes()


def parities_apart(data: np.ndarray, start: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Bits that sketches i and j differ in; each has size bytes of data from start.  The larger one's parts are laid over each other first."""
    both, out = np.minimum(size[i], size[j]), np.zeros(len(i), np.int64)

    def laid(which: np.ndarray, small: int) -> np.ndarray:
        rows = np.zeros((len(which), small), np.uint8)
        for large in np.unique(size[which]).tolist():
            at = np.flatnonzero(size[which] == large)
            rows[at] = np.bitwise_xor.reduce(data[start[which[at], None] + np.arange(large)].reshape(len(at), -1, small), axis=1)
        return rows.view(np.uint64)

    for small in np.unique(both).tolist():
        at = np.flatnonzero(both == small)
        for k in range(0, len(at), step := max(1, (1 << 22) // small)):
            part = at[k : k + step]
            out[part] = np.bitwise_count(laid(i[part], small) ^ laid(j[part], small)).sum(1, dtype=np.int64)
    return out


def _often(words: int):
    """(s, times): shingles that many different texts of a task have, counted over all of its texts, a bounded number of shingles at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_memory()
        shingler, held, size, seen = Shingler(words), [], 0, set()

        def counted() -> pa.RecordBatch:
            s, times = np.unique(np.concatenate([np.zeros(0, np.uint64), *held]), return_counts=True)
            many = times >= OFTEN
            return pa.RecordBatch.from_arrays([pa.array(s[many].view(np.int64)), pa.array(times[many])], ["s", "times"])

        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                for shingles in shingler(batch.column(0).slice(i, 256).to_pylist()):
                    key = xxhash.xxh64_intdigest(shingles.tobytes(), SEED)
                    if key not in seen:
                        seen.add(key)
                        held.append(shingles)
                        size += len(shingles)
                    if size >= TOGETHER:
                        yield counted()
                        held, size = [], 0
                        seen.clear()
        yield counted()
        held.clear()
        trim_memory()

    return run


def common_shingles(docs: DataFrame, words: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(shingles in order, their counts): the LISTED that occur most, over all texts; what is rare within every task is left out."""
    counted = docs.select("text").mapInArrow(_often(words), "s long, times long").groupBy("s").agg(F.sum("times").alias("times"))
    found = counted.orderBy(F.desc("times"), "s").limit(LISTED).toArrow()
    s, times = found.column(0).to_numpy().view(np.uint64), found.column(1).to_numpy()
    order = np.argsort(s)
    return s[order], times[order]


def prefix(shingles: np.ndarray, common: tuple[np.ndarray, np.ndarray], least: Fraction) -> np.ndarray:
    """The first n - ceil(least n) + 1 shingles: those that are not common, then the less common ones."""
    n = len(shingles)
    if not n:
        return shingles
    wanted = n + (-n * least.numerator // least.denominator) + 1
    if not len(common[0]):
        return shingles[:wanted]
    at = np.minimum(np.searchsorted(common[0], shingles), len(common[0]) - 1)
    known = common[0][at] == shingles
    rare = shingles[~known]
    if len(rare) >= wanted:
        return rare[:wanted]
    rest, times = shingles[known], common[1][at[known]]
    return np.concatenate((rare, rest[np.lexsort((rest, times))][: wanted - len(rare)]))


def _described(words: int, common: tuple[np.ndarray, np.ndarray], least: Fraction):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_memory()
        shingler, seen = Shingler(words), set()
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                sets = shingler(part.column(1).to_pylist())
                keys = [xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets]
                # A text's copies in a task need no prefix of their own.
                first = [not (k in seen or seen.add(k)) for k in keys]
                prefixes = [prefix(s, common, least).view(np.int64) if f else np.zeros(0, np.int64) for s, f in zip(sets, first, strict=True)]
                prints = [fingerprint(s) for s in sets]
                offsets = np.cumsum([0, *map(len, prefixes)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), part.column(2), pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(np.array([len(s) for s in sets], np.int32)),
                        *(pa.array(np.array([p[k] for p in prints], np.int64)) for k in range(2)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(prefixes))),
                        pa.array([parities(s) for s in sets], pa.binary()),
                    ],
                    ["doc_id", "text_hash", "key", "n", "low", "high", "prefix", "odd"],
                )

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (s, key, at) in order, those whose s has another key as well, once."""
    kinds = np.int64, np.int64, np.int32
    rows = [np.zeros(0, t) for t in kinds]
    matched = False  # whether the row held back has the s of one before it
    batch_of = lambda found: pa.RecordBatch.from_arrays([pa.array(r) for r in found], ["s", "key", "at"])
    for batch in batches:
        rows = [np.concatenate((held, batch.column(i).to_numpy())) for i, held in enumerate(rows)]
        s, k, _ = rows
        if not len(s):
            continue
        new = np.concatenate(([True], (s[1:] != s[:-1]) | (k[1:] != k[:-1])))
        rows = [r[new] for r in rows]
        s = rows[0]
        same = s[1:] == s[:-1]
        found = np.zeros(len(s), bool)
        found[1:] |= same
        found[:-1] |= same
        found[0] |= matched
        yield batch_of([r[:-1][found[:-1]] for r in rows])
        rows, matched = [r[-1:] for r in rows], bool(found[-1])
    if matched:
        yield batch_of(rows)


def within_budgets(low: np.ndarray, high: np.ndarray, most: int) -> np.ndarray:
    """Whether fingerprints with these exclusive ors pass the ring: a chain of segments within proportional budgets, then the whole distance."""
    segments = np.stack([(x >> np.uint64(WIDTH * k)) & np.uint64(0xFFFF) for x in (low, high) for k in range(SEGMENTS // 2)])
    wrong = np.bitwise_count(segments).astype(np.int16)
    chained = np.zeros(len(low), bool)
    for start in range(SEGMENTS):
        total, fits = np.zeros(len(low), np.int16), np.ones(len(low), bool)
        for step in range(SEGMENTS):
            total += wrong[(start + step) % SEGMENTS]
            fits &= SEGMENTS * total <= (step + 1) * most
        chained |= fits
    return chained & (wrong.sum(0) <= most)


def _able(a: np.ndarray, b: np.ndarray, least: Fraction) -> np.ndarray:
    """Whether sets of these sizes can have the similarity."""
    return np.minimum(a, b) * least.denominator >= least.numerator * np.maximum(a, b)


def _near(rows: tuple[np.ndarray, ...], i: np.ndarray, j: np.ndarray, least: Fraction, most: int) -> np.ndarray:
    n, low, high = rows
    out = _able(n[i], n[j], least)
    at = np.flatnonzero(out)
    out[at] = within_budgets(low[i[at]] ^ low[j[at]], high[i[at]] ^ high[j[at]], most)
    return out


def _pair_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def _numbers(batch: pa.RecordBatch, columns: int) -> list[np.ndarray]:
    return [batch.column(k).to_numpy() for k in range(columns)]


def _to_the_first(least: Fraction, most: int):
    """Of rows (s, key, n, low, high) in the order of s and key: each with the first of its s, if the ring lets the pair pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = None
        for batch in batches:
            rows = _numbers(batch, 5)
            if not len(rows[0]):
                continue
            if head is not None:
                rows = [np.concatenate((h, r)) for h, r in zip(head, rows, strict=True)]
            s, key, n, low, high = rows
            begins = np.concatenate(([True], s[1:] != s[:-1]))
            first = np.maximum.accumulate(np.where(begins, np.arange(len(s)), 0))
            rest = np.flatnonzero(~begins)
            near = rest[_near((n.astype(np.int64), low.view(np.uint64), high.view(np.uint64)), first[rest], rest, least, most)]
            yield _pair_batch(key[first[near]], key[near])
            head = [r[first[-1:]] for r in rows]

    return run


def _across(least: Fraction, most: int, nearest: bool):
    """Of rows (s, x, y, key, n, low, high, at, part, few, late, odd) in the order of s, x and y, the members of blocks x and y of a group: pairs
    (s, a, b) of different parts that can have the similarity; nearest: for each of the few only the one that its parities are most alike to.

    late marks the members of y where that is another block.  Where s is the first shingle that two texts share, neither has
    those that come before its place in the other; a pair that s fails for this passes under its first one if it is similar.
    """
    p, q = least.numerator, least.numerator + least.denominator

    def pairs(cells: pa.Table) -> Iterator[pa.RecordBatch]:
        s, x, y, key, n, low, high, at, part, few, late = (cells.column(k).to_numpy() for k in range(11))
        n, low, high = n.astype(np.int64), low.view(np.uint64), high.view(np.uint64)
        begins = np.flatnonzero(_new_cell(s, x, y))
        sizes = np.diff(np.append(begins, len(s)))
        begin, size = np.repeat(begins, sizes), np.repeat(sizes, sizes)
        odd = pa.concat_arrays(cells.column(11).chunks)
        offsets = np.frombuffer(odd.buffers()[1], np.int32)[odd.offset : odd.offset + len(odd) + 1]
        data = np.frombuffer(odd.buffers()[2], np.uint8)
        rows = np.flatnonzero(few)
        group = (np.cumsum(size[rows]) - 1) // PAIRS
        for rows_ in np.split(rows, np.flatnonzero(np.diff(group)) + 1) if len(rows) else []:
            count = size[rows_]
            i = np.repeat(rows_, count)
            j = np.repeat(begin[rows_] - np.cumsum(count) + count, count) + np.arange(len(i))
            ok = (part[i] != part[j]) & ((x[i] == y[i]) | (late[i] != late[j])) & (nearest | ~few[j] | (i < j))
            i, j = i[ok], j[ok]
            ok = q * np.minimum(n[i] - at[i], n[j] - at[j]) >= p * (n[i] + n[j])
            i, j = i[ok], j[ok]
            ok = _near((n, low, high), i, j, least, most)
            i, j = i[ok], j[ok]
            both, apart = n[i] + n[j], parities_apart(data, offsets[:-1], np.diff(offsets), i, j)
            ok = np.flatnonzero(q * (both - apart) >= 2 * p * both)
            if nearest:
                ok = ok[np.lexsort(((apart / both)[ok], i[ok]))]
                ok = ok[np.concatenate(([True], i[ok[1:]] != i[ok[:-1]]))[: len(ok)]]
            yield pa.RecordBatch.from_arrays([pa.array(s[i[ok]]), *_pair_batch(key[i[ok]], key[j[ok]]).columns], ["s", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_memory()
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([*held, batch])
            last = int(np.flatnonzero(_new_cell(*(rows.column(k).to_numpy() for k in range(3))))[-1])
            yield from pairs(rows.slice(0, last))
            held = rows.slice(last).to_batches()
        if held:
            yield from pairs(pa.Table.from_batches(held))

    return run


def _new_cell(s: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether a row begins another pair of blocks than the row before it belongs to."""
    return np.concatenate(([True], (s[1:] != s[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])))[: len(s)]


def _shingles(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_memory()
        shingler, seen = Shingler(words), set()
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                sets = shingler(batch.column(0).slice(i, 256).to_pylist())
                keys = [xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets]
                first = [not (k in seen or seen.add(k)) for k in keys]
                sets, keys = [s.view(np.int64) for s, f in zip(sets, first, strict=True) if f], [k for k, f in zip(keys, first, strict=True) if f]
                offsets = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *sets])))
                yield pa.RecordBatch.from_arrays([pa.array(np.array(keys, np.uint64).view(np.int64)), lists], ["key", "shingles"])

    return run


class _Corpus:
    """Texts, and what is known of them: (key, text_hash, n, low, high, odd), a row for each set of shingles."""

    def __init__(self, texts: DataFrame, marked: DataFrame, words: int, least: Fraction):
        self.texts, self.words, self.least = texts, words, least
        self.nodes = cut(marked.groupBy("key").agg(F.min("text_hash").alias("text_hash"), F.max("n").alias("n"), F.max("low").alias("low"), F.max("high").alias("high"), F.first("odd").alias("odd")))

    def links(self, pairs: DataFrame) -> DataFrame:
        """Those pairs of keys (a, b) whose whole sets have the similarity."""
        wanted = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()
        hashes = cut(self.nodes.join(wanted, "key", "left_semi").select("text_hash").distinct())
        texts = self.texts.join(sized(hashes), "text_hash", "left_semi").select("text")
        sets = cut(texts.mapInArrow(_shingles(self.words), "key long, shingles array<long>").groupBy("key").agg(F.first("shingles").alias("shingles")))
        side = lambda k: sets.select(F.col("key").alias(k), F.col("shingles").alias(f"s_{k}"))
        both = F.size(F.array_intersect("s_a", "s_b"))
        enough = both * (self.least.numerator + self.least.denominator) >= self.least.numerator * (F.size("s_a") + F.size("s_b"))
        return cut(pairs.join(side("a"), "a").join(side("b"), "b").filter(enough).select("a", "b"))


def link(texts: DataFrame, marked: DataFrame, words: int, least: Fraction, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between keys that connect just those whose similarity is least or more, directly or over others.

    texts has text, text_hash; marked has key, text_hash, n, low, high, prefix, odd.
    """
    most, corpus = bits_allowed(float(least)), _Corpus(texts, marked, words, least)
    rows = marked.select("key", F.posexplode("prefix").alias("at", "s")).select("s", "key", "at")
    shared = rows.repartition("s").sortWithinPartitions("s", "key").mapInArrow(_shared, "s long, key long, at int")
    met = cut(shared.join(corpus.nodes.drop("text_hash", "odd"), "key").select("s", "key", "n", "low", "high", "at"))
    first = cut(met.repartition("s").sortWithinPartitions("s", "key").mapInArrow(_to_the_first(least, most), "a long, b long").distinct())
    links, asked, rest = corpus.links(first), first, met
    p, q = least.numerator, least.numerator + least.denominator
    odd = corpus.nodes.select("key", "odd")
    for nearest in (True, False):
        parts = connected(links).select(F.col("node").alias("key"), F.col("root").alias("part"))
        named = cut(rest.join(parts, "key", "left").withColumn("part", F.coalesce("part", "key")))
        groups = named.groupBy("s").agg(F.count("*").alias("m"), F.min("n").alias("shortest"), F.min("part").alias("one"), F.max("part").alias("other")).filter("m > 2 and one <> other")
        largest = named.groupBy("s", "part").agg(F.count("*").alias("m")).groupBy("s").agg(F.max_by("part", F.struct("m", "part")).alias("largest"))
        split = named.join(groups.select("s", "m", "shortest").join(largest, "s"), "s")
        # What is left of a text from its place on must be enough for the shortest of the group.
        outside = split.filter(q * (F.col("n") - F.col("at")) >= p * (F.col("n") + F.col("shortest")).cast("long"))
        blocks = F.ceil(F.col("m") / block).cast("int")
        outside = outside.withColumn("own", F.pmod(F.xxhash64("key"), blocks).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), blocks - 1)))
        x, y = F.least("own", "o"), F.greatest("own", "o")
        cells = outside.join(odd, "key").select(
            "s", x.alias("x"), y.alias("y"), "key", "n", "low", "high", "at", "part", (F.col("part") != F.col("largest")).alias("few"), (F.col("own") != x).alias("late"), "odd"
        )
        pairs = cut(cells.repartition("s", "x", "y").sortWithinPartitions("s", "x", "y").mapInArrow(_across(least, most, nearest), "s long, a long, b long"))
        new = cut(pairs.select("a", "b").distinct().join(asked, ["a", "b"], "left_anti"))
        links, asked = links.union(corpus.links(new)), asked.union(new)
        # Parts only grow together: a group without such a pair now has none later.
        rest = named.select(*met.columns).join(sized(pairs.select("s").distinct()), "s", "left_semi")
    return links


def near_duplicates(docs: DataFrame, words: int = SHINGLE, least: float = LEAST, block: int = BLOCK) -> DataFrame:
    """(doc_id, text_hash, root), one row per row of docs; root is the same for near-duplicates, directly or over others.

    Null, empty and blank texts are alike; a text of fewer words than a shingle has is one shingle.  Texts of any length are read whole.
    Repeated rows share a root, an empty table gives none.  Other columns of docs are not read.
    """
    bound = Fraction(str(least))
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"))
    common = common_shingles(texts, words)
    kinds = f"doc_id {dict(texts.dtypes)['doc_id']}, text_hash long, key long, n int, low long, high long, prefix array<long>, odd binary"
    marked = cut(texts.mapInArrow(_described(words, common, bound), kinds))
    roots = cut(connected(link(texts, marked, words, bound, block)))
    named = marked.select("doc_id", "text_hash", "key").join(roots, F.col("key") == F.col("node"), "left")
    return named.select("doc_id", "text_hash", F.coalesce("root", "key").alias("root"))


def keep_one(docs: DataFrame, words: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """docs with one document of each group of near-duplicates: the smallest doc_id, then the smallest hash of the text; all columns stay."""
    return keep_first(docs, near_duplicates(docs, words, least))

"""Importance resampling towards a target: which documents look most like another set of texts.

Words are hashed into buckets; a bucket's gain is the logarithm of how much more often the target's words fall into it.  A first pass counts buckets, each task
into one array, so that a task sends at most one row for each bucket.  A second pass scores whole documents with the gains, an array of
fixed size.  The draw is the k highest scores with Gumbel noise from a hash of the id.  The k-th key is found exactly by radix selection: digits of the composite key
(score, doc_id, row) are settled one after the other, by counts of at most 2^16 values among rows that share the digits before.  Only rows that are drawn are sorted.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fresh, lean_memory, table
from .places import numbered

BUCKETS, SEED, LEAST_WORDS, PERCENT = 10_000, 2024, 20, 10
#: Bits of a digit: a round counts up to 2^16 values on the driver.
DIGIT = 16
#: Bytes of text that are cut into words together, and words whose buckets a task remembers.
AT_ONCE, REMEMBERED = 1 << 20, 500_000
#: A-Z to a-z; bytes of words stay, which in UTF-8 are 0-9, a-z and all from 0x80 on; others become spaces.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


GAP = re.compile(rb"[^0-9A-Za-z\x80-\xff]")


class _Known(dict):
    """Buckets of features that were met before."""

    def __init__(self, buckets: int):
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        self[feature] = found = zlib.crc32(feature) % self.buckets
        return found


class Hasher:
    """Buckets of all runs of 1 to `longest` consecutive words of a text."""

    def __init__(self, buckets: int, longest: int):
        self.longest, self.known = longest, _Known(buckets)

    def _of(self, features: list[bytes]) -> np.ndarray:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        return np.fromiter(map(self.known.__getitem__, features), np.int32, len(features))

    def pieces(self, text: str | None) -> Iterator[tuple[int, np.ndarray]]:
        """(words, buckets) of parts of a text, cut between words; runs that cross a cut belong to the later part."""
        data, at, tail = (text or "").encode("utf-8", "surrogatepass"), 0, []
        while at < len(data):
            end = at + AT_ONCE
            if end < len(data):
                gap = GAP.search(data, end)
                end = gap.start() if gap else len(data)
            words = data[at:end].translate(FOLD).split()
            at = end
            features = [*words]
            for n in range(2, self.longest + 1):
                both = tail[len(tail) - min(len(tail), n - 1) :] + words
                features += [b" ".join(both[i : i + n]) for i in range(len(both) - n + 1)]
            yield len(words), self._of(features)
            tail = (tail + words)[-(self.longest - 1) :] if self.longest > 1 else []


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, longest: int = 1) -> np.ndarray:
    """Features in each bucket over all texts (column text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_memory()
        hasher, total = Hasher(buckets, longest), np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0):
                for _, found in hasher.pieces(text.as_py()):
                    total += np.bincount(found, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    rows = texts.select(F.col("text").cast("string")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return out


def gains(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """floor(1000 ln(share of the target / share of the raw texts)) of each bucket, every count raised by one."""
    t, s, more = target.tolist(), raw.tolist(), len(raw)
    all_t, all_s = float(sum(t) + more), float(sum(s) + more)
    return np.array([math.floor(1000 * math.log((a + 1) * all_s / ((b + 1) * all_t))) for a, b in zip(t, s, strict=True)], np.int64)


def noise(doc_id: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln u)) for a u in (0, 1) that the id and the seed alone decide."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def scored(docs: DataFrame, gain: np.ndarray, longest: int = 1, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of every row of docs, all but doc_id long."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_memory()
        hasher = Hasher(len(gain), longest)
        for batch in batches:
            rows = np.zeros((batch.num_rows, 3), np.int64)
            for i, text in enumerate(batch.column(1)):
                for words, found in hasher.pieces(text.as_py()):
                    rows[i] += (words, len(found), int(gain[found].sum()))
            n = np.maximum(rows[:, 1], 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x) for x in (rows[:, 0], rows[:, 1], rows[:, 2] // n))], ["doc_id", "n_words", "n_features", "weight"])

    found = docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long")
    return found.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


def first_keys(rows: DataFrame, keys: list[str], k: int) -> Column | None:
    """A condition that k rows meet: those with the k smallest keys, compared column by column.  keys are long, not null, and unique together.

    Each round settles a digit of the k-th key: rows that agree with it so far are counted by their next digit, at most 2^16 counts.  A column's digits
    start below its smallest value, so that only those are counted that the values use, and a round that leaves just the rows still wanted is the last.
    """
    if k <= 0:
        return None
    ends = rows.agg(*(F.min(c).alias(f"lo{i}") for i, c in enumerate(keys)), *(F.max(c).alias(f"hi{i}") for i, c in enumerate(keys)), F.count("*").alias("n")).first()
    if k >= ends["n"]:
        return F.lit(True)
    same, before, wanted = F.lit(True), F.lit(False), k
    for i, c in enumerate(keys):
        low, high = ends[f"lo{i}"], ends[f"hi{i}"]
        bits = F.col(c) - F.lit(low)
        if high - low >= 1 << 63:  # the difference would not fit a long; with the sign turned, bits order as they are
            low, high, bits = -(1 << 63), (1 << 63) - 1, F.col(c).bitwiseXOR(F.lit(-(1 << 63)))
        settled = 0
        for shift in reversed(range(0, max(1, (high - low).bit_length()), DIGIT)):
            digit = F.shiftrightunsigned(bits, shift).bitwiseAND(F.lit((1 << DIGIT) - 1))
            counts = sorted((r["digit"], r["n"]) for r in rows.filter(same).groupBy(digit.alias("digit")).agg(F.count("*").alias("n")).collect())
            for d, n in counts:
                if n >= wanted:
                    break
                wanted -= n
            settled += d << shift
            edge = F.lit(low + settled), F.lit(min(high, low + settled + (1 << shift) - 1))
            before |= same & (F.col(c) < edge[0])
            same &= F.col(c).between(*edge)
            if n == wanted:
                return before | same
    return before | same


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, longest: int = 1, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank for every row of docs (doc_id, text), rank null where it is not drawn.

    percent of the documents with at least least_words words are drawn, rounded down: the highest scores, ties to the smaller doc_id, null ids last, and among
    rows that share an id and a score any.  Null and blank texts have no words; they are never drawn but where least_words is 0.  Texts are read whole, however
    long; an empty table gives no rows, an empty target a table of raw counts against none.  Other columns are not read.
    """
    gain = gains(bucket_counts(target, buckets, longest), bucket_counts(docs, buckets, longest))
    rows = scored(docs, gain, longest, seed).withColumn("row", F.monotonically_increasing_id())
    rows = cut(rows.withColumns({"low": -F.col("score"), "none": F.col("doc_id").isNull().cast("long"), "key": F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long"))}))
    able = F.col("n_words") >= least_words
    eligible = rows.filter(able)
    drawn = first_keys(eligible, ["low", "none", "key", "row"], percent * eligible.count() // 100)
    out = ["doc_id", "n_features", "weight", "score"]
    if drawn is None:
        return rows.select(*out, F.lit(None).cast("long").alias("rank"))
    chosen = numbered(rows.filter(able & drawn), [], ["low", "none", "key", "row"], "place", "total")
    return chosen.select(*out, (F.col("place") + 1).alias("rank")).union(rows.filter(~(able & drawn)).select(*out, F.lit(None).cast("long").alias("rank")))


def draw(docs: DataFrame, target: DataFrame, percent: int = PERCENT, **more) -> DataFrame:
    """The drawn rows of docs with all columns; doc_id must be unique for them to be just those of resample()."""
    (own,) = fresh(docs.columns, "drawn_id")
    ids = resample(docs, target, percent, **more).filter("rank is not null").select(F.col("doc_id").alias(own)).distinct()
    return docs.join(ids, docs["doc_id"].eqNullSafe(F.col(own)), "left_semi")


def op13_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_sql() -> str:
    words = lambda t: f"list_filter(regexp_split_to_array(translate(coalesce({t}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
    return f"""
WITH crc AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, _: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, n)) AS t),
d AS (SELECT doc_id, row_number() OVER () AS r, {words('text')} AS w FROM documents),
raw AS (SELECT word, count(*) AS n FROM (SELECT unnest(w) AS word FROM d) GROUP BY word),
target AS (SELECT word, count(*) AS n FROM (SELECT unnest({words('text')}) AS word FROM benchmark) GROUP BY word),
hashed AS (
  SELECT word, xor(list_reduce(list_transform(range(octet_length(encode(word))), lambda i: CAST('0x' || substr(hex(encode(word)), 2 * i + 1, 2) AS BIGINT)),
         lambda c, b: xor(c // 256, t[CAST(xor(c % 256, b) AS BIGINT) + 1]), 4294967295), 4294967295) % {BUCKETS} AS bucket
  FROM (SELECT word FROM raw UNION SELECT word FROM target), crc),
s AS (SELECT bucket, sum(n) AS s FROM raw JOIN hashed USING (word) GROUP BY bucket),
t AS (SELECT bucket, sum(n) AS t FROM target JOIN hashed USING (word) GROUP BY bucket),
sums AS (SELECT CAST(coalesce((SELECT sum(s) FROM s), 0) AS DOUBLE) AS all_s, CAST(coalesce((SELECT sum(t) FROM t), 0) AS DOUBLE) AS all_t),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1) * (all_s + {BUCKETS}) / ((coalesce(s, 0) + 1) * (all_t + {BUCKETS})))) AS BIGINT) AS gain
  FROM s FULL JOIN t USING (bucket), sums),
weighed AS (
  SELECT r, count(*) AS n, CAST(floor(sum(gain) / count(*)) AS BIGINT) AS weight
  FROM (SELECT r, unnest(w) AS word FROM d) JOIN hashed USING (word) JOIN gains USING (bucket) GROUP BY r),
scored AS (
  SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5) / 4294967296.0))) AS BIGINT) AS score
  FROM d LEFT JOIN weighed USING (r)),
ranked AS (SELECT *, row_number() OVER (ORDER BY n_features < {LEAST_WORDS}, score DESC, doc_id NULLS LAST) AS place FROM scored)
SELECT doc_id, n_features, weight, score,
       CASE WHEN n_features >= {LEAST_WORDS} AND place <= {PERCENT} * (SELECT count(*) FROM scored WHERE n_features >= {LEAST_WORDS}) // 100 THEN place END AS rank
FROM ranked"""

"""Benchmark decontamination by winnowing: built-in functions only.

Texts become sequences of word hashes, then of hashes of GRAM words.  Winnowing keeps the smallest GRAM hash of every
window of WINDOW - GRAM + 1 of them, so two texts that share WINDOW consecutive words keep a common fingerprint there.
Fingerprints of documents meet those of the benchmark; around each that is met, the windows of WINDOW words that hold it are
looked up.  Items of fewer words are one window each and are looked up by the lengths that occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, cut, fresh, let, sized, table

#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+, said by what it has: the ranges are tried in order, and most letters are in the first.
WORDS = r"[a-z0-9\x{80}-\x{10FFFF}]+"
#: The same words before A-Z become lower case.
ANY_CASE = r"[a-z0-9A-Z\x{80}-\x{10FFFF}]+"
WINDOW, GRAM = 10, 5
#: Bits of a number that hold a word's place; no array can have more words.
PLACE_BITS = 31


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(ANY_CASE)), F.lit(0)).cast("long")


def words_of(text: Column) -> Column:
    """The words of a text in order; null texts have none."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORDS), F.lit(0))


def run_hashes(words: Column, n: int) -> Column:
    """64-bit hashes of n consecutive words, at each place where they fit."""
    places = F.sequence(F.lit(1), F.size(words) - (n - 1))
    return F.when(F.size(words) >= n, F.transform(places, lambda i: F.xxhash64(F.slice(words, i, n)))).otherwise(F.array().cast("array<bigint>"))


def of_size(n: int):
    return lambda words: run_hashes(words, n)


def window_hash(grams: Column, i: Column) -> Column:
    """The hash of the WINDOW words from i on: of the GRAM words at its start and those at its end; null past either end."""
    both = F.xxhash64(F.get(grams, i), F.get(grams, i + (WINDOW - GRAM)))
    return F.when((i >= 0) & (i + (WINDOW - GRAM) < F.size(grams)), both)


def winnowed(grams: Column) -> Column:
    """Distinct places of the smallest GRAM hash of each window, the first of equals; empty below WINDOW words.

    A hash's upper 33 bits and its place make one number, so the smallest of a slice says where it is.  Which of several
    hashes with the same upper bits is kept depends on their order in the window, and so on the window alone.
    """
    wide, place = WINDOW - GRAM + 1, (1 << PLACE_BITS) - 1

    def kept(numbered: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(numbered) - (wide - 1))
        return F.array_distinct(F.transform(starts, lambda i: F.array_min(F.slice(numbered, i, wide)).bitwiseAND(F.lit(place)).cast("int")))

    numbered = F.transform(grams, lambda h, i: h.bitwiseAND(F.lit(-1 - place)).bitwiseOR(i.cast("long")))
    return F.when(F.size(grams) >= wide, let(numbered, kept)).otherwise(F.array().cast("array<int>"))


def fingerprints(words: Column) -> Column:
    """array<struct<h, at, near>>: the winnowed fingerprints, and the GRAM hashes of all windows around each, from place max(0, at - reach)."""
    reach = WINDOW - GRAM

    def found(grams: Column) -> Column:
        def described(at: Column) -> Column:
            first = F.greatest(at - reach, F.lit(0))
            return F.struct(F.get(grams, at).alias("h"), at.alias("at"), F.slice(grams, first + 1, at - first + reach + 1).alias("near"))

        return F.transform(winnowed(grams), described)

    return let(let(words, of_size(GRAM)), found)


def hits(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, text_hash, at, len, item_id): places of document words where a window of an item lies, in words.

    docs has doc_id, text; items item_id, text.  Other columns are not read.
    """
    tests = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), words_of(F.col("text")).alias("words")).filter(F.size("words") > 0).distinct()
    long_items = tests.filter(F.size("words") >= WINDOW).select("item_id", run_hashes(F.col("words"), GRAM).alias("grams"))
    last = F.size("grams") - (WINDOW - GRAM) - 1
    windows = cut(
        long_items.select("item_id", F.explode(F.transform(F.sequence(F.lit(0), last), lambda i: window_hash(F.col("grams"), i))).alias("h"))
        .withColumn("len", F.lit(WINDOW))
        .union(_short_windows(tests))
        .distinct()
    )
    prints = cut(long_items.select(F.explode(F.transform(winnowed(F.col("grams")), lambda at: F.get(F.col("grams"), at))).alias("h")).distinct())
    lengths = [r.len for r in windows.filter(F.col("len") < WINDOW).select("len").distinct().collect()]

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    met = rows.select("doc_id", "text_hash", F.explode(fingerprints(words_of(F.col("text")))).alias("p")).select("doc_id", "text_hash", "p.*")
    near = met.join(sized(prints), "h", "left_semi").withColumn("first", F.greatest(F.col("at") - (WINDOW - GRAM), F.lit(0)))
    starts = F.transform(F.sequence(F.lit(0), F.size("near") - 1), lambda i: window_hash(F.col("near"), i))
    found = near.select("doc_id", "text_hash", "first", F.posexplode(starts).alias("k", "h")).filter("h is not null")
    found = found.select("doc_id", "text_hash", (F.col("first") + F.col("k")).alias("at"), "h", F.lit(WINDOW).alias("len")).distinct()
    for n in sorted(lengths):
        runs = rows.select("doc_id", "text_hash", F.posexplode(let(words_of(F.col("text")), of_size(n))).alias("at", "h"))
        of_length = windows.filter(F.col("len") == n).select("h").distinct()
        found = found.union(runs.join(sized(of_length), "h", "left_semi").select("doc_id", "text_hash", "at", "h", F.lit(n).alias("len")))
    return found.join(sized(windows), ["h", "len"]).select("doc_id", "text_hash", "at", "len", "item_id")


def _short_windows(tests: DataFrame) -> DataFrame:
    """(item_id, h, len) of items of fewer than WINDOW words."""
    short = tests.filter(F.size("words") < WINDOW)
    hashed = F.lit(None).cast("long")
    for n in range(1, WINDOW):
        hashed = F.when(F.size("words") == n, F.get(run_hashes(F.col("words"), n), F.lit(0))).otherwise(hashed)
    return short.select("item_id", hashed.alias("h"), F.size("words").alias("len"))


def _covered(spans: Column) -> Column:
    """Words under a union of (at, len)."""
    step = lambda acc, s: F.struct(
        (acc["n"] + F.greatest(F.lit(0), s["at"] + s["len"] - F.greatest(acc["end"], s["at"]))).cast("int").alias("n"),
        F.greatest(acc["end"], s["at"] + s["len"]).cast("int").alias("end"),
    )
    return F.aggregate(F.sort_array(spans), F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), step, lambda acc: acc["n"]).cast("long")


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs with n_words, n_hit, n_items, items_sha256 and contaminated, which replace columns of those names.

    Null and empty texts have no words and are clean.  Repeated rows are judged alike; items with equal ids count once; a
    null item_id is the empty string.  An empty benchmark leaves everything clean, an empty table stays empty.  Whole texts are
    read, however long.  Other columns of docs are returned as they are, whatever their names.
    """
    found = cut(hits(docs, items).distinct())
    of_doc = ["doc_id", "text_hash"]
    spans = found.select(*of_doc, "at", "len").distinct().groupBy(*of_doc).agg(_covered(F.collect_list(F.struct("at", "len"))).alias("hit"))
    named = found.select(*of_doc, "item_id").distinct().groupBy(*of_doc).agg(F.sort_array(F.collect_list("item_id")).alias("ids"))
    new = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    d = docs.drop(*new)
    own, key, key_hash, hit, items_, sha = fresh([*d.columns, *new], "own_hash", "found_id", "found_hash", "found_hit", "found_items", "found_sha")
    n, m = spans.alias("n"), named.alias("m")
    both = n.join(m, F.col("n.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("n.text_hash") == F.col("m.text_hash"))).select(
        F.col("n.doc_id").alias(key), F.col("n.text_hash").alias(key_hash), F.col("hit").alias(hit), F.size("ids").cast("long").alias(items_), F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias(sha)
    )
    d = d.withColumn(own, F.xxhash64("text"))
    left = d.join(sized(cut(both)), d["doc_id"].eqNullSafe(F.col(key)) & (d[own] == F.col(key_hash)), "left")
    values = {
        "n_words": count_words(F.col("text")),
        "n_hit": F.coalesce(hit, F.lit(0).cast("long")),
        "n_items": F.coalesce(items_, F.lit(0).cast("long")),
        "items_sha256": F.coalesce(sha, F.sha2(F.lit("").cast("binary"), 256)),
        "contaminated": F.col(hit).isNotNull(),
    }
    return left.withColumns(values).drop(own, key, key_hash, hit, items_, sha)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op9_sql() -> str:
    """The definition, in DuckDB SQL: windows as joined words, looked up at every place of every document."""
    words = lambda t: f"list_filter(regexp_split_to_array(translate(coalesce({t}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
    return f"""
WITH items AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, {words('text')} AS w FROM benchmark),
wins AS (
  SELECT DISTINCT item_id, CASE WHEN len(w) < {WINDOW} THEN len(w) ELSE {WINDOW} END AS n,
         array_to_string(w[i:i + CASE WHEN len(w) < {WINDOW} THEN len(w) ELSE {WINDOW} END - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - {WINDOW - 1}))) AS i FROM items WHERE len(w) > 0)),
docs AS (SELECT doc_id, {words('text')} AS w FROM documents),
sizes AS (SELECT DISTINCT n FROM wins),
places AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM docs, sizes WHERE len(w) >= n)),
hits AS (SELECT p.doc_id, p.i, p.n, wins.item_id FROM places p JOIN wins ON wins.n = p.n AND wins.s = p.s),
covered AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS k FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(m.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(m.ids, '')) AS items_sha256, c.n_hit IS NOT NULL AS contaminated
FROM docs d LEFT JOIN covered c USING (doc_id) LEFT JOIN named m USING (doc_id)"""

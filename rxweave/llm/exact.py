"""Exact duplicates by a tree of merges over sorted runs of digests.

A task that reads documents keeps one row for each normalised text: how many rows have it, and the best of them.  That is its run, put in order by
(slot, digest) and combined before anything moves.  Runs are then merged in rounds, FAN of them at a time: tasks are numbered in base FAN, and round r
lets those whose numbers differ in digit r only exchange their runs, each taking the digests whose own digit r is theirs.  So the load stays as even as digests are,
after the last round every digest is in one run, and a text that a third of all rows have is FAN rows to any merge.
The aggregates hold a struct, so that Spark plans each round as sort, partial merge, exchange, sort, merge.  Texts themselves never move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CHARS, cut, fresh, sized, table

#: Runs that one round merges into one.
FAN = 16


def without_space(text: Column) -> Column:
    for c in SPACE_CHARS:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def digests(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, row (unique), origin (the task that read it), chars, text_hash, and digest, proof, bytes of the normalised text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    read = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.length(text).alias("chars"), without_space(text).alias("plain"))
    seen = read.select(
        "doc_id", "chars", F.unhex(F.sha2(F.col("plain").cast("binary"), 256)).alias("digest"), F.xxhash64("plain").alias("proof"), F.octet_length("plain").alias("bytes"),
        F.xxhash64("text").alias("text_hash"), F.monotonically_increasing_id().alias("row"),
    )
    return cut(seen.withColumn("origin", F.shiftright("row", 33).cast("int")))


#: What makes two texts equal: the digest, verified by an independent hash and the length at every merge.
SAME = ("digest", "proof", "bytes")


def merged(rows: DataFrame, fan: int = FAN) -> DataFrame:
    """(digest, proof, bytes, n, best) for each normalised text of digests(): its rows, and the one that stays, as (shorter, none, doc_id, row)."""
    tasks, rounds = (rows.agg(F.max("origin")).first()[0] or 0) + 1, 1
    while fan**rounds < tasks:
        rounds += 1
    best = F.struct((-F.col("chars")).alias("shorter"), F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    runs = rows.select("origin", *SAME, F.lit(1).cast("long").alias("n"), best.alias("best")).withColumn("slot", F.col("origin"))
    for r in range(rounds):
        # Digits up to r are the digest's, those above still the task's.
        taken = F.pmod("proof", F.lit(fan ** (r + 1)).cast("long"))
        slot = (F.floor(F.col("slot") / fan ** (r + 1)) * fan ** (r + 1) + taken).cast("long")
        runs = runs.withColumn("slot", slot).groupBy("slot", *SAME).agg(F.sum("n").alias("n"), F.min("best").alias("best"))
    return runs.drop("slot")


def duplicates(docs: DataFrame, fan: int = FAN) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, row, text_hash, digest (binary), keep_id, group_size, kept.

    Texts are equal if they are after white space is deleted; null, empty and blank texts are.  The row with the most code points stays,
    then the smallest doc_id (null ids come last), and of rows that repeat as a whole any one; its keep_id is null if its doc_id is.
    An empty table gives no rows, columns other than doc_id and text are not read.  Texts of any length are digested whole.
    """
    rows = digests(docs)
    groups = cut(merged(rows, fan).filter("n > 1"))
    # Back to the runs first, where a text is one row a task, and from there to rows: no key of a join has more of them than a task reads.
    runs = rows.select("origin", *SAME).distinct()
    told = cut(runs.join(groups, list(SAME)))
    found = rows.join(told, ["origin", *SAME], "left")
    one = F.col("n").isNull()
    return found.select(
        "doc_id", "row", "text_hash", "digest", F.when(one, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1).cast("long")).alias("group_size"), (one | (F.col("row") == F.col("best.row"))).alias("kept"),
    )


def drop_duplicates(docs: DataFrame, fan: int = FAN) -> DataFrame:
    """docs without the rows that do not stay, all columns as they are; see duplicates()."""
    own, gone_id, gone_hash = fresh(docs.columns, "own_hash", "gone_id", "gone_hash")
    found = cut(duplicates(docs, fan).filter("group_size > 1").select(F.col("doc_id").alias(gone_id), F.col("text_hash").alias(gone_hash), "kept"))
    # Rows are known by doc_id and text here: row numbers need not be the same when docs is read again.
    by_row = found.groupBy(gone_id, gone_hash).agg(F.bool_or("kept").alias("kept"), F.count("*").alias("n"))
    by_row = cut(by_row.filter("not kept or n > 1"))
    left = docs.withColumn(own, F.xxhash64(F.col("text").cast("string")))
    same = left["doc_id"].eqNullSafe(F.col(gone_id)) & (left[own] == F.col(gone_hash))
    keys = lambda only: sized(by_row.filter(only).select(gone_id, gone_hash))
    out = left.join(keys("true"), same, "left_anti")
    if not by_row.filter("kept").isEmpty():  # rows that repeat as a whole
        out = out.union(left.join(keys("kept"), same, "left_semi").dropDuplicates(["doc_id", own]))
    return out.drop(own)


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op12_sql() -> str:
    return """
WITH plain AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
ranked AS (
  SELECT *, row_number() OVER w AS place, first(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM plain WINDOW w AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM ranked"""

"""Logs that are only added to: each entry hashes the one before it and itself, so that a later change shows."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Files, written

# The hash before the first entry, the actions, and the reasons of an override.
GENESIS = "0" * 64
ACTIONS = ("confirm", "override", "correct")
REASONS = ("not_clinically_relevant", "already_managed", "extraction_error", "intended_change", "other")


def canonical(fields: dict[str, Column]) -> Column:
    """A JSON object with sorted keys, a blank after commas and colons, nulls, and characters as they are."""
    def value(c: Column) -> Column:
        text = c.cast("string")
        escaped = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), '"', r'\\"'), "\n", r"\\n"), "\t", r"\\t")
        return F.coalesce(F.concat(F.lit('"'), escaped, F.lit('"')), F.lit("null"))

    parts = [F.concat(F.lit(f'"{k}": '), value(c)) for k, c in sorted(fields.items())]
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def row_hash(previous: Column, payload: Column) -> Column:
    return F.sha2(F.concat(previous, payload).cast("binary"), 256)


def refused(action: Column, reviewer: Column, reason: Column, comment: Column) -> Column:
    """Why a decision can't be taken into a log; null if it can."""
    blank = lambda c: F.btrim(F.coalesce(c, F.lit(""))) == ""
    return (
        F.when(~F.coalesce(action.isin(*ACTIONS), F.lit(False)), "unknown action").when(blank(reviewer), "no reviewer")
        .when((action == "override") & ~F.coalesce(reason.isin(*REASONS), F.lit(False)), "an override needs a reason")
        .when((action == "override") & (reason == "other") & blank(comment), "the reason 'other' needs a comment")
    )


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (log, id, ts, payload, head) in the order of log and id, with hashes; only the last log and its hash are carried from batch to batch."""
    log, head = object(), GENESIS
    for batch in batches:
        before, own = [], []
        for name, payload, start in zip(*(batch.column(k).to_pylist() for k in (0, 3, 4)), strict=True):
            if name != log:
                log, head = name, start or GENESIS
            before.append(head)
            head = hashlib.sha256((head + (payload or "")).encode("utf-8", "surrogatepass")).hexdigest()
            own.append(head)
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(before, pa.string()), pa.array(own, pa.string())], ["log", "id", "ts", "payload", "prev_hash", "row_hash"])


def signed(entries: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """entries (log, id, ts, payload) with prev_hash and row_hash, chained by id within each log, from the log's head (log, head) if it has one.

    A chain is one entry after the other by nature: a log's new entries pass one task in order, as a stream, and nothing of them is gathered; logs go
    in parallel.  A null payload counts as empty.
    """
    kind = dict(entries.dtypes)["log"]
    rows = entries.select("log", F.col("id").cast("long"), F.col("ts").cast("timestamp_ntz"), "payload")
    rows = rows.join(heads.select("log", "head"), "log", "left") if heads is not None else rows.withColumn("head", F.lit(None).cast("string"))
    schema = f"log {kind}, id long, ts timestamp_ntz, payload string, prev_hash string, row_hash string"
    return rows.repartition("log").sortWithinPartitions("log", "id").mapInArrow(_chained, schema)


def heads(log: DataFrame) -> DataFrame:
    """(log, n, head): number of entries and last hash of each log."""
    return log.groupBy("log").agg(F.count("*").alias("n"), F.max_by("row_hash", "id").alias("head"))


def verified(log: DataFrame, anchors: DataFrame | None = None) -> DataFrame:
    """(log, n, first_bad): the first entry whose previous hash, own hash or time is wrong; null for intact logs.

    anchors (log, n, head), kept apart, also show entries that were cut off the end: the entry after the last is then bad.
    """
    w = Window.partitionBy("log").orderBy("id")
    previous = F.lag("row_hash", 1, GENESIS).over(w)
    bad = (F.col("prev_hash") != previous) | (F.col("row_hash") != row_hash(F.col("prev_hash"), F.coalesce("payload", F.lit("")))) | F.coalesce(F.col("ts") < F.lag("ts").over(w), F.lit(False))
    found = log.withColumn("bad", F.when(bad, F.col("id"))).groupBy("log").agg(F.count("*").alias("n"), F.min("bad").alias("first_bad"), F.max("id").alias("last"), F.max_by("row_hash", "id").alias("head"))
    if anchors is not None:
        kept = anchors.select("log", F.col("n").alias("kept_n"), F.col("head").alias("kept_head"))
        found = found.join(kept, "log", "full_outer")
        cut = F.col("kept_n").isNotNull() & ~(F.col("n").eqNullSafe(F.col("kept_n")) & F.col("head").eqNullSafe(F.col("kept_head")))
        found = found.withColumn("first_bad", F.coalesce("first_bad", F.when(cut, F.coalesce(F.col("last") + 1, F.lit(1)))))
    return found.select("log", F.coalesce("n", F.lit(0)).alias("n"), "first_bad")


def recover(spark: SparkSession, folder: str) -> None:
    """Finish commits that were decided but not carried out: their files go where they belong.  Staged files without a commit stay unseen."""
    files = Files(spark, folder)
    staged = set(files.names("staging"))
    if not staged or not files.names("commits"):
        return
    for r in spark.read.schema("token string, entries array<string>, anchors array<string>").json(f"{folder}/commits").filter(F.col("token").isin(*staged)).collect():
        for kind in ("entries", "anchors"):
            there = set(files.names(f"staging/{r.token}/{kind}"))
            for name in r[kind]:
                if name in there:
                    files.move(f"staging/{r.token}/{kind}/{name}", f"{kind}/{name}")
        files.system.delete(files.path(f"staging/{r.token}"), True)


def append(new: DataFrame, folder: str, writer: str | None = None, batch: int | None = None) -> bool:
    """Add entries (log, id, ts, payload) to the logs in folder, after these are verified against their anchors; nothing there is ever changed.

    Exactly once: entries and anchors are staged, then one file, whose name only one writer can take, decides that they belong to the log, then they are
    moved.  Whoever stops before that file has added nothing; whoever stops after it is finished by the next append or by recover().  A batch that its
    writer has added before is not added again: False is returned.  Two writers at once can't both commit on the same state: the later one gets an error and has
    added nothing.  Entries come as further files, anchors as a further set of rows, of which the longest of a log counts.
    """
    spark, files = new.sparkSession, Files(new.sparkSession, folder)
    recover(spark, folder)
    done = files.names("commits")
    if writer is not None and done:
        known = spark.read.schema("writer string, batch long").json(f"{folder}/commits")
        if not known.filter((F.col("writer") == writer) & (F.col("batch") == batch)).isEmpty():
            return False
    before = None
    if files.exists("entries"):
        log = spark.read.parquet(f"{folder}/entries")
        anchors = spark.read.parquet(f"{folder}/anchors").groupBy("log").agg(F.max("n").alias("n"), F.max_by("head", "n").alias("head"))
        broken = verified(log, anchors).filter("first_bad is not null").limit(1).collect()
        if broken:
            raise ValueError(f"log {broken[0].log} fails at entry {broken[0].first_bad}; nothing is added to a broken log")
        before = written(heads(log))
    token = uuid.uuid4().hex
    added = written(signed(new, before.select("log", "head") if before is not None else None))
    added.write.parquet(f"{folder}/staging/{token}/entries")
    now = heads(added)
    if before is not None:
        now = now.join(before.select("log", F.col("n").alias("was")), "log", "left").select("log", (F.col("n") + F.coalesce("was", F.lit(0))).alias("n"), "head")
    now.write.parquet(f"{folder}/staging/{token}/anchors")
    commit = {"token": token, "writer": writer, "batch": batch, **{kind: [n for n in files.names(f"staging/{token}/{kind}") if n.endswith(".parquet")] for kind in ("entries", "anchors")}}
    files.write(f"staging/{token}/commit.json", json.dumps(commit))
    files.move(f"staging/{token}/commit.json", f"commits/{len(done):012d}.json")
    recover(spark, folder)
    return True

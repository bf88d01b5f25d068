"""Corrections by reviewers: appended with their lists as JSON, read back decoded.  They go through the signed logs, one log for each reviewer, so appends are made once and changes show."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import logs

FIELDS = "note_hash string, original string, corrected string, reviewer string, case_id string, note_text string"


def record(rows: DataFrame, folder: str, writer: str | None = None, batch: int | None = None) -> bool:
    """Append corrections (id, ts, note_hash, original, corrected, reviewer, case_id, note_text); false if the batch was appended before.

    original and corrected may be JSON or arrays of structs, which are encoded.  A row without a reviewer or a note hash is an error, and nothing is appended then.
    """
    blank = lambda c: F.btrim(F.coalesce(F.col(c), F.lit(""))) == ""
    bad = rows.filter(blank("reviewer") | blank("note_hash")).limit(1).collect()
    if bad:
        raise ValueError(f"correction {bad[0].id} needs a reviewer and a note hash")
    lists = {c: rows[c] if kind == "string" else F.to_json(c) for c, kind in rows.dtypes if c in ("original", "corrected")}
    rows = rows.withColumns({**lists, "reviewer": F.btrim("reviewer")})
    payload = F.to_json(F.struct(*(f.split(" ")[0] for f in FIELDS.split(", "))), {"ignoreNullFields": "false"})
    return logs.append(rows.select(F.col("reviewer").alias("log"), F.col("id").cast("long").alias("id"), F.col("ts").cast("timestamp_ntz").alias("ts"), payload.alias("payload")), folder, writer, batch)


def entries(spark: SparkSession, folder: str, medication: str) -> DataFrame:
    """All corrections with their lists as arrays of the struct that medication describes, such as 'raw string, status string'."""
    log = spark.read.parquet(f"{folder}/entries").select("id", "ts", F.from_json("payload", FIELDS).alias("p")).select("id", "ts", "p.*")
    kind = f"array<struct<{', '.join(f.strip().replace(' ', ':', 1) for f in medication.split(','))}>>"
    return log.withColumns({c: F.from_json(c, kind) for c in ("original", "corrected")})


def latest(found: DataFrame) -> DataFrame:
    """The newest correction of each note; pre-aggregated before it is shuffled."""
    rest = [c for c in found.columns if c != "note_hash"]
    return found.groupBy("note_hash").agg(F.max_by(F.struct(*rest), "id").alias("r")).select("note_hash", "r.*")

"""Queries: what is written and read back: lexicons as documents, corrections as an appended log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import corrections as C
from ..operators.shared import new_folder
from ..sources import store
from ..sources.tables import table
from .registry import query


@query("SELECT p_type AS surface, string_agg(DISTINCT p_name, '|' ORDER BY p_name) AS targets, count(DISTINCT p_name) AS n FROM part GROUP BY p_type")
def q_lexicon_reload(spark, d):
    """A lexicon, surfaces with the names that they stand for, saved as a document and loaded again."""
    rows = table(spark, d, "part").groupBy(F.col("p_type").alias("surface")).agg(F.sort_array(F.collect_set("p_name")).alias("targets"))
    folder = new_folder(spark, "lexicon")
    store.save_document(rows, folder)
    return store.load_document(spark, folder).select("surface", F.array_join("targets", "|").alias("targets"), F.size("targets").cast("long").alias("n"))


SQL_CORRECTIONS = """c AS (SELECT event_id AS id, ts, md5(user_id::VARCHAR) AS note_hash, 'r' || (user_id % 7) AS reviewer, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE event_type = 'signup')"""


@query(f"WITH {SQL_CORRECTIONS}, n AS (SELECT count(*) AS n FROM c) SELECT note_hash, max(id) AS id, max_by(reviewer, id) AS reviewer, 'drug ' || max_by(k, id) AS raw, 'held' AS status, n FROM c, n GROUP BY note_hash, n")
def q_corrections(spark, d):
    """Corrections appended in two batches, the second one twice, and the newest of each note as it is read back."""
    e = table(spark, d, "events").filter("event_type = 'signup'")
    k = F.from_json("props", "k int")["k"].cast("string")
    meds = lambda status: F.array(F.struct(F.concat(F.lit("drug "), k).alias("raw"), F.lit(status).alias("status")))
    rows = e.select(
        F.col("event_id").alias("id"), "ts", F.md5(F.col("user_id").cast("string").cast("binary")).alias("note_hash"), meds("active").alias("original"), meds("held").alias("corrected"),
        F.concat(F.lit(" r"), (F.col("user_id") % 7).cast("string")).alias("reviewer"), F.lit(None).cast("string").alias("case_id"), F.lit(None).cast("string").alias("note_text"),
    )
    folder, middle = new_folder(spark, "corrections"), e.agg(F.percentile_approx("event_id", F.lit(0.5))).first()[0] or 0
    C.record(rows.filter(F.col("id") <= middle), folder, "load", 0)
    for _ in range(2):
        C.record(rows.filter(F.col("id") > middle), folder, "load", 1)
    found = C.entries(spark, folder, "raw string, status string")
    n = found.count()
    return C.latest(found).select("note_hash", "id", "reviewer", F.col("corrected")[0]["raw"].alias("raw"), F.col("corrected")[0]["status"].alias("status"), F.lit(n).cast("long").alias("n"))

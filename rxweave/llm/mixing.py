"""Mixing sources to target weights: capped water-filling and seeded sampling of whole documents.

Everything here is DataFrame built-ins.  The corpus is read once for (document, size); after that only a table of one row
per source, and one of one row per source and hash bucket, are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, cut, fresh, table

MAX_EPOCHS = 3
SEED = 17
#: Keys of the bucket of a source that is sorted, as expected at most, and hex digits of a bucket at least.
BUCKET_ROWS, LEAST_DIGITS = 20_000, 3


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sampling_key(doc_id: Column, seed: int) -> Column:
    """A document's place in its source's random order.  Rows that share a doc_id share it, and are taken together."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def water_fill(sources: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Add weight and target to a table (source, source_size) with one row per source.

    Weights 1, 2, 3 repeat over the sources by code point, null last.  Clamping sources at max_epochs times their size and
    resharing the excess by weight until none is above ends at one water level: with sources ordered by cap over weight,
    those before the first whose share of what is left fits below its cap are clamped and the rest share by weight.
    Sources without words get target 0.  The windows run over one row per source in one task, which is fine for as many sources
    as a mix has weights; they never run over documents.
    """
    everything = Window.partitionBy()
    numbered = sources.withColumn(
        "weight", (1 + (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % 3).cast("double")
    ).withColumn("cap", (F.lit(max_epochs) * F.col("source_size")).cast("double"))
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    placed = numbered.withColumn("place", F.row_number().over(by_level)).withColumn("level", level)
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("place", "level"))
    found = placed.withColumn("first_fit", F.min(fits).over(everything))
    target = F.when(F.col("place") >= F.col("first_fit.place"), F.col("first_fit.level") * F.col("weight")).otherwise(F.col("cap"))
    return found.select("source", "source_size", "weight", target.alias("target"))


def plan(sized: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """What each source takes, one row per source: whole repetitions of every document, and one more for keys up to last_key.

    sized has source, size, key.  In key order documents are taken once more until the source's remaining words are
    closest to the target.  Bucket sums find the bucket where that happens; only its documents are ordered.  Buckets are as many as
    leave BUCKET_ROWS keys in one even if all rows have one source.
    """
    digits = LEAST_DIGITS
    rows = sized.count()
    while rows > BUCKET_ROWS * 16**digits:
        digits += 1
    bucket = F.substring("key", 1, digits)
    by_bucket = sized.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("bucket_size"))
    sources = water_fill(by_bucket.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), max_epochs)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    sources = sources.withColumn("whole", F.least(F.floor(rate), F.lit(max_epochs)).cast("int")).withColumn(
        "rest", F.col("target") - F.col("whole") * F.col("source_size")
    )
    running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    edges = by_bucket.withColumn("upto", F.sum("bucket_size").over(running))
    s, e = sources.alias("s"), edges.alias("e")
    last = (
        s.join(e, F.col("s.source").eqNullSafe(F.col("e.source")) & (F.col("e.upto") > F.col("s.rest")))
        .groupBy(F.col("s.source").alias("source"), F.col("s.rest").alias("rest"))
        .agg(F.min(F.struct("e.bucket", (F.col("e.upto") - F.col("e.bucket_size")).alias("before"))).alias("edge"))
        .select("source", "rest", "edge.bucket", "edge.before")
    )
    by_key = (
        sized.withColumn("bucket", bucket)
        .alias("d")
        .join(last.alias("l"), F.col("d.source").eqNullSafe(F.col("l.source")) & (F.col("d.bucket") == F.col("l.bucket")))
        .groupBy(F.col("l.source").alias("source"), "rest", "before", "key")
        .agg(F.sum("size").alias("key_size"))
    )
    ordered = Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.col("before") + F.sum("key_size").over(ordered)
    inside = by_key.withColumn("upto", upto).filter(F.col("upto") - F.col("key_size") / 2 <= F.col("rest"))
    last_key = inside.groupBy("source").agg(F.max("key").alias("last_key"))
    edge_bucket = last.select("source", "bucket")
    return (
        sources.alias("s")
        .join(edge_bucket.alias("b"), F.col("s.source").eqNullSafe(F.col("b.source")), "left")
        .join(last_key.alias("k"), F.col("s.source").eqNullSafe(F.col("k.source")), "left")
        .select(
            F.col("s.source").alias("source"), "source_size", "target", "whole",
            # No bucket goes past what is left: all are inside it.  No key of that bucket fits: all before the bucket are taken.
            F.when(F.col("rest") <= 0, F.lit("")).otherwise(F.coalesce("last_key", "bucket", F.lit("g"))).alias("last_key"),
        )
    )


def with_copies(sized: DataFrame, planned: DataFrame) -> DataFrame:
    """sized with source_size, target and copies, the number of times the mix takes the row."""
    planned = cut(planned.withColumnRenamed("source", "plan_source"))
    d, p = sized.alias("d"), (F.broadcast(planned) if small(planned) else planned).alias("p")
    more = (F.col("d.key") <= F.col("p.last_key")).cast("int")
    return d.join(p, F.col("d.source").eqNullSafe(F.col("p.plan_source"))).select(
        "d.*", "p.source_size", "p.target", (F.col("p.whole") + more).alias("copies")
    )


def sizes(docs: DataFrame, seed: int) -> DataFrame:
    return docs.select("doc_id", "source", words_in(F.col("text")).alias("size"), sampling_key(F.col("doc_id"), seed).alias("key"))


def mix(docs: DataFrame, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """The mixed corpus: every row of docs (doc_id, text, source, any others) as often as the mix takes it.

    Null texts count no words; a null source is a source.  No row is taken more than max_epochs times, and a source's
    words come within half a document of its target.  Documents without words follow their source's plan like any other.
    Equal doc_ids are taken together.  An empty table gives an empty table.
    """
    (copy,) = fresh(docs.columns, "copy")
    planned = cut(plan(cut(sizes(docs, seed)), max_epochs))
    d, p = docs.alias("d"), planned.alias("p")
    copies = F.col("p.whole") + (sampling_key(F.col("d.doc_id"), seed) <= F.col("p.last_key")).cast("int")
    taken = d.join(F.broadcast(p) if small(planned) else p, F.col("d.source").eqNullSafe(F.col("p.source")))
    return taken.select("d.*", F.explode(F.array_repeat(F.lit(0), copies)).alias(copy)).drop(copy)


def small(planned: DataFrame, most: int = 50_000) -> bool:
    """Whether a table of one row per source is known to have at most so many rows, so that it may be broadcast."""
    return planned.limit(most + 1).count() <= most


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = cut(sizes(table(spark, sf_dir, "documents"), SEED))
    return with_copies(sized, plan(sized)).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )


def op6_sql() -> str:
    return f"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents),
per_source AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, CAST(1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS DOUBLE) AS weight,
         CAST({MAX_EPOCHS} * source_size AS DOUBLE) AS cap FROM per_source),
placed AS (
  SELECT *, row_number() OVER o AS place,
         (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / (sum(weight) OVER () - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM weighed WINDOW o AS (ORDER BY cap / weight, source ASC NULLS LAST)),
fit AS (SELECT place, level FROM placed WHERE level * weight <= cap ORDER BY place LIMIT 1),
targets AS (
  SELECT source, source_size, CASE WHEN place >= (SELECT place FROM fit) THEN (SELECT level FROM fit) * weight ELSE cap END AS target
  FROM placed),
rates AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), {MAX_EPOCHS}) ELSE 0 END AS whole FROM targets),
joined AS (
  SELECT s.*, r.source_size, r.target, r.whole, r.target - r.whole * r.source_size AS rest
  FROM sized s JOIN rates r ON s.source IS NOT DISTINCT FROM r.source),
ordered AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY key RANGE UNBOUNDED PRECEDING) AS upto,
         sum(size) OVER (PARTITION BY source, key) AS key_size FROM joined)
SELECT doc_id, size, source_size, target,
       CAST(size * (whole + CASE WHEN rest > 0 AND upto - key_size / 2 <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM ordered"""

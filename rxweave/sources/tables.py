"""Scans: parquet tables by name, CSV files with fixed schemas, archives of annotated notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GRADED = "id_a string, drug_a string, id_b string, drug_b string, level string"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def graded_files(spark: SparkSession, pattern: str, code: str = r"_([A-Z])\.csv$") -> DataFrame:
    """All files of a pattern as one table; the class code comes from the file's path, ids are put in order with their names."""
    rows = spark.read.schema(GRADED).option("header", True).csv(pattern)
    rows = rows.withColumn("code", F.regexp_extract(F.col("_metadata.file_path"), code, 1))
    swap = F.col("id_a") > F.col("id_b")
    pick = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x)).alias(x)
    return rows.select(pick("id_a", "id_b"), pick("drug_a", "drug_b"), pick("id_b", "id_a"), pick("drug_b", "drug_a"), "level", "code")


def split_files(spark: SparkSession, folder: str, schema: str, **parts: str) -> DataFrame:
    """Rows of CSV files in a layout of folders setting=/fold=, of the parts asked for; other folders are not read."""
    rows = spark.read.schema(", ".join([schema, *(f"{k} string" for k in parts)])).option("header", True).csv(folder)
    for k, v in parts.items():
        rows = rows.filter(F.col(k) == v)
    return rows.drop(*parts)


def prescriptions(spark: SparkSession, path: str) -> DataFrame:
    """Typed prescriptions; name is the generic name, or else the name, trimmed."""
    kinds = "subject_id int, hadm_id int, startdate timestamp, enddate timestamp, drug string, drug_name_generic string, route string"
    rows = spark.read.schema(kinds).option("header", True).csv(path)
    return rows.withColumn("name", F.trim(F.coalesce("drug_name_generic", "drug")))


def decoded(content: Column) -> Column:
    """Bytes of a text file: UTF-8 with or without a byte order mark, else Latin-1."""
    text = F.coalesce(F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1"))
    return F.regexp_replace(text, "^﻿", "")


def standoff(annotations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities (note_id, id, type, start, end, text, spans) and relations (note_id, id, type, arg1, arg2) from rows (note_id, ann).

    A line that begins with none of T, R and # continues the entity above it.  start and end are the first start and the last end of
    an entity; spans are all of its pieces, array<struct<start, end>>, in the order of the file, one for an entity in one piece.
    """
    lines = annotations.select("note_id", F.posexplode(F.split("ann", "\n")).alias("no", "line")).filter("line not like '#%'")
    from pyspark.sql import Window

    group = F.sum(F.col("line").rlike(r"^[TR][0-9]+\t").cast("int")).over(Window.partitionBy("note_id").orderBy("no"))
    whole = lines.withColumn("group", group).groupBy("note_id", "group").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "line"))), lambda x: x["line"]), "\n").alias("line"))
    part = lambda k: F.split("line", "\t", 3)[k]
    places = F.regexp_replace(part(1), r"^\S+ ", "")
    spans = F.split(places, "[ ;]")
    pieces = F.transform(F.split(places, ";"), lambda p: F.struct(F.split(p, " ")[0].cast("int").alias("start"), F.split(p, " ")[1].cast("int").alias("end")))
    entities = whole.filter("line rlike '^T[0-9]+\\t'").select(
        "note_id", part(0).alias("id"), F.regexp_extract(part(1), r"^\S+", 0).alias("type"), spans[0].cast("int").alias("start"), F.element_at(spans, -1).cast("int").alias("end"), F.rtrim(part(2)).alias("text"), pieces.alias("spans")
    )
    arg = lambda k: F.regexp_extract("line", rf"Arg{k}:(\S+)", 1)
    relations = whole.filter("line rlike '^R[0-9]+\\t'").select("note_id", part(0).alias("id"), F.regexp_extract(part(1), r"^\S+", 0).alias("type"), arg(1).alias("arg1"), arg(2).alias("arg2"))
    return entities, relations

"""Stored sets of tables with versions: a new version is written whole beside the old one, and one small file says which is current."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.shared import Files

POINTER = "current.json"
#: Files of a table, by a hash of its key.
PARTS = 64


def publish(tables: dict[str, DataFrame], folder: str, keys: dict[str, list[str]] | None = None, about: dict | None = None, parts: int = PARTS) -> str:
    """Write tables as a new version, make it the current one, and return its name.

    A table with a key is dealt into files by it and sorted within them, so that a look-up by key skips most row groups.  The pointer is replaced in one step after
    everything is written: readers see the old version whole or the new one whole, and a writer that stops early leaves the old one.  Readers of an old
    version are not disturbed, since versions are never changed; see retire().
    """
    spark = next(iter(tables.values())).sparkSession
    files, version = Files(spark, folder), uuid.uuid4().hex
    for name, rows in tables.items():
        if key := (keys or {}).get(name):
            rows = rows.repartition(parts, *key).sortWithinPartitions(*key)
        rows.write.parquet(f"{folder}/versions/{version}/{name}")
    pointer = {"version": version, "tables": sorted(tables), "about": about or {}}
    files.write(f"versions/{version}/{POINTER}.new", json.dumps(pointer))
    files.move(f"versions/{version}/{POINTER}.new", POINTER, replace=True)
    return version


def current(spark: SparkSession, folder: str, hint: str = "publish it first") -> dict:
    """The pointer of the current version; an error with a hint if there is none."""
    if not Files(spark, folder).exists(POINTER):
        raise FileNotFoundError(f"nothing is stored in {folder}: {hint}")
    line = spark.read.text(f"{folder}/{POINTER}", wholetext=True).first()
    return json.loads(line.value)


def load(spark: SparkSession, folder: str, name: str, version: str | None = None) -> DataFrame:
    return spark.read.parquet(f"{folder}/versions/{version or current(spark, folder)['version']}/{name}")


def counts(spark: SparkSession, folder: str) -> DataFrame:
    """(name, n): the rows of each table of the current version."""
    now = current(spark, folder)
    out = None
    for name in now["tables"]:
        one = load(spark, folder, name, now["version"]).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.union(one)
    return out


def retire(spark: SparkSession, folder: str) -> int:
    """Remove versions that are not current; to be called when no reader uses them.  Returns how many there were."""
    files, now = Files(spark, folder), current(spark, folder)["version"]
    old = [v for v in files.names("versions") if v != now]
    for v in old:
        files.system.delete(files.path(f"versions/{v}"), True)
    return len(old)


def save_document(rows: DataFrame, folder: str) -> str:
    """Rows as lines of JSON, nulls included, as a new version: what a lexicon is kept as."""
    files, version = Files(rows.sparkSession, folder), uuid.uuid4().hex
    rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value")).write.text(f"{folder}/versions/{version}/document")
    files.write(f"versions/{version}/{POINTER}.new", json.dumps({"version": version, "tables": ["document"], "schema": rows.schema.json()}))
    files.move(f"versions/{version}/{POINTER}.new", POINTER, replace=True)
    return version


def load_document(spark: SparkSession, folder: str, hint: str = "build it first") -> DataFrame:
    """The current document with the types that it was saved with."""
    from pyspark.sql.types import StructType

    now = current(spark, folder, hint)
    return spark.read.schema(StructType.fromJson(json.loads(now["schema"]))).json(f"{folder}/versions/{now['version']}/document")

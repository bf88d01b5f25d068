"""Helpers that several training-data operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir where the session names it, else that of the context.

    Where neither is set, a session in one process gets a folder of its own; on a cluster executors could not see that, so it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        known = spark.sparkContext.getCheckpointDir()
        if not known and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = known.rsplit("/", 1)[0] if known else "file://" + tempfile.mkdtemp(prefix="rxweave-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the shared folder."""
    return f"{shared_root(spark)}/rxweave/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from the written copy: lineage ends there and lost executors cost nothing."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of a table that is broadcast at most; beyond, the same join shuffles.
BROADCAST_ROWS = 200_000


def sized(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df, broadcast if a count of its rows shows that it is short."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def fresh(taken: Iterable[str], *wanted: str) -> list[str]:
    """Column names like the wanted ones that the caller's table does not have, upper and lower case being one."""
    used, out = {c.lower() for c in taken}, []
    for name in wanted:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def lean_memory() -> None:
    """Let this Python worker's Arrow batches and large arrays go back to the system as soon as they are freed; to be called as a task begins."""
    import ctypes

    import pyarrow as pa

    pa.set_memory_pool(pa.system_memory_pool())
    if setting := getattr(ctypes.CDLL(None), "mallopt", None):
        setting(-3, 1 << 20)  # M_MMAP_THRESHOLD, which would else grow with what is freed


def trim_memory() -> None:
    """Hand memory that a Python worker has freed back to the system: workers stay for later tasks, next to the executor's heap."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Remove a scratch folder through Spark's own file systems."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row: Catalyst would otherwise copy the expression into every lambda that mentions it."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only.  For texts that are all ASCII the built-in does just that, and faster."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))

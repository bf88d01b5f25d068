"""What several operators share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a table that is broadcast at most; beyond, the same join shuffles.
BROADCAST_ROWS = 200_000


def sized(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df, broadcast if a count of its rows shows that it is short."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a session in one process may do without the setting."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        known = spark.sparkContext.getCheckpointDir()
        if not known and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = known.rsplit("/", 1)[0] if known else "file://" + tempfile.mkdtemp(prefix="rxweave-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/rxweave/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """A written copy in the shared folder: lineage ends there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


class Files:
    """The few file operations that a commit needs, by Hadoop's file systems, so that they reach whatever store Spark reads."""

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm, self.conf, self.folder = spark._jvm, spark._jsc.hadoopConfiguration(), folder
        self.system = self.path("").getFileSystem(self.conf)
        self.rename, self.gateway = self.jvm.org.apache.hadoop.fs.Options.Rename, spark._sc._gateway

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def exists(self, name: str) -> bool:
        return self.system.exists(self.path(name))

    def names(self, name: str) -> list[str]:
        return sorted(f.getPath().getName() for f in self.system.listStatus(self.path(name))) if self.exists(name) else []

    def move(self, source: str, target: str, replace: bool = False) -> None:
        """Rename in one step; if the target is there already it is replaced, or else that is an error."""
        how = self.gateway.new_array(self.rename, int(replace))
        if replace:
            how[0] = self.rename.OVERWRITE
        self.system.mkdirs(self.path(target).getParent())
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path(source).toUri(), self.conf).rename(self.path(source), self.path(target), how)

    def write(self, name: str, text: str) -> None:
        out = self.system.create(self.path(name), True)
        out.write(text.encode())
        out.close()

"""Decision log as a stream: the same answers as in batch, kept up to date as files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import logs


def arriving(spark: SparkSession, folder: str, schema: StructType, files: int = 10) -> DataFrame:
    """Events of a folder of parquet files, with ts as an instant, so that it can carry a watermark."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def per_day(events: DataFrame, late: str = "7 days") -> DataFrame:
    """Events by calendar day; days older than the watermark are final."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").cast("date").alias("day"), "n")


def keep_latest(events: DataFrame, keys: list[str], order: str, value: str, folder: str, checkpoint: str) -> None:
    """Take in all files that are there, writing the newest value of each key of each batch to a folder; newest reads it.

    Nothing is held in the driver, and a key's rows from several batches are settled when they are read.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.groupBy(*keys).agg(F.max(order).alias(order), F.max_by(value, order).alias(value)).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def newest(spark: SparkSession, folder: str, keys: list[str], order: str) -> DataFrame:
    rows = spark.read.parquet(folder).drop("batch")
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def append_signed(entries: DataFrame, folder: str, checkpoint: str, writer: str = "stream") -> None:
    """Add arriving entries (log, id, ts, payload) to signed logs, batch after batch; the state is the logs' heads, read from the logs themselves.

    The batch's number goes into its commit, so a batch that Spark runs again after a failure is added once.
    """
    query = entries.writeStream.foreachBatch(lambda batch, number: logs.append(batch, folder, writer, number) and None)
    query.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_to_end(stream: DataFrame, folder: str, checkpoint: str) -> None:
    """Take in all files that are there and stop; rows that the watermark has settled are appended to the folder."""
    stream.writeStream.format("parquet").outputMode("append").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

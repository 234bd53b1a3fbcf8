"""A panel kept from a stream of events: windowed sums by entity, and their refresh in batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.sources.sinks import exists


def event_stream(spark: SparkSession, sf_dir: str, files_per_trigger: int = 1) -> DataFrame:
    """The events table as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{sf_dir}/events.parque[t]")


def entity_windows(events: DataFrame, late: str = "1 day", window: str = "1 day") -> DataFrame:
    """(entity_id, start, n, total, squares) by user and window; events later than ``late`` are dropped.

    Sums are additive, so windows of any stream can be put together afterwards.
    """
    x = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    g = x.groupBy(F.col("user_id").alias("entity_id"), F.window("ts", window).alias("w"))
    return g.agg(F.count("value").alias("n"), F.sum("value").alias("total"), F.sum(F.col("value") * F.col("value")).alias("squares")).select("entity_id", F.col("w.start").alias("start"), "n", "total", "squares")


def run_once(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Runs a stream over all that is there and gives the resulting table; for tests and backfills.

    Every batch has the complete result, which executors write to ``path`` (a folder all of them reach) in place of the
    one before; nothing of it is collected. A stream without any data gives an empty table.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    q = stream.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], stream.schema)


def keep_panel(stream: DataFrame, path: str, checkpoint: str):
    """Writes finished windows to Parquet; each batch has a folder of its own, which a repeated batch overwrites."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    return stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()

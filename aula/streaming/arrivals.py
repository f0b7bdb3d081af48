"""Structured Streaming over arriving lecture rows: redelivery, and tumbling counts with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def arrivals(spark: SparkSession, path: str, like: DataFrame, files_per_trigger: int = 1) -> DataFrame:
    """A stream of the Parquet files below ``path``."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def first_deliveries(stream: DataFrame, key: str, time: str = "ingested_at", within: str = "60 days") -> DataFrame:
    """Each key once, at its first delivery; keys are remembered for ``within``, which bounds the state."""
    rows = stream.withColumn("_at", F.col(time).cast("timestamp")).withWatermark("_at", within)
    return rows.dropDuplicatesWithinWatermark([key]).drop("_at")


def counts_by_hour(stream: DataFrame, time: str = "ingested_at", late: str = "28 days") -> DataFrame:
    """Rows per lecture and hour of arrival."""
    rows = stream.withColumn("_at", F.col(time).cast("timestamp")).withWatermark("_at", late)
    return rows.groupBy(F.window("_at", "1 hour").alias("w"), "lecture_id").agg(F.count("*").alias("n")).select("lecture_id", F.col("w.start").alias("hour"), "n")


def run_to_memory(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """All that is there now, then stop; for tests and small results."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination(120)
    query.stop()
    return stream.sparkSession.table(name)

"""Parquet tables of one data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Key of each lecture table; a redelivered row repeats key and content with a later ``ingested_at``.
TABLE_KEYS = {
    "transcript_segments": "segment_id",
    "visual_metadata": "frame_id",
    "aligned_segments": "segment_id",
    "knowledge_objects": "object_id",
    "chunks": "chunk_id",
}


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The stored rows, redelivered ones included."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def read_records(spark: SparkSession, directory: str, name: str, *columns: str) -> DataFrame:
    """One row per record: redelivered rows removed by key. Only ``columns`` are read where they are given.

    A redelivered row equals the first one in all but ``ingested_at``, which therefore is left out.
    Rows whose key is NULL cannot be told apart and are all kept.
    """
    df = read_table(spark, directory, name)
    key = TABLE_KEYS.get(name)
    if key is None:
        return df.select(*columns) if columns else df
    wanted = [c for c in (columns or df.columns) if c != "ingested_at"]
    df = df.select(*dict.fromkeys([key, *wanted]))
    keyed = df.filter(F.col(key).isNotNull()).dropDuplicates([key])
    return keyed.unionByName(df.filter(F.col(key).isNull())).select(*wanted)

"""Queries of problem 1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aula.llm.splitting import split_items
from aula.sources.tables import read_table


def oversized_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Both tables in one shape. Redelivered rows are left in: their pieces are equal and are removed behind the split."""
    objects = read_table(spark, d, "knowledge_objects").select(
        F.lit("knowledge_object").alias("record_kind"),
        F.col("object_id").cast("string").alias("item_key"),
        F.col("transcript").alias("text"),
        F.lit(None).cast("array<double>").alias("slide_timestamps"),
        "start_timestamp",
        "end_timestamp",
    )
    chunks = read_table(spark, d, "chunks").select(
        F.lit("chunk").alias("record_kind"), F.col("chunk_id").alias("item_key"), "text", "slide_timestamps", "start_timestamp", "end_timestamp"
    )
    return objects.unionByName(chunks)


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    pieces = split_items(oversized_candidates(spark, d), only_oversized=True)
    return pieces.dropDuplicates(["record_kind", "item_key", "piece_no"])


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    pieces = split_items(oversized_candidates(spark, d), only_oversized=True)
    return pieces.filter("piece_no = 2").select("record_kind", "item_key").distinct()


QUERIES = {"p1_found": p1_found, "p1_pieces": p1_pieces}
SQL = {
    "p1_found": r"""
WITH items AS (
  SELECT 'knowledge_object' AS record_kind, CAST(object_id AS VARCHAR) AS item_key, transcript AS text FROM knowledge_objects
  UNION ALL SELECT 'chunk', chunk_id, text FROM chunks)
SELECT DISTINCT record_kind, item_key FROM items
WHERE len(regexp_extract_all(text, '[^\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+')) > 450""",
}

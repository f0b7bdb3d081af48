"""Queries of problem 7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aula.llm.packing import CAPACITY, pack
from aula.sources.tables import read_records


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return pack(read_records(spark, d, "documents", "doc_id", "text"), "doc_id")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_containers(spark, d).filter("n_pieces > 1 AND piece_no = 1").select("doc_id").distinct()


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers, tokens and the share of their room that is used, in per mille."""
    per = p7_containers(spark, d).groupBy("container_id").agg(F.sum("n_tokens").cast("bigint").alias("tokens"))
    return per.agg(
        F.count("*").alias("n_containers"),
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("n_tokens"),
        F.coalesce(F.max("tokens"), F.lit(0)).alias("fullest"),
        F.floor(F.sum("tokens") * 1000 / (F.count("*") * CAPACITY)).cast("bigint").alias("used_per_mille"),
    )


QUERIES = {"p7_found": p7_found, "p7_containers": p7_containers, "p7_fill": p7_fill}
SQL = {"p7_found": f"SELECT doc_id FROM documents WHERE strlen(text) + 1 > {CAPACITY}"}

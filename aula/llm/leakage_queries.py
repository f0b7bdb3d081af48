"""Queries of problem 8. SQL cannot express the fold; the tests compare with a plain search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from aula.llm.leakage import leaks
from aula.sources.tables import read_records


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaks(read_records(spark, d, "documents", "doc_id", "text"), read_records(spark, d, "eval_items", "item_id", "question", "reference_answer", "passage"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_leaks(spark, d).select("doc_id", "item_id").distinct()


QUERIES = {"p8_found": p8_found, "p8_leaks": p8_leaks}
SQL: dict[str, str] = {}

"""Queries of problem 2. SQL cannot express the decoding; the tests compare with text that a vision model read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aula.llm.page_repair import repair
from aula.session import cut_lineage
from aula.sources.tables import read_records, read_table


def _repaired(spark: SparkSession, d: str) -> DataFrame:
    frames = cut_lineage(read_records(spark, d, "visual_metadata", "frame_id", "text", "word_confidences"), "frames")
    plain = [read_table(spark, d, "visual_metadata").select("clean_text", "title"), read_table(spark, d, "transcript_segments").select("text")]
    return repair(frames, plain)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _repaired(spark, d).select("frame_id", F.explode("lines").alias("x")).select("frame_id", "x.line_no", "x.noise_kind")


def p2_texts(spark: SparkSession, d: str) -> DataFrame:
    return _repaired(spark, d).select("frame_id", "cleaned_text")


QUERIES = {"p2_found": p2_found, "p2_texts": p2_texts}
SQL: dict[str, str] = {}

"""Queries of problem 4."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aula.llm.term_counts import COMMON_PERCENT, RARE_BELOW, mark_terms, term_counts
from aula.sources.tables import read_records, read_table


def _marked(spark: SparkSession, d: str) -> DataFrame:
    frames = read_records(spark, d, "visual_metadata", "frame_id", "text")
    total = read_table(spark, d, "visual_metadata").select("frame_id").distinct().count()
    return mark_terms(term_counts(frames), total)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    marks = F.array_compact(F.array(F.when(F.col("is_rare"), "rare"), F.when(F.col("is_common"), "common")))
    return _marked(spark, d).select("term", F.explode(marks).alias("mark"))


def p4_terms(spark: SparkSession, d: str) -> DataFrame:
    return _marked(spark, d).select("term", "n_occurrences", "n_records", "is_rare", "is_common")


_COUNTS = f"""
frames AS (SELECT frame_id, any_value(text) AS text FROM visual_metadata GROUP BY frame_id),
terms AS (SELECT frame_id, regexp_replace(lower(unnest(string_split(text, chr(10)))), '^[^\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+$', '', 'g') AS term FROM frames),
counted AS (SELECT term, count(*) AS n_occurrences, count(DISTINCT frame_id) AS n_records FROM terms WHERE term <> '' GROUP BY term),
marked AS (SELECT *, n_records < {RARE_BELOW} AS is_rare, n_records * 100 >= {COMMON_PERCENT} * (SELECT count(*) FROM frames) AS is_common FROM counted)"""

QUERIES = {"p4_found": p4_found, "p4_terms": p4_terms}
SQL = {
    "p4_found": f"WITH {_COUNTS} SELECT term, 'rare' AS mark FROM marked WHERE is_rare UNION ALL SELECT term, 'common' FROM marked WHERE is_common",
    "p4_terms": f"WITH {_COUNTS} SELECT term, n_occurrences, n_records, is_rare, is_common FROM marked",
}

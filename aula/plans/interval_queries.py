"""Queries on time intervals, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aula.operators.intervals import gaps, periods, to_ms
from aula.sources.tables import read_table

#: A gap of a day or more is a pause between recordings.
PAUSE_MS = 86_400_000


def lecture_spans(spark: SparkSession, d: str) -> DataFrame:
    """Spans of both tables; redelivered rows repeat a span, which changes no period and no gap."""
    parts = [
        read_table(spark, d, table).select(
            F.lit(kind).alias("record_kind"), "lecture_id", to_ms(F.col("start_timestamp")).alias("start_ms"), to_ms(F.col("end_timestamp")).alias("end_ms")
        )
        for kind, table in (("knowledge_object", "knowledge_objects"), ("chunk", "chunks"))
    ]
    return parts[0].unionByName(parts[1])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return gaps(lecture_spans(spark, d), ["record_kind", "lecture_id"], longest_ms=PAUSE_MS)


def p5_periods(spark: SparkSession, d: str) -> DataFrame:
    return periods(lecture_spans(spark, d), ["record_kind", "lecture_id"])


_SPANS = """
spans AS (
  SELECT record_kind, lecture_id, CAST(round(s * 1000) AS BIGINT) AS s, CAST(round(e * 1000) AS BIGINT) AS e FROM (
    SELECT 'knowledge_object' AS record_kind, lecture_id, start_timestamp AS s, end_timestamp AS e FROM knowledge_objects
    UNION ALL SELECT 'chunk', lecture_id, start_timestamp, end_timestamp FROM chunks)
  WHERE s IS NOT NULL AND e IS NOT NULL),
ordered AS (
  SELECT *, max(e) OVER (PARTITION BY record_kind, lecture_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior
  FROM spans WHERE e > s)"""

QUERIES = {"p5_found": p5_found, "p5_periods": p5_periods}
SQL = {
    "p5_found": f"""WITH {_SPANS}
SELECT record_kind, lecture_id, prior AS gap_start_ms, s AS gap_end_ms FROM ordered WHERE s > prior AND s - prior < {PAUSE_MS}""",
    "p5_periods": f"""WITH {_SPANS},
numbered AS (SELECT *, sum(CASE WHEN prior IS NULL OR s > prior THEN 1 ELSE 0 END)
  OVER (PARTITION BY record_kind, lecture_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS period_no FROM ordered)
SELECT record_kind, lecture_id, CAST(period_no AS BIGINT) AS period_no, min(s) AS period_start_ms, max(e) AS period_end_ms
FROM numbered GROUP BY ALL""",
}

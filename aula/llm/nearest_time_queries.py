"""Queries of problem 3."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aula.llm.nearest_time import nearest
from aula.sources.tables import read_table

TOLERANCE = 12.0


def _nearest_keyframes(spark: SparkSession, d: str) -> DataFrame:
    segments = read_table(spark, d, "transcript_segments").filter("end_timestamp >= start_timestamp")
    segments = segments.select("segment_id", "lecture_id", ((F.col("start_timestamp") + F.col("end_timestamp")) / 2).alias("middle"))
    frames = read_table(spark, d, "visual_metadata")
    return nearest(segments, frames, entity="lecture_id", left_key="segment_id", left_time="middle", right_key="frame_id", right_time="keyframe_timestamp", tolerance=TOLERANCE)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Redelivered segments give equal rows, which are removed here, where rows are smallest."""
    return _nearest_keyframes(spark, d).select("frame_id", "segment_id").distinct()


def p3_distances(spark: SparkSession, d: str) -> DataFrame:
    """How far the matched keyframes are, by whole second."""
    matched = _nearest_keyframes(spark, d).distinct()
    return matched.groupBy(F.floor("distance").cast("bigint").alias("second")).agg(F.count("*").alias("n_segments"))


_MATCHED = f"""
segments AS (SELECT DISTINCT segment_id, lecture_id, (start_timestamp + end_timestamp) / 2 AS middle
  FROM transcript_segments WHERE end_timestamp >= start_timestamp),
frames AS (SELECT DISTINCT frame_id, lecture_id, keyframe_timestamp AS t FROM visual_metadata WHERE keyframe_timestamp IS NOT NULL),
before AS (SELECT s.*, f.frame_id, s.middle - f.t AS distance FROM segments s ASOF JOIN frames f ON s.lecture_id = f.lecture_id AND s.middle >= f.t),
after AS (SELECT s.*, f.frame_id, f.t - s.middle AS distance FROM segments s ASOF JOIN frames f ON s.lecture_id = f.lecture_id AND s.middle <= f.t),
matched AS (SELECT segment_id, arg_min(frame_id, distance) AS frame_id, min(distance) AS distance
  FROM (SELECT * FROM before UNION ALL SELECT * FROM after) WHERE distance <= {TOLERANCE} GROUP BY segment_id)"""

QUERIES = {"p3_found": p3_found, "p3_distances": p3_distances}
SQL = {
    "p3_found": f"WITH {_MATCHED} SELECT frame_id, segment_id FROM matched",
    "p3_distances": f"WITH {_MATCHED} SELECT CAST(floor(distance) AS BIGINT) AS second, count(*) AS n_segments FROM matched GROUP BY 1",
}

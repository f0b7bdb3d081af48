"""Queries of problem 6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aula.llm.near_duplicates import LEAST_TERMS, expand, groups, near_duplicate_classes
from aula.sources.tables import read_table

KINDS = ("visual_metadata", "knowledge_object")


def slides(spark: SparkSession, d: str) -> DataFrame:
    """Both tables in one shape; a redelivered row has the same key and terms and becomes the same record."""
    frames = read_table(spark, d, "visual_metadata").select(F.lit(0).alias("kind"), F.col("frame_id").alias("id"), "text")
    objects = read_table(spark, d, "knowledge_objects").select(F.lit(1).alias("kind"), F.col("object_id").alias("id"), F.col("slide_text").alias("text"))
    return frames.unionByName(objects).filter("text <> ''")


def _kind() -> F.Column:
    return F.when(F.col("kind") == 0, KINDS[0]).otherwise(KINDS[1]).alias("record_kind")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return expand(*near_duplicate_classes(slides(spark, d))).select(_kind(), "id_a", "id_b")


def p6_groups(spark: SparkSession, d: str) -> DataFrame:
    """One row per slide with its group and number of links; the group is named by its smallest record."""
    members, links = near_duplicate_classes(slides(spark, d))
    rows = groups(members, links)
    names = rows.groupBy("group_class").agg(F.min("id").alias("group_id"))
    return rows.join(names, "group_class").select(_kind(), "id", "group_id", "n_links")


_PAIRS = f"""
records AS (
  SELECT 'visual_metadata' AS record_kind, frame_id AS id, any_value(text) AS text FROM visual_metadata GROUP BY frame_id
  UNION ALL SELECT 'knowledge_object', object_id, any_value(slide_text) FROM knowledge_objects GROUP BY object_id),
terms AS (
  SELECT DISTINCT record_kind, id, regexp_replace(lower(unnest(string_split(text, chr(10)))), '^[^\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+$', '', 'g') AS term FROM records),
kept AS (SELECT record_kind, id, term, count(*) OVER (PARTITION BY record_kind, id) AS n FROM terms WHERE term <> ''),
sets AS (SELECT * FROM kept WHERE n >= {LEAST_TERMS}),
shared AS (SELECT a.record_kind, a.id AS id_a, b.id AS id_b, count(*) AS s, any_value(a.n + b.n) AS t
  FROM sets a JOIN sets b ON a.record_kind = b.record_kind AND a.term = b.term AND a.id < b.id GROUP BY ALL),
pairs AS (SELECT record_kind, id_a, id_b FROM shared WHERE s * 10 >= (t - s) * 7)"""

QUERIES = {"p6_found": p6_found, "p6_groups": p6_groups}
SQL = {
    "p6_found": f"WITH {_PAIRS} SELECT record_kind, id_a, id_b FROM pairs",
    "p6_groups": f"""WITH RECURSIVE {_PAIRS},
ends AS (SELECT record_kind, id_a AS id, id_b AS other FROM pairs UNION ALL SELECT record_kind, id_b, id_a FROM pairs),
nodes AS (SELECT DISTINCT record_kind, id FROM sets),
reach AS (SELECT record_kind, id, id AS other FROM nodes UNION SELECT r.record_kind, r.id, e.other FROM reach r JOIN ends e ON r.record_kind = e.record_kind AND r.other = e.id)
SELECT n.record_kind, n.id, (SELECT min(other) FROM reach r WHERE r.record_kind = n.record_kind AND r.id = n.id) AS group_id,
  (SELECT count(*) FROM ends e WHERE e.record_kind = n.record_kind AND e.id = n.id) AS n_links FROM nodes n""",
}

"""Queries on the vector cache and the index, with their SQL. Each works in a folder of its own in the shared one."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aula.session import cut_lineage, remove, shared_dir
from aula.sources.providers import get
from aula.sources.tables import read_records
from aula.sources.vector_cache import VectorCache
from aula.sources.vector_store import VectorStore, collection_name

MODEL, LIMIT = "aula/Hash-8", 3072
SIGNALS = {"full": "embed_text", "speech": "text"}


def _place(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/aula-index-{uuid.uuid4().hex}"


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return read_records(spark, d, "chunks", "chunk_id", "lecture_id", "start_timestamp", "end_timestamp", "text", "embed_text")


def cache_runs(spark: SparkSession, d: str) -> DataFrame:
    """Three runs over one cache: speech, whole texts, speech again."""
    at, chunks = _place(spark), cut_lineage(_chunks(spark, d), "chunks")
    cache, rows = VectorCache(spark, at, MODEL, LIMIT), []
    for run, column in enumerate(("text", "embed_text", "text"), 1):
        texts = chunks.filter(F.col(column).isNotNull()).select(column)
        rows.append((run, texts.distinct().count(), cache.fill(texts, column, get("encoder", "hash"))))
    remove(spark, at)
    return spark.createDataFrame(rows, "run int, n_texts bigint, n_encoded bigint")


def _indexed(spark: SparkSession, d: str) -> tuple[VectorStore, DataFrame, VectorCache, str]:
    at, chunks = _place(spark), cut_lineage(_chunks(spark, d), "chunks")
    store, cache = VectorStore(spark, at, collection_name(spark, MODEL)), VectorCache(spark, at, MODEL, LIMIT)
    store.index_all(chunks, get("encoder", "hash"), cache, SIGNALS)
    return store, chunks, cache, at


def _counts(store: VectorStore) -> DataFrame:
    stored = store._read()
    return stored.groupBy("lecture_id").agg(F.countDistinct("chunk_id").alias("n_chunks"), F.count("*").alias("n_points"), F.countDistinct("point_id").alias("n_ids"), F.max(F.size("vector")).alias("size"))


def _done(rows: DataFrame, spark: SparkSession, at: str) -> DataFrame:
    out = cut_lineage(rows, "counts")
    remove(spark, at)
    return out


def index_points(spark: SparkSession, d: str) -> DataFrame:
    """All lectures indexed from nothing."""
    store, _, _, at = _indexed(spark, d)
    return _done(_counts(store), spark, at)


def upsert_idempotent(spark: SparkSession, d: str) -> DataFrame:
    """The same chunks written once more: nothing is there twice."""
    store, chunks, cache, at = _indexed(spark, d)
    vectors = cut_lineage(store._read().select("chunk_id", "signal", "vector"), "vectors")
    store.upsert(chunks, vectors)
    return _done(_counts(store), spark, at)


def index_again(spark: SparkSession, d: str) -> DataFrame:
    """A second run over lectures of which every other one lost its last chunk: those alone are replaced."""
    store, chunks, cache, at = _indexed(spark, d)
    last = chunks.groupBy("lecture_id").agg(F.max("chunk_id").alias("chunk_id"))
    odd = last.filter(F.ascii(F.substring("lecture_id", -1, 1)) % 2 == 1)
    fewer = cut_lineage(chunks.join(odd.select("chunk_id"), "chunk_id", "left_anti"), "fewer")
    replaced = store.index_all(fewer, get("encoder", "hash"), cache, SIGNALS)
    return _done(_counts(store).join(replaced.select("lecture_id", F.lit(True).alias("replaced")), "lecture_id", "left").withColumn("replaced", F.coalesce("replaced", F.lit(False))), spark, at)


def delete_lecture(spark: SparkSession, d: str) -> DataFrame:
    """What is left without the long running lecture."""
    store, _, _, at = _indexed(spark, d)
    store.delete_lecture("lecture_live")
    return _done(_counts(store), spark, at)


_PER = "ch AS (SELECT DISTINCT chunk_id, lecture_id FROM chunks)"
_COUNT = "count(*) AS n_chunks, 2 * count(*) AS n_points, count(*) AS n_ids, CAST(8 AS INTEGER) AS size"

QUERIES = {f.__name__: f for f in (cache_runs, index_points, upsert_idempotent, index_again, delete_lecture)}
SQL = {
    "cache_runs": """WITH t AS (SELECT DISTINCT text AS x FROM chunks WHERE text IS NOT NULL), e AS (SELECT DISTINCT embed_text AS x FROM chunks WHERE embed_text IS NOT NULL)
SELECT CAST(1 AS INTEGER) AS run, (SELECT count(*) FROM t) AS n_texts, (SELECT count(*) FROM t) AS n_encoded UNION ALL
SELECT 2, (SELECT count(*) FROM e), (SELECT count(*) FROM e WHERE x NOT IN (SELECT x FROM t)) UNION ALL SELECT 3, (SELECT count(*) FROM t), 0""",
    "index_points": f"WITH {_PER} SELECT lecture_id, {_COUNT} FROM ch GROUP BY lecture_id",
    "upsert_idempotent": f"WITH {_PER} SELECT lecture_id, {_COUNT} FROM ch GROUP BY lecture_id",
    "index_again": f"""WITH {_PER}, l AS (SELECT lecture_id, max(chunk_id) AS last, ascii(right(lecture_id, 1)) % 2 = 1 AS odd FROM ch GROUP BY 1)
SELECT lecture_id, {_COUNT}, any_value(odd AND n > 1) AS replaced FROM (SELECT ch.*, odd, last, count(*) OVER (PARTITION BY lecture_id) AS n FROM ch JOIN l USING (lecture_id)) WHERE NOT (odd AND chunk_id = last AND n > 1) GROUP BY lecture_id""",
    "delete_lecture": f"WITH {_PER} SELECT lecture_id, {_COUNT} FROM ch WHERE lecture_id <> 'lecture_live' GROUP BY lecture_id",
}

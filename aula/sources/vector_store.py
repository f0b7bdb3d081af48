"""A vector store of Parquet partitioned by lecture: one row per chunk and signal.

Writes replace whole lectures (dynamic partition overwrite), which makes an upsert idempotent without row locks. The
layout (signals and size) is stored beside the data; writing another layout is refused.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aula.functions.text import model_slug, point_id
from aula.session import cut_lineage, exists, remove
from aula.sources.providers import Provider
from aula.sources.vector_cache import VectorCache


def collection_name(spark: SparkSession, model: str) -> str:
    return "course_chunks__" + spark.range(1).select(model_slug(F.lit(model))).collect()[0][0]


class VectorStore:
    """``root``: a folder all executors share, on any file system the cluster knows."""

    def __init__(self, spark: SparkSession, root: str, collection: str) -> None:
        self.spark, self.at = spark, f"{str(root).rstrip('/')}/{collection}"

    @property
    def _data(self) -> str:
        return f"{self.at}/points"

    def layout(self) -> dict | None:
        file = f"{self.at}/layout"
        return json.loads(self.spark.read.text(file).collect()[0][0]) if exists(self.spark, f"{file}/_SUCCESS") else None  # one row

    def create(self, signals: list[str], size: int) -> None:
        """Nothing happens if the collection exists with this layout."""
        wanted = {"signals": sorted(signals), "size": size}
        if not signals:
            raise ValueError("a collection needs a dense signal")
        if (found := self.layout()) is not None:
            if found != wanted:
                raise ValueError(f"the collection has layout {found}, not {wanted}")
            return
        self.spark.createDataFrame([(json.dumps(wanted),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.at}/layout")

    def _read(self) -> DataFrame | None:
        """None while there are no points; names of lectures are never read as numbers or dates."""
        if not exists(self.spark, self._data) or not self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).load(self._data).select("path").limit(1).count():
            return None
        stored = self.spark.read.parquet(self._data)
        return stored.withColumn("lecture_id", F.col("lecture_id").cast("string"))

    def upsert(self, chunks: DataFrame, vectors: DataFrame, *, replace: bool = False) -> None:
        """``vectors(chunk_id, signal, vector)``: every chunk needs one vector of the right size per signal. With
        ``replace``, stored chunks of the same lectures that are not among ``chunks`` go."""
        layout = self.layout()
        if layout is None:
            raise ValueError("create the collection first")
        per = vectors.filter(F.size("vector") == layout["size"]).groupBy("chunk_id").agg(F.array_sort(F.collect_set("signal")).alias("s"), F.count("*").alias("n"))
        bad = chunks.select("chunk_id").join(per, "chunk_id", "left").filter(~F.coalesce((F.col("s") == F.array(*[F.lit(x) for x in layout["signals"]])) & (F.col("n") == len(layout["signals"])), F.lit(False)))
        if bad.limit(1).count():
            raise ValueError("chunks and vectors do not match")
        new = chunks.join(vectors, "chunk_id").withColumn("point_id", point_id(F.col("chunk_id")))
        old = self._read()
        if old is not None and not replace:
            touched = old.join(new.select("lecture_id").distinct(), "lecture_id", "left_semi")
            new = new.unionByName(touched.join(new.select("chunk_id").distinct(), "chunk_id", "left_anti"), allowMissingColumns=True)
        self._write(new)

    def _write(self, rows: DataFrame) -> None:
        cut_lineage(rows, "points").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("lecture_id").parquet(self._data)

    def delete_lecture(self, lecture: str) -> None:
        name = self.spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(lecture)
        remove(self.spark, f"{self._data}/lecture_id={name}")

    def count(self, lecture: str | None = None) -> int:
        old = self._read()
        if old is None:
            return 0
        return (old if lecture is None else old.filter(F.col("lecture_id") == lecture)).select("chunk_id").distinct().count()

    def load(self, lecture: str | None = None) -> DataFrame:
        """Chunks without vectors, one row each, in order of lecture and time."""
        rows = self._read()
        if rows is None:
            raise ValueError("the collection is empty")
        rows = rows if lecture is None else rows.filter(F.col("lecture_id") == lecture)
        return rows.drop("vector", "signal").dropDuplicates(["chunk_id"]).orderBy("lecture_id", "start_timestamp")

    def points(self, signal: str) -> DataFrame:
        return self._read().filter(F.col("signal") == signal).select("chunk_id", "lecture_id", "start_timestamp", "vector")

    def index(self, lecture: str, chunks: DataFrame, vectors: DataFrame, *, force: bool = False) -> bool:
        """Replace a lecture's points; skipped (False) if as many chunks are stored already, unless forced."""
        n = chunks.count()
        if not n or (not force and self.count(lecture) == n):
            return False
        self.delete_lecture(lecture)
        self.upsert(chunks, vectors)
        return True

    def index_all(self, chunks: DataFrame, encoder: Provider, cache: VectorCache, signals: dict[str, str], *, force: bool = False) -> DataFrame:
        """Encodes ``chunks(chunk_id, lecture_id, ...)`` for every signal (name and text column) and replaces their lectures.

        Lectures with as many chunks stored already are skipped, unless forced. The size of the vectors is measured and
        must be that of the collection, which is made if there is none. Returns ``lecture_id, n_chunks`` of what was indexed.
        """
        wanted = chunks.groupBy("lecture_id").agg(F.count("*").alias("n_chunks"))
        old = self._read()
        if old is not None and not force:
            stored = old.groupBy("lecture_id").agg(F.countDistinct("chunk_id").alias("n_stored"))
            wanted = wanted.join(stored, "lecture_id", "left").filter(~F.col("n_chunks").eqNullSafe(F.col("n_stored"))).drop("n_stored")
        todo = cut_lineage(wanted, "todo")
        rows = cut_lineage(chunks.join(todo.select("lecture_id"), "lecture_id", "left_semi"), "todo-chunks")
        texts = {name: rows.select("chunk_id", F.coalesce(text, F.lit("")).alias("text")) for name, text in signals.items()}
        for t in texts.values():
            cache.fill(t, "text", encoder)
        parts = [cache.look_up(t, "text").select("chunk_id", F.lit(name).alias("signal"), "vector") for name, t in texts.items()]
        vectors = parts[0]
        for p in parts[1:]:
            vectors = vectors.unionByName(p)
        vectors = cut_lineage(vectors, "vectors")
        size = vectors.select(F.size("vector")).head(1)
        if size:
            self.create(list(signals), size[0][0])
            self.upsert(rows, vectors, replace=True)
        return todo

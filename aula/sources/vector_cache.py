"""A cache of vectors by a key of model, token limit and text: only texts that were never encoded reach the encoder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aula.functions.text import cache_key
from aula.session import cut_lineage, exists
from aula.sources.providers import Provider, apply


class VectorCache:
    """``root``: a folder all executors share; rows ``key, vector`` are only ever appended.

    Two runs that encode the same text at the same time may both append it; equal keys hold equal vectors, and one is read.
    """

    def __init__(self, spark: SparkSession, root: str, model: str, limit: int) -> None:
        self.spark, self.at, self.model, self.limit = spark, f"{str(root).rstrip('/')}/vectors", model, limit

    def _read(self) -> DataFrame:
        if exists(self.spark, f"{self.at}/_SUCCESS"):
            return self.spark.read.schema("key string, vector array<double>").parquet(self.at)
        return self.spark.createDataFrame([], "key string, vector array<double>")

    def missing(self, texts: DataFrame, text: str) -> DataFrame:
        """``key, text`` of distinct texts without a vector; NULL texts have none."""
        wanted = texts.filter(F.col(text).isNotNull()).select(cache_key(self.model, self.limit, F.col(text)).alias("key"), F.col(text).alias("text")).dropDuplicates(["key"])
        return wanted.join(self._read().select("key"), "key", "left_anti")

    def fill(self, texts: DataFrame, text: str, encoder: Provider) -> int:
        """Encodes and appends what is missing; returns how many texts that were."""
        todo = cut_lineage(self.missing(texts, text), "missing")
        n = todo.count()
        if n:
            made = apply(todo, "text", "vector", encoder, "array<double>").select("key", "vector")
            cut_lineage(made, "encoded").write.mode("append").parquet(self.at)
        return n

    def look_up(self, texts: DataFrame, text: str) -> DataFrame:
        """``texts`` with ``vector`` as the cache holds it now.

        Spark takes two scans of one path for the same, whenever their files were listed: fill the cache with all that one
        plan needs before the first look-up.
        """
        known = self._read().dropDuplicates(["key"])
        return texts.withColumn("_key", cache_key(self.model, self.limit, F.col(text))).join(known, F.col("_key") == known["key"], "left").drop("_key", "key")

    def encode(self, texts: DataFrame, text: str, encoder: Provider) -> DataFrame:
        """``texts`` with ``vector`` (NULL for NULL texts); the order of rows is free."""
        self.fill(texts, text, encoder)
        return self.look_up(texts, text)

"""File sources and sinks: JSON lists with a declared schema, images, videos, results."""

from __future__ import annotations

import json
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aula.functions.text import frame_timestamp

# Kinds of video files.
VIDEO_TYPES = ("mp4", "mkv", "mov", "avi", "webm")


def read_json_list(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lists of objects; a malformed file is an error, fields that are missing are NULL."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def write_json(df: DataFrame, path: str) -> None:
    """Replaces ``path`` by line-wise JSON; the old files go before the new ones are there."""
    df.write.mode("overwrite").json(path)


def scan_images(spark: SparkSession, folder: str) -> DataFrame:
    """``path, second`` of all frame images below a folder; only file names and sizes are read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "frame_*.jpg").option("recursiveFileLookup", True).load(folder)
    return files.select("path", frame_timestamp(F.col("path")).alias("second"), "length")


def find_videos(spark: SparkSession, root: str) -> DataFrame:
    """``lecture, path, n`` of the video in each lecture folder below ``root``, with the number of candidates."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(VIDEO_TYPES) + "}").load(root)
    parts = F.split("path", "/")
    return files.select("path", F.element_at(parts, -2).alias("lecture")).groupBy("lecture").agg(F.min("path").alias("path"), F.count("*").alias("n"))


def one_video(videos: DataFrame, lecture: str) -> str:
    rows = videos.filter(F.col("lecture") == lecture).collect()  # at most one row
    if not rows:
        raise FileNotFoundError(f"no video in {lecture}")
    if rows[0].n > 1:
        raise ValueError(f"{rows[0].n} videos in {lecture}")
    return rows[0].path


def list_lectures(chunks: DataFrame) -> DataFrame:
    """Names of lectures that are safe to show, sorted."""
    return chunks.select("lecture_id").distinct().filter(F.col("lecture_id").rlike(r"^[A-Za-z0-9_-]+$")).orderBy("lecture_id")


def save_results(folder: str | Path, record: dict, now: datetime | None = None) -> Path:
    """A small record in a new file; an existing one is never overwritten."""
    stamp = (now or datetime.now()).strftime("%Y%m%d_%H%M%S")
    Path(folder).mkdir(parents=True, exist_ok=True)
    n = 0
    while True:
        file = Path(folder) / f"results_{stamp}{f'_{n}' if n else ''}.json"
        try:
            with file.open("x") as f:
                json.dump(record, f, indent=2)
            return file
        except FileExistsError:
            n += 1

"""Speech aligned to slides, knowledge objects, and what was shown at a moment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aula.functions.text import strip
from aula.operators.cells import asof_backward, with_last, with_next


def align(segments: DataFrame, keyframes: DataFrame) -> DataFrame:
    """``segments`` with ``keyframe_timestamp`` of the slide that shows when they start (NULL before the first)."""
    return asof_backward(segments, keyframes, entity="lecture_id", left_time="start_timestamp", right_time="keyframe_timestamp", payload=["keyframe_timestamp"])


def speech_by_slide(aligned: DataFrame) -> DataFrame:
    """``lecture_id, keyframe_timestamp, transcript``: stripped speech of each slide in order, joined by spaces."""
    pieces = F.array_sort(F.collect_list(F.struct("start_timestamp", "segment_id", strip(F.coalesce("text", F.lit(""))).alias("t"))))
    grouped = aligned.filter("keyframe_timestamp IS NOT NULL").groupBy("lecture_id", "keyframe_timestamp").agg(pieces.alias("p"))
    return grouped.select("lecture_id", "keyframe_timestamp", F.array_join(F.transform("p", lambda x: x.t), " ").alias("transcript"))


def knowledge_objects(keyframes: DataFrame, aligned: DataFrame) -> DataFrame:
    """One object per keyframe: its span, its speech ('' where nobody spoke) and its texts, NULL as ''.

    A slide ends where the next one starts, the last one where the lecture's last listed segment ends.
    """
    slides = with_next(keyframes.filter("keyframe_timestamp IS NOT NULL"), "lecture_id", ["keyframe_timestamp", "frame_id"], F.col("keyframe_timestamp"), "next_start")
    last = aligned.groupBy("lecture_id").agg(F.max(F.struct("start_timestamp", "segment_id", "end_timestamp")).getField("end_timestamp").alias("last_end"))
    joined = slides.join(last, "lecture_id").join(speech_by_slide(aligned), ["lecture_id", "keyframe_timestamp"], "left")
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return joined.select(
        F.col("frame_id").alias("object_id"), "lecture_id", F.col("keyframe_timestamp").alias("start_timestamp"), F.coalesce("next_start", "last_end").alias("end_timestamp"),
        blank("transcript"), blank("title"), F.coalesce("text", F.lit("")).alias("slide_text"), F.coalesce("description", F.lit("")).alias("slide_description"),
        blank("content_type"), blank("clean_text"), blank("cleaned_text"), "slide_number", "image_path",
    )


def slide_changes(objects: DataFrame) -> DataFrame:
    """Objects with ``is_change``: this slide and the one before both have a title, and the titles differ."""
    own = F.lower(strip(F.coalesce("title", F.lit(""))))
    before = with_last(objects.withColumn("_title", F.lower(strip(F.coalesce("title", F.lit(""))))), "lecture_id", ["start_timestamp", "object_id"], own, "_prev", strict=True)
    return before.withColumn("is_change", F.coalesce((F.col("_title") != "") & (F.col("_prev") != "") & (F.col("_title") != F.col("_prev")), F.lit(False))).drop("_title", "_prev")


def shown_at(moments: DataFrame, objects: DataFrame) -> DataFrame:
    """``moments(moment_id, lecture_id, second)`` with ``object_id`` of the slide whose half-open span holds it.

    Of several, the last listed counts; spans may overlap, so this is a join by lecture with the span as condition.
    """
    o = objects.select("lecture_id", "object_id", F.col("start_timestamp").alias("s"), F.col("end_timestamp").alias("e"))
    hits = moments.join(o, "lecture_id").filter("s <= second AND second < e")
    return hits.groupBy("moment_id", "lecture_id", "second").agg(F.max(F.struct("s", "object_id")).getField("object_id").alias("object_id"))


def speech_around(moments: DataFrame, segments: DataFrame, reach: float = 10.0) -> DataFrame:
    """Segments that start within ``reach`` seconds of a moment, both ends included."""
    s = segments.select("lecture_id", "segment_id", "start_timestamp")
    return moments.join(s, "lecture_id").filter(F.col("start_timestamp").between(F.col("second") - reach, F.col("second") + reach)).select("moment_id", "segment_id")

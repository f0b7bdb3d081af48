"""Clean-up of recognised tokens: interface words by document frequency, symbols, low confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aula.functions.text import has_letter_or_digit, normalize_word, raw_words

SHARE, LEAST_FRAMES, MOST_CANDIDATES, LEAST_LENGTH, LEAST_CONFIDENCE = 0.25, 5, 80, 3, 0.3


def candidates(frames: DataFrame, *, share: float = SHARE, least: int = LEAST_FRAMES, most: int = MOST_CANDIDATES) -> DataFrame:
    """``lecture_id, word, n_frames``: alphabetic words of three letters or more on a large share of a lecture's frames.

    At most ``most`` a lecture: the most frequent, ties in alphabetical order.
    """
    total = frames.groupBy("lecture_id").agg(F.countDistinct("frame_id").alias("n"))
    words = frames.select("lecture_id", "frame_id", F.explode(raw_words(F.col("text"))).alias("w")).select("lecture_id", "frame_id", normalize_word(F.col("w")).alias("word"))
    words = words.filter((F.length("word") >= LEAST_LENGTH) & F.col("word").rlike(r"^\p{L}+$"))
    counted = words.distinct().groupBy("lecture_id", "word").agg(F.count("*").alias("n_frames"))
    often = counted.join(total, "lecture_id").filter(F.col("n_frames") >= F.greatest(F.lit(float(least)), F.col("n") * share))
    rank = F.row_number().over(Window.partitionBy("lecture_id").orderBy(F.col("n_frames").desc(), "word"))
    return often.withColumn("r", rank).filter(F.col("r") <= most).select("lecture_id", "word", "n_frames")


def split_reply(found: DataFrame, replies: DataFrame) -> DataFrame:
    """``lecture_id, interface_words, kept_as_content`` from ``candidates`` and ``replies(lecture_id, words)``.

    Words of the reply count normalised, once, in reply order, and only if they are candidates.
    """
    listed = found.groupBy("lecture_id").agg(F.array_sort(F.collect_list("word")).alias("c"))
    joined = listed.join(replies, "lecture_id", "left")
    named = F.array_distinct(F.transform(F.coalesce("words", F.array().cast("array<string>")), normalize_word))
    return joined.select("lecture_id", "c", F.filter(named, lambda w: F.array_contains("c", w)).alias("interface_words")).select(
        "lecture_id", "interface_words", F.array_except("c", "interface_words").alias("kept_as_content")
    )


def _reason(word: Column, confidence: Column, junk: Column, least: float) -> Column:
    return (
        F.when(~has_letter_or_digit(word), "symbol")
        .when(F.array_contains(junk, normalize_word(word)), "interface")
        .when((confidence >= 0) & (confidence < least), "low_confidence")
        .otherwise("keep")
    )


def clean(frames: DataFrame, interface_words: DataFrame, *, least_confidence: float = LEAST_CONFIDENCE) -> DataFrame:
    """``frame_id, cleaned_text`` and counters. ``frames(frame_id, lecture_id, text, word_confidences)``,
    ``interface_words(lecture_id, interface_words)``. Confidences of another number than the tokens are not used."""
    joined = frames.join(interface_words.select("lecture_id", "interface_words"), "lecture_id", "left")
    words = F.coalesce(raw_words(F.col("text")), F.array().cast("array<string>"))
    joined = joined.withColumn("_w", words).withColumn("_j", F.coalesce("interface_words", F.array().cast("array<string>")))
    joined = joined.withColumn("_ok", F.coalesce(F.size("word_confidences") == F.size("_w"), F.lit(False)))
    sure = F.when(F.col("_ok"), F.col("word_confidences")).otherwise(F.transform("_w", lambda _: F.lit(-1.0)))
    marked = joined.withColumn("_r", F.zip_with("_w", sure, lambda w, c: F.struct(w.alias("w"), _reason(w, c, F.col("_j"), least_confidence).alias("r"))))
    count = lambda r: F.size(F.filter("_r", lambda x: x.r == r)).alias(f"dropped_{r}")
    return marked.select(
        "frame_id", "lecture_id", F.array_join(F.transform(F.filter("_r", lambda x: x.r == "keep"), lambda x: x.w), " ").alias("cleaned_text"),
        F.size("_w").alias("before"), F.size(F.filter("_r", lambda x: x.r == "keep")).alias("after"), count("symbol"), count("interface"), count("low_confidence"),
        F.when((F.size("_w") > 0) & ~F.col("_ok"), 1).otherwise(0).alias("without_confidences"),
    )


def counters(cleaned: DataFrame) -> DataFrame:
    """Totals by lecture."""
    names = ("before", "after", "dropped_symbol", "dropped_interface", "dropped_low_confidence", "without_confidences")
    return cleaned.groupBy("lecture_id").agg(*[F.sum(c).cast("bigint").alias(c) for c in names])


def average_confidence(confidences: Column) -> Column:
    """Mean of the known confidences (-1 is unknown), NULL without any."""
    known = F.filter(confidences, lambda x: x >= 0)
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda s, x: s + x) / F.size(known))

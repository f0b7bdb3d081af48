"""Chunks: a sequential fold of speech pieces into buckets with overlap.

A bucket takes pieces until it has ``target`` words, is sealed early where a piece would pass ``most`` words (a fresh
bucket accepts any piece), and starts with the last ``overlap`` pieces of the one before, if that had more. With
``slide_aware``, a bucket of ``aware_min`` words is sealed at a real slide change, and a titled slide is not cut at the
target. Slides without speech wait for the bucket of the next piece. A last bucket with fewer than ``least_last`` new
words joins the one before if both fit.

The fold's state is five numbers. Pieces are sorted within a lecture and streamed past that state; a lecture is never
collected. Texts and slides are joined back afterwards, by bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aula.functions.text import count_words, embed_text, strip, unique_in_order
from aula.operators.cells import asof_backward
from aula.session import cut_lineage

SLIDE_TEXTS = ("clean_text", "cleaned_text", "slide_text", "none")


@dataclass(frozen=True)
class ChunkRules:
    target: int = 350
    most: int = 450
    overlap: int = 1
    least_last: int = 100
    slide_aware: bool = False
    aware_min: int = 250
    slide_text: str = "clean_text"
    with_description: bool = True

    def __post_init__(self) -> None:
        if self.slide_text not in SLIDE_TEXTS:
            raise ValueError(f"slide_text must be one of {SLIDE_TEXTS}")
        if self.overlap < 0:
            raise ValueError("overlap must not be negative")


def pieces(aligned: DataFrame, objects: DataFrame) -> DataFrame:
    """Speech pieces of lectures that have slides, numbered in fold order, with what the fold needs to know."""
    titles = objects.select("lecture_id", F.col("start_timestamp").alias("keyframe_timestamp"), F.lower(strip(F.coalesce("title", F.lit("")))).alias("own_title"))
    titles = titles.groupBy("lecture_id", "keyframe_timestamp").agg(F.max("own_title").alias("own_title"))
    spoken = aligned.join(objects.select("lecture_id").distinct(), "lecture_id", "left_semi").join(titles, ["lecture_id", "keyframe_timestamp"], "left")
    text = strip(F.coalesce("text", F.lit("")))
    order = Window.partitionBy("lecture_id").orderBy(F.col("keyframe_timestamp").asc_nulls_first(), "start_timestamp", "segment_id")
    numbered = spoken.select("lecture_id", "segment_id", "start_timestamp", "end_timestamp", "keyframe_timestamp", "own_title", text.alias("text"), count_words(text).alias("words"))
    numbered = numbered.withColumn("seq", F.row_number().over(order)).withColumn("_before", F.lag("own_title").over(order))
    changed = (F.col("own_title") != "") & (F.col("_before") != "") & (F.col("own_title") != F.col("_before"))
    return numbered.withColumn("changed", F.coalesce(changed, F.lit(False))).withColumn("titled", F.coalesce(F.col("own_title") != "", F.lit(False))).drop("_before", "own_title")


def missing_slides(aligned: DataFrame, objects: DataFrame) -> DataFrame:
    """Speech that points at a slide which does not exist; not empty means the input is not usable."""
    known = objects.select("lecture_id", F.col("start_timestamp").alias("keyframe_timestamp"))
    return aligned.filter("keyframe_timestamp IS NOT NULL").join(known, ["lecture_id", "keyframe_timestamp"], "left_anti")


class Fold:
    """State of one lecture's fold."""

    def __init__(self, rules: ChunkRules) -> None:
        self.rules, self.bucket, self.words, self.count, self.new, self.last = rules, 0, 0, 0, 0, []

    def seal(self) -> None:
        k = self.rules.overlap
        carried = self.last[-k:] if k and self.count > k else []
        self.bucket, self.words, self.count, self.new = self.bucket + 1, sum(carried), len(carried), 0

    def take(self, words: int, changed: bool, titled: bool) -> tuple[int, int, int]:
        """(bucket, carried pieces, carried words) of a piece; the last two for the first new piece of a bucket."""
        r = self.rules
        if self.new and (self.words + words > r.most or (r.slide_aware and self.words >= r.aware_min and changed)):
            self.seal()
        first = (self.count, self.words) if not self.new else (-1, 0)
        self.words, self.count, self.new = self.words + words, self.count + 1, self.new + 1
        self.last = (self.last + [words])[-max(r.overlap, 1) :]
        out = (self.bucket, *first)
        if self.words >= r.target and not (r.slide_aware and titled):
            self.seal()
        return out


def fold(numbered: DataFrame, rules: ChunkRules) -> DataFrame:
    """``lecture_id, seq, words, bucket, carried, carried_words``; tail merge included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lecture, state = object(), Fold(rules)
        for b in batches:
            out = []
            cols = [c.to_pylist() for c in b.columns]
            for own, words, changed, titled in zip(cols[0], cols[2], cols[3], cols[4]):
                if own != lecture:
                    lecture, state = own, Fold(rules)
                out.append(state.take(words, changed, titled))
            made = [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *made], ["lecture_id", "seq", "words", "bucket", "carried", "carried_words"])

    ordered = numbered.select("lecture_id", "seq", "words", "changed", "titled").repartition("lecture_id").sortWithinPartitions("lecture_id", "seq")
    folded = ordered.mapInArrow(run, "lecture_id string, seq int, words int, bucket int, carried int, carried_words bigint")
    return _merge_tail(folded, rules)


def _merge_tail(folded: DataFrame, rules: ChunkRules) -> DataFrame:
    buckets = folded.groupBy("lecture_id", "bucket").agg(F.sum("words").alias("new_words"), F.max("carried_words").alias("old_words"))
    last = buckets.groupBy("lecture_id").agg(F.max("bucket").alias("last_bucket"))
    ends = buckets.join(last, "lecture_id").filter("bucket >= last_bucket - 1 AND last_bucket > 0")
    pair = ends.groupBy("lecture_id", "last_bucket").agg(
        F.sum(F.when(F.col("bucket") == F.col("last_bucket"), F.col("new_words"))).alias("tail"),
        F.sum(F.when(F.col("bucket") < F.col("last_bucket"), F.col("new_words") + F.col("old_words"))).alias("before"),
    )
    merged = pair.filter((F.col("tail") < rules.least_last) & (F.col("before") + F.col("tail") <= rules.most)).select("lecture_id", F.col("last_bucket").alias("gone"))
    joined = folded.join(merged, "lecture_id", "left")
    into = F.coalesce(F.col("bucket") == F.col("gone"), F.lit(False))
    return joined.select("lecture_id", "seq", "words", F.when(into, F.col("bucket") - 1).otherwise(F.col("bucket")).alias("bucket"), F.when(into, -1).otherwise(F.col("carried")).alias("carried"))


def members(folded: DataFrame) -> DataFrame:
    """``lecture_id, bucket, seq, is_new``: pieces of each bucket, those carried over from the one before included."""
    back = Window.partitionBy("lecture_id", "bucket").orderBy(F.col("seq").desc())
    own = folded.withColumn("_back", F.row_number().over(back))
    starts = folded.filter("carried > 0").select("lecture_id", (F.col("bucket") - 1).alias("bucket"), F.col("carried").alias("k"))
    carried = own.join(starts, ["lecture_id", "bucket"]).filter("_back <= k").select("lecture_id", (F.col("bucket") + 1).alias("bucket"), "seq", F.lit(False).alias("is_new"))
    return own.select("lecture_id", "bucket", "seq", F.lit(True).alias("is_new")).unionByName(carried)


def blank_slides(numbered: DataFrame, folded: DataFrame, objects: DataFrame) -> DataFrame:
    """``lecture_id, bucket, keyframe_timestamp`` of slides nobody spoke during: the bucket of the next piece, or the last."""
    spoken = numbered.join(folded.select("lecture_id", "seq", "bucket"), ["lecture_id", "seq"])
    per = spoken.groupBy("lecture_id", "keyframe_timestamp").agg(F.min("bucket").alias("bucket"))
    slides = objects.select("lecture_id", F.col("start_timestamp").alias("keyframe_timestamp")).distinct()
    silent = slides.join(per, ["lecture_id", "keyframe_timestamp"], "left_anti").withColumn("at", -F.col("keyframe_timestamp"))
    ahead = per.filter("keyframe_timestamp IS NOT NULL").select("lecture_id", (-F.col("keyframe_timestamp")).alias("at"), "bucket")
    found = asof_backward(silent, ahead, entity="lecture_id", left_time="at", right_time="at", payload=["bucket"])
    last = folded.groupBy("lecture_id").agg(F.max("bucket").alias("last_bucket"))
    return found.join(last, "lecture_id").select("lecture_id", F.coalesce("bucket", "last_bucket").alias("bucket"), "keyframe_timestamp")


def build_chunks(aligned: DataFrame, objects: DataFrame, rules: ChunkRules = ChunkRules(), course_id: str = "course") -> DataFrame:
    """All chunks of all lectures, with links to their neighbours. Lectures without slides or speech have none.

    Numbered pieces and the fold are written once, as each is read several times below.
    """
    numbered = cut_lineage(pieces(aligned, objects), "pieces")
    folded = cut_lineage(fold(numbered, rules), "fold")
    parts = members(folded).join(numbered, ["lecture_id", "seq"])
    spoken = parts.groupBy("lecture_id", "bucket").agg(
        F.array_sort(F.collect_list(F.struct("seq", "start_timestamp", "end_timestamp", "text"))).alias("p"),
    )
    spoken = spoken.select(
        "lecture_id", "bucket", F.col("p")[0]["start_timestamp"].alias("start_timestamp"), F.element_at("p", -1)["end_timestamp"].alias("end_timestamp"),
        F.array_join(F.transform("p", lambda x: x.text), " ").alias("text"),
    )
    shown = parts.filter("keyframe_timestamp IS NOT NULL").select("lecture_id", "bucket", "keyframe_timestamp").unionByName(blank_slides(numbered, folded, objects)).distinct()
    slides = shown.join(objects.withColumnRenamed("start_timestamp", "keyframe_timestamp").drop("end_timestamp", "transcript"), ["lecture_id", "keyframe_timestamp"])
    listed = slides.groupBy("lecture_id", "bucket").agg(
        F.array_sort(F.collect_list(F.struct("keyframe_timestamp", "object_id", "title", "slide_text", "cleaned_text", "clean_text", "slide_description", "image_path"))).alias("s")
    )
    full = spoken.join(listed, ["lecture_id", "bucket"], "left")
    lines = lambda name: F.array_join(F.filter(F.transform("s", lambda x: x[name]), lambda t: t != ""), "\n")
    column = lambda name, kind: F.coalesce(F.transform("s", lambda x: x[name]), F.array().cast(f"array<{kind}>"))
    full = full.select(
        F.concat("lecture_id", F.lit("_"), F.col("start_timestamp").cast("bigint").cast("string")).alias("chunk_id"), F.lit(course_id).alias("course_id"), "lecture_id", "bucket", "start_timestamp", "end_timestamp",
        column("keyframe_timestamp", "double").alias("slide_timestamps"), column("image_path", "string").alias("image_paths"),
        F.filter(column("title", "string"), lambda t: strip(t) != "").alias("slide_titles"), "text",
        *[F.coalesce(lines(c), F.lit("")).alias(c) for c in ("slide_text", "cleaned_text", "clean_text", "slide_description")],
    )
    source = F.lit("") if rules.slide_text == "none" else F.col(rules.slide_text)
    full = cut_lineage(full.withColumn("embed_text", embed_text(source, F.col("slide_description"), F.col("text"), with_description=rules.with_description)), "chunks")
    return link(full)


def link(chunks: DataFrame) -> DataFrame:
    """``prev_chunk_id`` and ``next_chunk_id`` by bucket number: an equi-join with the neighbours, no window over a lecture."""
    ids = chunks.select("lecture_id", "bucket", "chunk_id")
    before = ids.select("lecture_id", (F.col("bucket") + 1).alias("bucket"), F.col("chunk_id").alias("prev_chunk_id"))
    after = ids.select("lecture_id", (F.col("bucket") - 1).alias("bucket"), F.col("chunk_id").alias("next_chunk_id"))
    return chunks.join(before, ["lecture_id", "bucket"], "left").join(after, ["lecture_id", "bucket"], "left")


def titles_of(chunks: DataFrame) -> DataFrame:
    return chunks.select("chunk_id", unique_in_order(F.col("slide_titles")).alias("titles"))

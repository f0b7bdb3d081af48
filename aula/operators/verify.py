"""Integrity checks of lecture tables: one row (lecture_id, check, status, n) per lecture and check.

``n`` counts what is wrong (or, for INFO, what was counted). Statuses are PASS, FAIL, WARN and INFO. The lectures are
those that any table names: one without speech, keyframes or chunks fails the check that they exist and has no others of
that kind; one with keyframes but no objects, or the other way round, has all checks of objects.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aula.functions.text import count_words, frame_timestamp, strip
from aula.operators.cells import asof_backward, with_last, with_next
from aula.operators.evaluation import upper_median
from aula.session import cut_lineage

OVERRUN = 10.0
MOST_WORDS = 450
#: Seconds of a cell in which speech and chunks meet.
SPEECH_CELL = 600.0


def _rows(counts: DataFrame, checks: dict[str, tuple[Column, str]]) -> DataFrame:
    """Checks from one row of counts per lecture: ``name -> (count, status where it is not zero)``."""
    listed = F.array(*[F.struct(F.lit(name).alias("check"), F.lit(bad).alias("bad"), F.coalesce(c, F.lit(0)).cast("bigint").alias("n")) for name, (c, bad) in checks.items()])
    x = counts.select("lecture_id", F.explode(listed).alias("x"))
    status = F.when(F.col("x.bad") == "INFO", "INFO").when(F.col("x.n") == 0, "PASS").otherwise(F.col("x.bad"))
    return x.select("lecture_id", F.col("x.check").alias("check"), status.alias("status"), F.col("x.n").alias("n"))


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def lectures_of(*tables: DataFrame) -> DataFrame:
    """``lecture_id`` of all lectures that any of the tables names."""
    return union([t.select("lecture_id").distinct() for t in tables]).filter("lecture_id IS NOT NULL").distinct()


def _exist(lectures: DataFrame, rows: DataFrame, check: str) -> DataFrame:
    there = rows.select("lecture_id").distinct().withColumn("there", F.lit(1))
    return _rows(lectures.join(there, "lecture_id", "left"), {check: (F.when(F.col("there").isNull(), 1).otherwise(0), "FAIL")})


def check_transcript(segments: DataFrame, lectures: DataFrame) -> DataFrame:
    """There is speech; spans do not end before they start, and are listed in time order (by segment_id)."""
    usable = segments.filter("start_timestamp IS NOT NULL")
    ordered = with_last(usable.select("segment_id", "lecture_id", "start_timestamp", "end_timestamp", F.col("segment_id").cast("double").alias("pos")), "lecture_id", ["pos"], F.col("start_timestamp"), "before", strict=True, size=100_000.0)
    counts = ordered.groupBy("lecture_id").agg(F.count_if(F.coalesce(F.col("end_timestamp") < F.col("start_timestamp"), F.lit(False))).alias("bad"), F.count_if(F.coalesce(F.col("start_timestamp") < F.col("before"), F.lit(False))).alias("order"))
    rest = _rows(counts, {"transcript ends after it starts": (F.col("bad"), "FAIL"), "transcript is in time order": (F.col("order"), "FAIL")})
    return _exist(lectures, usable, "transcript has speech").unionByName(rest)


def check_files(images: DataFrame, frames: DataFrame) -> DataFrame:
    """Image files, as ``scan_images`` lists them with their lecture, against the keyframes: as many, at the same hundredths
    of a second, and each path of a keyframe is there. ``images(lecture_id, path, second)``; paths are compared from their
    lecture's folder on."""
    hundredth = lambda c: F.bround(c.cast("decimal(38,6)"), 2)
    tail = lambda c: F.substring_index(F.replace(c, F.lit("\\"), F.lit("/")), "/", -3)
    stored = images.select("lecture_id", tail(F.col("path")).alias("path"), hundredth(F.col("second")).alias("t"))
    known = frames.select("lecture_id", tail(F.col("image_path")).alias("path"), hundredth(F.col("keyframe_timestamp")).alias("t"))
    times = union([stored.withColumn("side", F.lit(1)), known.withColumn("side", F.lit(-1))]).groupBy("lecture_id", "t").agg(F.sum("side").alias("surplus"), F.countDistinct("side").alias("sides"))
    counts = times.groupBy("lecture_id").agg(F.count_if(F.col("sides") < 2).alias("alone"), F.abs(F.sum("surplus")).alias("surplus"))
    missing = known.join(stored.select("lecture_id", "path").distinct(), ["lecture_id", "path"], "left_anti").groupBy("lecture_id").agg(F.count("*").alias("missing"))
    joined = counts.join(missing, "lecture_id", "left")
    return _rows(joined, {"keyframe files match the metadata": (F.greatest("alone", "surplus"), "FAIL"), "every image path exists": (F.col("missing"), "FAIL")})


def check_keyframes(frames: DataFrame, lectures: DataFrame) -> DataFrame:
    """Existence, uniqueness, completeness of keyframes; image names agree with time stamps to a hundredth."""
    hundredth = lambda c: F.bround(c.cast("decimal(38,6)"), 2)
    named = frame_timestamp(F.coalesce("image_path", F.lit("")))
    counts = frames.groupBy("lecture_id").agg(
        F.count("*").alias("n"),
        (F.count("keyframe_timestamp") - F.countDistinct(hundredth(F.col("keyframe_timestamp")))).alias("twice"),
        F.count_if(F.col("description").isNull()).alias("no_description"), F.count_if(F.col("content_type").isNull()).alias("no_type"), F.count_if(F.col("cleaned_text").isNull()).alias("no_cleaned"),
        F.count_if(F.coalesce(F.abs(named - F.col("keyframe_timestamp")) > 0.0051, F.lit(True))).alias("unlike"),
        F.count_if(F.col("title") == "").alias("no_title"), F.count("slide_number").alias("numbers"),
    )
    first = _exist(lectures, frames, "keyframes exist")
    rest = _rows(
        counts,
        {
            "keyframe timestamps are unique": (F.col("twice"), "FAIL"), "vision has a description": (F.col("no_description"), "FAIL"), "vision has a content type": (F.col("no_type"), "FAIL"),
            "clean-up is complete": (F.col("no_cleaned"), "FAIL"), "image names match the metadata": (F.col("unlike"), "FAIL"), "keyframes without a title": (F.col("no_title"), "INFO"), "slide numbers": (F.col("numbers"), "INFO"),
        },
    )
    return first.unionByName(rest)


def content_types(frames: DataFrame) -> DataFrame:
    return frames.groupBy("lecture_id", F.coalesce("content_type", F.lit("none")).alias("content_type")).agg(F.count("*").alias("n"))


def check_objects(objects: DataFrame, frames: DataFrame, segments: DataFrame) -> DataFrame:
    """One object per keyframe, at its time and in its lecture; ends chain; no speech lost; silent slides; time covered."""
    usable = objects.filter("start_timestamp IS NOT NULL")
    chained = with_next(usable.select("object_id", "lecture_id", "start_timestamp", "end_timestamp", "transcript", "image_path"), "lecture_id", ["start_timestamp", "object_id"], F.struct(F.col("start_timestamp").alias("s")), "next")
    counts = chained.groupBy("lecture_id").agg(
        F.count("*").alias("n_objects"), F.count_if(F.col("next").isNotNull() & ~F.col("end_timestamp").eqNullSafe(F.col("next.s"))).alias("broken"),
        F.count_if(F.coalesce(F.col("end_timestamp") < F.col("start_timestamp"), F.lit(False))).alias("backwards"), F.sum(count_words(F.coalesce("transcript", F.lit("")))).alias("words"),
        F.count_if(strip(F.coalesce("transcript", F.lit(""))) == "").alias("silent"),
        F.count_if(F.coalesce(F.try_element_at(F.split("image_path", r"[\\/]"), F.lit(-3)) != F.col("lecture_id"), F.lit(False))).alias("astray"),
        F.floor((F.max(F.struct("start_timestamp", "object_id", "end_timestamp")).getField("end_timestamp") - F.min("start_timestamp")) / 60).alias("minutes"),
    )
    shots = frames.filter("keyframe_timestamp IS NOT NULL")
    per = shots.groupBy("lecture_id").agg(F.count("*").alias("n_frames"), F.min("keyframe_timestamp").alias("first"))
    apart = usable.select("lecture_id", "start_timestamp").join(shots.select("lecture_id", F.col("keyframe_timestamp").alias("start_timestamp")).distinct(), ["lecture_id", "start_timestamp"], "left_anti")
    apart = apart.groupBy("lecture_id").agg(F.count("*").alias("apart"))
    spoken = segments.filter("start_timestamp IS NOT NULL").join(per.select("lecture_id", "first"), "lecture_id")
    spoken = spoken.groupBy("lecture_id").agg(
        F.sum(F.when(F.col("start_timestamp") >= F.col("first"), count_words(F.coalesce("text", F.lit(""))))).alias("said"), F.sum(F.when(F.col("start_timestamp") < F.col("first"), count_words(F.coalesce("text", F.lit(""))))).alias("early")
    )
    joined = counts.join(per, "lecture_id", "full").join(apart, "lecture_id", "left").join(spoken, "lecture_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return _rows(
        joined,
        {
            "one object per keyframe": (F.abs(zero("n_objects") - zero("n_frames")), "FAIL"), "every object names its lecture": (F.col("astray"), "FAIL"), "objects start at their keyframe": (F.col("apart"), "FAIL"), "ends chain into the next start": (F.col("broken"), "FAIL"),
            "no object ends before it starts": (F.col("backwards"), "FAIL"), "no speech lost or duplicated": (F.abs(zero("words") - zero("said")), "FAIL"), "speech before the first keyframe": (F.col("early"), "WARN"),
            "slides nobody spoke during": (F.col("silent"), "WARN"), "minutes covered by the slides": (F.col("minutes"), "INFO"),
        },
    )


def silent_slides(objects: DataFrame) -> DataFrame:
    """``lecture_id, second`` of slides nobody spoke during."""
    return objects.filter("start_timestamp IS NOT NULL").filter(strip(F.coalesce("transcript", F.lit(""))) == "").select("lecture_id", F.col("start_timestamp").cast("bigint").alias("second"))


def check_alignment(aligned: DataFrame, segments: DataFrame, objects: DataFrame) -> DataFrame:
    """Every segment aligned, on some slide, and on the slide an independent as-of search finds."""
    heard = segments.filter("start_timestamp IS NOT NULL").select("segment_id", "lecture_id", "start_timestamp")
    spans = objects.filter("start_timestamp IS NOT NULL").select("lecture_id", F.col("start_timestamp").alias("slide"), F.coalesce("end_timestamp", F.lit(float("inf"))).alias("slide_end"))
    found = asof_backward(heard, spans, entity="lecture_id", left_time="start_timestamp", right_time="slide", payload=["slide", "slide_end"])
    both = found.join(aligned.select("segment_id", F.col("keyframe_timestamp").alias("stored"), F.lit(True).alias("there")), "segment_id", "left")
    outside = F.col("slide").isNotNull() & (F.col("start_timestamp") >= F.col("slide_end"))
    counts = both.groupBy("lecture_id").agg(
        F.count_if(F.col("there").isNull()).alias("missing"), F.count_if(F.coalesce(outside, F.lit(False))).alias("outside"), F.count_if(F.col("there").isNotNull() & ~F.coalesce(outside, F.lit(False)) & ~F.col("stored").eqNullSafe(F.col("slide"))).alias("other")
    )
    return _rows(counts, {"alignment covers every segment": (F.col("missing"), "FAIL"), "all speech is on some slide": (F.col("outside"), "FAIL"), "alignment agrees with the slide spans": (F.col("other"), "FAIL")})


def lost_speech(speech: DataFrame, chunks: DataFrame, size: float = SPEECH_CELL, most_cells: int = 1000) -> DataFrame:
    """``lecture_id, segment_id`` of ``speech(segment_id, lecture_id, s, e, said)`` that no chunk ``(lecture_id, cs, ce, held)``
    around its span holds.

    Speech meets the chunks of its cell of time only. Speech that ends before it starts, and chunks that would fill more than
    ``most_cells`` cells, meet by lecture instead; both are faults, and few.
    """
    wide = F.floor(F.col("ce") / size) - F.floor(F.col("cs") / size) > most_cells
    inside = (F.col("cs") <= F.col("s")) & (F.col("e") <= F.col("ce")) & F.contains(F.col("held"), F.col("said"))
    usable, whole = speech.filter("s IS NOT NULL AND e IS NOT NULL"), chunks.filter("cs IS NOT NULL AND ce IS NOT NULL")
    celled = whole.filter((F.col("cs") <= F.col("ce")) & ~wide).withColumn("cell", F.explode(F.sequence(F.floor(F.col("cs") / size), F.floor(F.col("ce") / size))))
    near = usable.filter("s <= e").withColumn("cell", F.floor(F.col("s") / size)).join(celled, ["lecture_id", "cell"]).filter(inside).select("segment_id")
    odd = usable.filter("s > e").join(whole, "lecture_id").filter(inside).select("segment_id")
    far = usable.filter("s <= e").join(whole.filter(wide), "lecture_id").filter(inside).select("segment_id")
    return speech.select("lecture_id", "segment_id").join(union([near, odd, far]).distinct(), "segment_id", "left_anti")


def check_chunks(chunks: DataFrame, objects: DataFrame, aligned: DataFrame, lectures: DataFrame, *, most_words: int = MOST_WORDS) -> DataFrame:
    """Links, sizes, times inside the listed slides, every slide and every piece of speech in some chunk."""
    usable = cut_lineage(chunks.filter("start_timestamp IS NOT NULL").select("chunk_id", "lecture_id", "start_timestamp", "end_timestamp", "text", "slide_timestamps", "prev_chunk_id", "next_chunk_id").withColumn("words", count_words(F.coalesce("text", F.lit("")))), "chunks")
    order = ["start_timestamp", "chunk_id"]
    linked = with_next(with_last(usable.drop("text", "slide_timestamps"), "lecture_id", order, F.col("chunk_id"), "before", strict=True), "lecture_id", order, F.col("chunk_id"), "after")
    counts = linked.groupBy("lecture_id").agg(
        F.count("*").alias("n"), (F.count("*") - F.countDistinct("chunk_id")).alias("twice"), F.count_if(~F.col("prev_chunk_id").eqNullSafe(F.col("before"))).alias("p"), F.count_if(~F.col("next_chunk_id").eqNullSafe(F.col("after"))).alias("x"),
        F.count_if(F.col("words") > most_words).alias("big"), F.min("words").alias("least"), F.max("words").alias("most"), upper_median(F.col("words")).alias("middle"),
    )
    slides = objects.filter("start_timestamp IS NOT NULL").groupBy("lecture_id", F.col("start_timestamp").alias("t")).agg(F.max("end_timestamp").alias("slide_end"))
    first = slides.groupBy("lecture_id").agg(F.min("t").alias("first"))
    listed = usable.select("lecture_id", "chunk_id", "start_timestamp", "end_timestamp", F.explode_outer("slide_timestamps").alias("t")).join(slides, ["lecture_id", "t"], "left").join(first, "lecture_id", "left")
    per = listed.groupBy("lecture_id", "chunk_id", "start_timestamp", "end_timestamp", "first").agg(
        F.count("t").alias("n"), F.count_if(F.col("t").isNotNull() & F.col("slide_end").isNull()).alias("unknown"), F.min("t").alias("earliest"), F.greatest(F.lit(0.0), F.max("slide_end")).alias("latest")
    )
    early = (F.col("start_timestamp") < F.col("earliest")) & (F.col("start_timestamp") >= F.col("first"))
    late = F.col("end_timestamp") > F.col("latest") + OVERRUN
    outside = (F.col("n") == 0) | (F.col("unknown") == 0) & F.coalesce(early | late, F.lit(False))
    times = per.groupBy("lecture_id").agg(F.count_if(outside).alias("outside"), F.count_if((F.col("n") > 0) & (F.col("unknown") > 0)).alias("unknown"))
    shown = usable.select("lecture_id", F.explode("slide_timestamps").alias("t")).distinct()
    uncovered = slides.join(shown, ["lecture_id", "t"], "left_anti").groupBy("lecture_id").agg(F.count("*").alias("uncovered"))
    speech = aligned.select("segment_id", "lecture_id", F.col("start_timestamp").alias("s"), F.col("end_timestamp").alias("e"), strip(F.coalesce("text", F.lit(""))).alias("said"))
    held = usable.select("lecture_id", F.col("start_timestamp").alias("cs"), F.col("end_timestamp").alias("ce"), F.col("text").alias("held"))
    lost = lost_speech(speech, held).groupBy("lecture_id").agg(F.count("*").alias("lost"))
    joined = counts.join(times, "lecture_id", "left").join(uncovered, "lecture_id", "left").join(lost, "lecture_id", "left")
    c = F.col
    return _exist(lectures, usable, "chunks exist").unionByName(_rows(
        joined,
        {
            "chunk ids are unique": (c("twice"), "FAIL"), "chunks point at the one before": (c("p"), "FAIL"), "chunks point at the next one": (c("x"), "FAIL"),
            "no chunk is over the maximum": (c("big"), "FAIL"), "smallest chunk": (c("least"), "INFO"), "median chunk": (c("middle"), "INFO"), "largest chunk": (c("most"), "INFO"),
            "chunk times lie inside their slides": (c("outside"), "FAIL"), "chunks list known slides": (c("unknown"), "FAIL"), "every slide is in some chunk": (c("uncovered"), "FAIL"), "all speech is in some chunk": (c("lost"), "FAIL"),
        },
    ))


def summary(results: DataFrame) -> DataFrame:
    """Lectures by check and status; the run fails if any row says FAIL."""
    return results.groupBy("check", "status").agg(F.count("*").alias("lectures"), F.sum("n").alias("n"))

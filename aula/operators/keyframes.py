"""Keyframe selection: a frame is kept if it differs enough from the last kept one, or if that is too long ago."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def select_keyframes(frames: DataFrame, *, entity: str, time: str, tie: str, value: str, area: float, longest_gap: float, pixel_threshold: float | None = None) -> DataFrame:
    """Kept rows ``entity, tie, time``. The first frame of an entity is kept; then one whose difference to the last
    kept frame is more than ``area``, or that lies ``longest_gap`` or more after it.

    ``value`` is a number (difference: absolute) or, with ``pixel_threshold``, an array (difference: share of values
    that differ by more than the threshold). The state is the last kept frame, past which the sorted frames of an entity
    are streamed; NULL times are left out.
    """
    kinds = frames.schema
    rows = frames.filter(F.col(time).isNotNull()).select(F.col(entity).alias("e"), F.col(tie).alias("i"), F.col(time).cast("double").alias("t"), F.col(value).alias("v"))

    def differs(a, b) -> float:
        if pixel_threshold is None:
            return abs(a - b) if a is not None and b is not None else 0.0
        if a is None or b is None or not len(a):
            return 0.0
        return float(np.mean(np.abs(np.asarray(a, float) - np.asarray(b, float)) > pixel_threshold))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, last_t, last_v = object(), 0.0, None
        for b in batches:
            keep = []
            for e, t, v in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                kept = e != own or differs(v, last_v) > area or t - last_t >= longest_gap
                if kept:
                    own, last_t, last_v = e, t, v
                keep.append(kept)
            yield b.select(["e", "i", "t"]).filter(pa.array(keep, pa.bool_()))

    ordered = rows.repartition("e").sortWithinPartitions("e", "t", "i")
    out = ordered.mapInArrow(run, f"e {kinds[entity].dataType.simpleString()}, i {kinds[tie].dataType.simpleString()}, t double")
    return out.withColumnsRenamed({"e": entity, "i": tie, "t": time})


def sample_times(videos: DataFrame, interval: float) -> DataFrame:
    """``videos(video_id, duration)``: sample times 0, interval, 2 interval ... before the end."""
    if interval <= 0:
        raise ValueError("interval must be positive")
    n = F.ceil(F.col("duration") / interval).cast("int")
    steps = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return videos.select("video_id", F.explode(steps).alias("k")).select("video_id", (F.col("k") * F.lit(float(interval))).alias("second"))

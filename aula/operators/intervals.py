"""Overlapping and gapped time intervals: merged periods and the gaps between them.

Spans are sorted by start per entity, each start is compared with the running maximum of the ends before it,
islands are numbered cumulatively, periods are aggregated by island and gaps derived from the same comparison.

An entity may hold a large share of all rows, so no window runs over an entity's spans. Spans are first reduced to
one row per entity and start (map-side combined), then ordered within an entity's *cell*, a fixed stretch of time,
which bounds a window by the number of milliseconds in a cell. Only one summary row per cell is ordered per entity, and
carries the running maximum and the number of islands from cell to cell.

Defined results: spans with a null bound, or an end not after the start, cover nothing; a null entity is an
entity of its own; touching spans merge; repeated spans change nothing; an empty table gives empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELL_MS = 3_600_000
#: Seconds beyond this are no usable time (the BIGINT range in ms is far wider); such spans cover nothing.
MAX_SECONDS = 1e15


def to_ms(seconds: Column) -> Column:
    """Whole milliseconds of a DOUBLE number of seconds; NULL for NaN and infinite values."""
    return F.when(F.abs(seconds) <= MAX_SECONDS, F.round(seconds * 1000).cast("bigint"))


def _labelled(spans: DataFrame, keys: list[str], start: str, end: str, cell_ms: int) -> DataFrame:
    """Distinct starts with ``_s, _e, _prior`` (largest end before), ``_new`` (opens an island) and ``_cell``."""
    cut = spans.select(*keys, F.col(start).alias("_s"), F.col(end).alias("_e")).filter("_e > _s")
    cell = F.floor(F.col("_s") / F.lit(cell_ms)).cast("bigint")
    starts = cut.groupBy(*keys, cell.alias("_cell"), "_s").agg(F.max("_e").alias("_e"))
    within = Window.partitionBy(*keys, "_cell").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.withColumn("_run", F.max("_e").over(within))
    cells = starts.groupBy(*keys, "_cell").agg(F.max("_e").alias("_top"))
    before = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    carried = cells.select(*keys, "_cell", F.max("_top").over(before).alias("_carry"))
    joined = _join_cells(starts, carried, keys)
    prior = F.greatest("_run", "_carry")
    return joined.withColumn("_prior", prior).withColumn(
        "_new", F.when(F.col("_prior").isNull() | (F.col("_s") > F.col("_prior")), 1).otherwise(0)
    )


def _join_cells(rows: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """Join on null-safe keys and cell."""
    renamed = cells.select(*[F.col(k).alias(f"_r{i}") for i, k in enumerate([*keys, "_cell"])], *[c for c in cells.columns if c not in keys and c != "_cell"])
    on = [rows[k].eqNullSafe(renamed[f"_r{i}"]) for i, k in enumerate(keys)] + [rows["_cell"] == renamed[f"_r{len(keys)}"]]
    return rows.join(renamed, on, "left").drop(*[f"_r{i}" for i in range(len(keys) + 1)])


def gaps(spans: DataFrame, keys: list[str], start: str = "start_ms", end: str = "end_ms", *, longest_ms: int | None = None, cell_ms: int = CELL_MS) -> DataFrame:
    """``keys, gap_start_ms, gap_end_ms``: every longest stretch between covered times that no span covers.

    Gaps of ``longest_ms`` or more are left out (a pause, not a gap).
    """
    found = _labelled(spans, keys, start, end, cell_ms).filter("_s > _prior")
    if longest_ms is not None:
        found = found.filter(F.col("_s") - F.col("_prior") < longest_ms)
    return found.select(*keys, F.col("_prior").alias("gap_start_ms"), F.col("_s").alias("gap_end_ms"))


def periods(spans: DataFrame, keys: list[str], start: str = "start_ms", end: str = "end_ms", *, cell_ms: int = CELL_MS) -> DataFrame:
    """``keys, period_no, period_start_ms, period_end_ms``: merged continuous periods, numbered from 1 per entity."""
    rows = _labelled(spans, keys, start, end, cell_ms)
    within = Window.partitionBy(*keys, "_cell").orderBy("_s").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_no", F.sum("_new").over(within))
    cells = rows.groupBy(*keys, "_cell").agg(F.sum("_new").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    carried = cells.select(*keys, "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_earlier"))
    numbered = _join_cells(rows, carried, keys).withColumn("period_no", F.col("_no") + F.col("_earlier"))
    return numbered.groupBy(*keys, "period_no").agg(F.min("_s").alias("period_start_ms"), F.max("_e").alias("period_end_ms"))

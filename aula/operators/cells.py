"""Neighbours in time within an entity, without a window over all of an entity's rows.

Rows are ordered within an entity's *cell*, a fixed stretch of time; one summary row per cell is ordered per entity and
carries the neighbour from cell to cell. An entity that holds a large share of all rows is thus worked on in parallel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELL = 3600.0


def cell_of(time: Column, size: float) -> Column:
    return F.floor(time / F.lit(size)).cast("bigint")


def _join(rows: DataFrame, carried: DataFrame, entity: str) -> DataFrame:
    right = carried.withColumnsRenamed({entity: "_ce", "_cell": "_cc"})
    on = rows[entity].eqNullSafe(right["_ce"]) & rows["_cell"].eqNullSafe(right["_cc"])
    return rows.join(right, on, "left").drop("_ce", "_cc")


def with_last(df: DataFrame, entity: str, order: list[str], value: Column, out: str, *, size: float = CELL, strict: bool = False) -> DataFrame:
    """``out``: the last non-null ``value`` at or before each row (``strict``: before it) in ``order``, whose first
    column is the numeric time that makes the cells."""
    rows = df.withColumn("_cell", cell_of(F.col(order[0]), size)).withColumn("_value", value)
    within = Window.partitionBy(entity, "_cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if strict else 0)
    rows = rows.withColumn("_own", F.last("_value", ignorenulls=True).over(within))
    last = F.max(F.when(F.col("_value").isNotNull(), F.struct(*[F.col(c) for c in order], F.col("_value").alias("_v"))))
    cells = rows.groupBy(entity, "_cell").agg(last.getField("_v").alias("_last"))
    before = Window.partitionBy(entity).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    carried = cells.select(entity, "_cell", F.last("_last", ignorenulls=True).over(before).alias("_carry"))
    return _join(rows, carried, entity).withColumn(out, F.coalesce("_own", "_carry")).drop("_cell", "_value", "_own", "_carry")


def with_next(df: DataFrame, entity: str, order: list[str], value: Column, out: str, *, size: float = CELL) -> DataFrame:
    """``out``: the ``value`` of the next row in ``order`` (NULL values count as rows)."""
    rows = df.withColumn("_cell", cell_of(F.col(order[0]), size)).withColumn("_value", F.struct(value.alias("v")))
    within = Window.partitionBy(entity, "_cell").orderBy(*order)
    rows = rows.withColumn("_own", F.lead("_value").over(within))
    cells = rows.groupBy(entity, "_cell").agg(F.min(F.struct(*order, "_value")).getField("_value").alias("_first"))
    after = Window.partitionBy(entity).orderBy("_cell")
    carried = cells.select(entity, "_cell", F.lead("_first").over(after).alias("_carry"))
    return _join(rows, carried, entity).withColumn(out, F.coalesce("_own", "_carry").getField("v")).drop("_cell", "_value", "_own", "_carry")


def asof_backward(left: DataFrame, right: DataFrame, *, entity: str, left_time: str, right_time: str, payload: list[str], size: float = CELL) -> DataFrame:
    """``left`` with ``payload`` of the last right row of its entity at or before its time (NULL where there is none).

    Of several right rows at one time the one with the largest payload counts. Left rows without a time or an
    entity match nothing.
    """
    kept = [c for c in left.columns]
    rights = right.filter(F.col(entity).isNotNull() & F.col(right_time).isNotNull())
    rights = rights.groupBy(F.col(entity).alias("_e"), F.col(right_time).cast("double").alias("_t")).agg(F.max(F.struct(*payload)).alias("_p"))
    lefts = left.select(F.struct(*kept).alias("_row"), F.col(entity).alias("_e"), F.col(left_time).cast("double").alias("_t"))
    both = lefts.select("_e", "_t", F.lit(1).alias("_side"), "_row", F.lit(None).cast(rights.schema["_p"].dataType).alias("_p")).unionByName(
        rights.select("_e", "_t", F.lit(0).alias("_side"), F.lit(None).cast(lefts.schema["_row"].dataType).alias("_row"), "_p")
    )
    seen = with_last(both, "_e", ["_t", "_side"], F.col("_p"), "_found", size=size).filter("_side = 1")
    usable = F.col("_e").isNotNull() & F.col("_t").isNotNull()
    return seen.select("_row.*", *[F.when(usable, F.col(f"_found.{c}")).alias(f"right_{c}" if c in kept else c) for c in payload])

"""Problem 3: matching records by nearest time.

Both tables are co-grouped by entity and *cell* (a fixed stretch of time); a right record also enters the cells within
the tolerance of its time, so that the margins of cells overlap. In a co-group, a vectorised binary search places all
left times among the sorted right times and compares the two neighbours.

An entity may hold a large share of all rows: cells cut it along time. A cell with more left rows than ``cell_rows`` is
split further by a salt, and its right rows go to every salt. Right rows are first reduced to one per entity and time
(map-side combined), which bounds them by the number of distinct times in a cell.

Defined results: rows with a NULL entity, or a NULL, NaN or infinite time, match nothing; the distance may equal
the tolerance; of two equally near times the earlier one is taken, of several right records at that time the smallest
key; left rows without a match give no row; repeated left rows give repeated rows; empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CELL_SECONDS = 3600.0
CELL_ROWS = 500_000


def _usable(c: Column) -> Column:
    return c.isNotNull() & (F.abs(c) < 1e15)


def nearest(
    left: DataFrame,
    right: DataFrame,
    *,
    entity: str,
    left_key: str,
    left_time: str,
    right_key: str,
    right_time: str,
    tolerance: float,
    cell_seconds: float = CELL_SECONDS,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """``left_key, right_key, distance`` for each left row that has a right row of its entity within ``tolerance``."""
    if not 0 <= tolerance or cell_seconds <= 2 * tolerance:
        raise ValueError("a cell must be longer than two tolerances")
    cell = lambda t: F.floor(t / F.lit(float(cell_seconds))).cast("bigint")
    lefts = left.select(F.col(entity).alias("entity"), F.col(left_key).alias("lk"), F.col(left_time).cast("double").alias("lt"))
    lefts = lefts.filter(F.col("entity").isNotNull() & _usable(F.col("lt"))).withColumn("cell", cell(F.col("lt")))
    rights = right.select(F.col(entity).alias("entity"), F.col(right_key).alias("rk"), F.col(right_time).cast("double").alias("rt"))
    rights = rights.filter(F.col("entity").isNotNull() & F.col("rk").isNotNull() & _usable(F.col("rt")))
    rights = rights.groupBy("entity", "rt").agg(F.min("rk").alias("rk"))
    cells = F.array_distinct(F.array(cell(F.col("rt") - tolerance), cell(F.col("rt")), cell(F.col("rt") + tolerance)))
    rights = rights.withColumn("cell", F.explode(cells))

    # crowded cells are few by definition: at most (left rows / cell_rows)
    crowded = lefts.groupBy("entity", "cell").agg(F.count("*").alias("n")).filter(F.col("n") > cell_rows)
    crowded = crowded.select("entity", "cell", F.ceil(F.col("n") / cell_rows).cast("int").alias("salts"))
    lefts = lefts.join(crowded, ["entity", "cell"], "left").withColumn(
        "salt", F.when(F.col("salts").isNull(), 0).otherwise(F.pmod(F.xxhash64("lk", "lt"), F.col("salts"))).cast("int")
    )
    rights = rights.join(crowded, ["entity", "cell"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)))

    schema = T.StructType([T.StructField("lk", left.schema[left_key].dataType), T.StructField("rk", right.schema[right_key].dataType), T.StructField("distance", T.DoubleType())])

    def match(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table({"lk": a["lk"].slice(0, 0), "rk": b["rk"].slice(0, 0), "distance": pa.array([], pa.float64())})
        rt = b["rt"].to_numpy()
        order = np.argsort(rt, kind="stable")
        rt, lt = rt[order], a["lt"].to_numpy()
        at = np.searchsorted(rt, lt)
        before, after = np.maximum(at - 1, 0), np.minimum(at, len(rt) - 1)
        to_before, to_after = np.abs(lt - rt[before]), np.abs(rt[after] - lt)
        best = np.where(to_before <= to_after, before, after)
        distance = np.minimum(to_before, to_after)
        ok = distance <= tolerance
        return pa.table({"lk": a["lk"].filter(pa.array(ok)), "rk": b["rk"].take(pa.array(order[best[ok]])), "distance": pa.array(distance[ok])})

    keys = ("entity", "cell", "salt")
    made = lefts.select(*keys, "lk", "lt").groupBy(*keys).cogroup(rights.select(*keys, "rk", "rt").groupBy(*keys)).applyInArrow(match, schema)
    return made.select(F.col("lk").alias(left_key), F.col("rk").alias(right_key), "distance")

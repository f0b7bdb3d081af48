"""Problem 7: filling fixed-capacity containers with items.

The size of a text is its number of UTF-8 bytes plus one end token (a public byte-level tokenizer). A text larger than
a container is cut, at character borders, into pieces that each fill a container as far as possible; every other text
stays whole.

Method: optimal length buckets. The histogram of sizes has at most ``capacity`` entries, however large the data. A
dynamic programme over it chooses the bucket boundaries that minimise padding (the sum of boundary minus size). Batches
with a token budget of one container are then formed inside each bucket, from the bucket with the largest items to
the one with the smallest. Buckets of large items leave room in every batch; it is topped up with the largest items that
fit, of the same bucket first. All of this happens on the histogram: the plan says which ranks of a size go to which
containers, and has a bounded number of lines. Items learn their rank among those of equal size in a distributed way
(counted by size and salt, then ordered within a salt), as one size may hold a large share of all rows, and look up
their container by binary search.

Defined results: a NULL text is left out; an empty text has one token; repeated rows are items of their own;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aula.session import cut_lineage

CAPACITY = 8192
BUCKETS = 16
SALTS = 128


def piece_bounds(data: bytes, capacity: int) -> list[tuple[int, int]]:
    """Byte bounds of pieces of at most ``capacity`` tokens; the last one also holds the end token."""
    out, start = [], 0
    while len(data) - start + 1 > capacity:
        end = start + capacity
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end -= 1
        out.append((start, end))
        start = end
    out.append((start, len(data)))
    return out


def sized_items(df: DataFrame, key: str, text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """``key, piece_no, n_pieces, first_byte, end_byte, n_tokens``; only texts above the capacity pass through Python."""
    if capacity < 4:
        raise ValueError("a container must hold one character")
    rows = df.filter(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"), F.octet_length(text).cast("bigint").alias("b"))
    whole = rows.filter(F.col("b") + 1 <= capacity).select("k", F.lit(1).alias("piece_no"), F.lit(1).alias("n_pieces"), F.lit(0).cast("bigint").alias("first_byte"), F.col("b").alias("end_byte"), (F.col("b") + 1).cast("int").alias("n_tokens"))
    schema = T.StructType(
        [T.StructField("k", df.schema[key].dataType), T.StructField("piece_no", T.IntegerType()), T.StructField("n_pieces", T.IntegerType())]
        + [T.StructField("first_byte", T.LongType()), T.StructField("end_byte", T.LongType()), T.StructField("n_tokens", T.IntegerType())]
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, rows_ = [], []
            for i, t in enumerate(b.column(1)):
                own = piece_bounds(t.as_buffer().to_pybytes(), capacity)
                for no, (s, e) in enumerate(own, 1):
                    at.append(i)
                    rows_.append((no, len(own), s, e, e - s + (no == len(own))))
            cols = [pa.array([r[k] for r in rows_], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *cols], schema.names)

    cut_up = rows.filter(F.col("b") + 1 > capacity).select("k", "t").mapInArrow(cut, schema)
    return whole.unionByName(cut_up).withColumnRenamed("k", key)


def bucket_boundaries(sizes: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets with the least padding. ``sizes`` ascending and distinct."""
    n = len(sizes)
    if n == 0:
        return []
    number = np.concatenate([[0], np.cumsum(counts)]).astype(np.float64)
    tokens = np.concatenate([[0], np.cumsum(counts * sizes)]).astype(np.float64)
    # best[j]: least padding of the first j sizes; a bucket (i, j] costs sizes[j-1] * items - tokens
    best = sizes[np.maximum(np.arange(n + 1) - 1, 0)] * number - tokens
    best[0] = 0
    back = [np.zeros(n + 1, np.int64)]
    for _ in range(1, min(buckets, n)):
        new, at = best.copy(), np.zeros(n + 1, np.int64)
        for j in range(1, n + 1):
            cost = best[:j] + sizes[j - 1] * (number[j] - number[:j]) - (tokens[j] - tokens[:j])
            i = int(cost.argmin())
            new[j], at[j] = cost[i], i
        back.append(at)
        best = new
    out, j, layer = [], n, len(back) - 1
    while j > 0:
        out.append(int(sizes[j - 1]))
        j = int(back[layer][j])
        layer = max(layer - 1, 0)
    return out[::-1]


def container_plan(sizes: np.ndarray, counts: np.ndarray, capacity: int, bounds: list[int]) -> dict[str, np.ndarray]:
    """Lines (size, first rank, first container, items per container): rank r of a size is in container
    first_container + (r - first_rank) // per."""
    left = {int(s): int(c) for s, c in zip(sizes, counts)}
    used = dict.fromkeys(left, 0)
    order = np.array(sorted(left), np.int64)  # sizes that still have items, ascending
    lines: list[tuple[int, int, int, int]] = []
    next_container = 0

    def take(size: int, containers: int, first: int, per: int) -> None:
        nonlocal order
        lines.append((size, used[size], first, per))
        used[size] += containers * per
        left[size] -= containers * per
        if not left[size]:
            order = np.delete(order, np.searchsorted(order, size))

    def fill(first: int, number: int, free: int) -> None:
        """Top up ``number`` equal containers, largest fitting size first; where a size runs short, they part."""
        work = [(first, number, free)]
        while work:
            first, number, free = work.pop()
            while number and free:
                i = int(np.searchsorted(order, free, side="right")) - 1
                if i < 0:
                    break
                size = int(order[i])
                per = min(free // size, left[size])
                whole = min(number, left[size] // per)
                take(size, whole, first, per)
                if whole < number:
                    work.append((first + whole, number - whole, free))
                    number = whole
                free -= per * size

    lower = [0, *bounds[:-1]]
    for lo, hi in reversed(list(zip(lower, bounds))):
        while True:
            i = int(np.searchsorted(order, hi, side="right")) - 1
            if i < 0 or order[i] <= lo:
                break
            size = int(order[i])
            per = min(capacity // size, left[size])
            number = left[size] // per
            first = next_container
            next_container += number
            take(size, number, first, per)
            fill(first, number, capacity - per * size)
    lines.sort()
    names = ("size", "first_rank", "first_container", "per")
    return {k: np.array([x[i] for x in lines], np.int64) for i, k in enumerate(names)}


def pack(df: DataFrame, key: str, text: str = "text", *, capacity: int = CAPACITY, buckets: int = BUCKETS) -> DataFrame:
    """``sized_items`` with ``bucket_tokens`` (upper bound of the item's bucket) and ``container_id``."""
    items = cut_lineage(sized_items(df, key, text, capacity), "items")
    hist = np.array(sorted((r[0], r[1]) for r in items.groupBy("n_tokens").count().collect()), np.int64).reshape(-1, 2)  # at most ``capacity`` rows
    bounds = bucket_boundaries(hist[:, 0], hist[:, 1], buckets)
    plan = container_plan(hist[:, 0], hist[:, 1], capacity, bounds)

    salted = items.withColumn("salt", F.pmod(F.xxhash64(key, "piece_no"), F.lit(SALTS)).cast("int"))
    cells = salted.groupBy("n_tokens", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("n_tokens").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select("n_tokens", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("n_tokens", "salt").orderBy(key, "piece_no")
    ranked = salted.withColumn("rank", F.row_number().over(within) - 1).join(offsets, ["n_tokens", "salt"])
    ranked = ranked.select(key, "piece_no", "n_pieces", "first_byte", "end_byte", "n_tokens", (F.col("rank") + F.col("offset")).alias("rank"))

    line_key = (plan["size"] << 48) | plan["first_rank"]
    edges = np.array(bounds, np.int64)
    schema = T.StructType([f for f in ranked.schema if f.name != "rank"] + [T.StructField("bucket_tokens", T.IntegerType()), T.StructField("container_id", T.LongType())])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, rank = b.column(5).to_numpy().astype(np.int64), b.column(6).to_numpy()
            at = np.searchsorted(line_key, (size << 48) | rank, side="right") - 1
            container = plan["first_container"][at] + (rank - plan["first_rank"][at]) // plan["per"][at]
            bucket = edges[np.searchsorted(edges, size)] if len(edges) else size
            yield pa.RecordBatch.from_arrays([*b.columns[:6], pa.array(bucket.astype(np.int32)), pa.array(container)], schema.names)

    return ranked.mapInArrow(assign, schema)

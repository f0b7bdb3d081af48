"""Problem 8: evaluation texts leaking into training text.

Method: winnowing. Of every ``window`` consecutive hashes of ``k`` words the smallest is kept as a fingerprint (of
equal ones the last). With k + window - 1 = ``shared`` words, two texts that have ``shared`` consecutive words in
common have a fingerprint in common. Fingerprints of the corpus are joined with those of the test texts and every hit is
extended to both sides, word by word; hits that grow to ``shared`` words or more are leaks.

The test side is stated and small. If it has at most ``resident_words`` words, which is counted, each task holds its
fingerprints and words; the corpus is then read once, nothing of it is shuffled and only leaks leave a task. A larger
test side is joined by a shuffle on the fingerprint, each fingerprint carrying the words around it.

Defined results: NULL texts hold nothing; texts of fewer than ``shared`` words match nothing; a leak is reported once
per record, item and field with its longest run; repeated rows are reported once; an empty side gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aula.llm.folding import gram_hashes, word_hashes

SHARED = 12
K = 8
#: Words of all test texts that a task may hold (16 bytes each with their fingerprints).
RESIDENT_WORDS = 4_000_000
BLOCK_CHARS = 500_000


def fingerprints(words: np.ndarray, bounds: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Word positions of the fingerprints and their hashes, for texts laid end to end."""
    grams = gram_hashes(words, k)
    if len(grams) < window:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    # the last of equal minima: search the reversed windows
    views = np.lib.stride_tricks.sliding_window_view(grams, window)
    best = views[:, window - 1].copy()
    at = np.full(len(views), window - 1, np.int64)
    for i in range(window - 2, -1, -1):
        less = views[:, i] < best
        best[less], at[less] = views[less, i], i
    span = k + window - 1
    text = np.searchsorted(bounds, np.arange(len(views)), side="right") - 1
    inside = np.arange(len(views)) + span <= bounds[text + 1]
    keep = np.zeros(len(grams), bool)
    keep[(np.arange(len(views)) + at)[inside]] = True
    places = np.flatnonzero(keep)
    return places, grams[places]


class TestSide:
    """Words and fingerprints of all test texts, sorted by fingerprint."""

    __test__ = False  # not a test case

    def __init__(self, rows: list[tuple], k: int, window: int) -> None:
        self.rows = [(item, field) for item, field, _ in rows]
        self.words, self.bounds = word_hashes([t for _, _, t in rows])
        places, hashes = fingerprints(self.words, self.bounds, k, window)
        order = np.argsort(hashes, kind="stable")
        self.places, self.hashes = places[order], hashes[order]

    def candidates(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (index into ``hashes``, word position on the test side) with equal fingerprints."""
        low, high = np.searchsorted(self.hashes, hashes, "left"), np.searchsorted(self.hashes, hashes, "right")
        n = high - low
        i = np.repeat(np.arange(len(hashes)), n)
        j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        return i, self.places[j]


def extend(a: np.ndarray, p: np.ndarray, a_low: np.ndarray, a_high: np.ndarray, b: np.ndarray, q: np.ndarray, b_low: np.ndarray, b_high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word and number of words of the longest equal run through words p of ``a`` and q of ``b``."""
    left, right = np.zeros(len(p), np.int64), np.zeros(len(p), np.int64)
    going = np.arange(len(p))
    while len(going):
        x, y = p[going] - left[going] - 1, q[going] - left[going] - 1
        ok = (x >= a_low[going]) & (y >= b_low[going])
        going, x, y = going[ok], x[ok], y[ok]
        going = going[a[x] == b[y]]
        left[going] += 1
    going = np.arange(len(p))
    while len(going):
        x, y = p[going] + right[going], q[going] + right[going]
        ok = (x < a_high[going]) & (y < b_high[going])
        going, x, y = going[ok], x[ok], y[ok]
        going = going[a[x] == b[y]]
        right[going] += 1
    return p - left, left + right


def _blocks(b: pa.RecordBatch) -> Iterator[tuple[list[int], list[str]]]:
    at, texts, size = [], [], 0
    for i, t in enumerate(b.column(1).to_pylist()):
        at.append(i)
        texts.append(t)
        size += len(t)
        if size >= BLOCK_CHARS:
            yield at, texts
            at, texts, size = [], [], 0
    if at:
        yield at, texts


def leaks(
    corpus: DataFrame,
    tests: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    fields: tuple[str, ...] = ("question", "reference_answer", "passage"),
    shared: int = SHARED,
    k: int = K,
    resident_words: int = RESIDENT_WORDS,
) -> DataFrame:
    """``key, item, field, first_word, n_words``: the longest shared run per record, item and field."""
    window = shared - k + 1
    if not 1 <= k <= shared:
        raise ValueError("k must lie between 1 and the number of shared words")
    schema = T.StructType([T.StructField("k", corpus.schema[key].dataType), T.StructField("item", tests.schema[item].dataType), T.StructField("field", T.StringType()), T.StructField("first_word", T.LongType()), T.StructField("n_words", T.LongType())])
    parts = [tests.select(F.col(item).alias("item"), F.lit(f).alias("field"), F.col(f).cast("string").alias("text")) for f in fields]
    sides = parts[0]
    for p in parts[1:]:
        sides = sides.unionByName(p)
    sides = sides.filter(F.col("text").isNotNull() & F.col("item").isNotNull())
    rows = corpus.filter(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("text"))
    # an upper bound of the words: every second character can begin one
    words = sides.agg(F.coalesce(F.sum((F.length("text") + 1) / 2), F.lit(0.0))).collect()[0][0]
    found = _resident(rows, sides, schema, shared, k, window) if words <= resident_words else _shuffled(rows, sides, schema, shared, k, window)
    best = found.groupBy("k", "item", "field").agg(F.min(F.struct((-F.col("n_words")).alias("n"), "first_word")).alias("r"))
    return best.select(F.col("k").alias(key), F.col("item").alias(item), "field", F.col("r.first_word").alias("first_word"), (-F.col("r.n")).alias("n_words"))


def _resident(rows: DataFrame, sides: DataFrame, schema: T.StructType, shared: int, k: int, window: int) -> DataFrame:
    side = TestSide([tuple(r) for r in sides.collect()], k, window)  # counted above
    shared_side = rows.sparkSession.sparkContext.broadcast(side)
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = shared_side.value
        items = pa.array([r[0] for r in test.rows])
        fields = pa.array([r[1] for r in test.rows], pa.string())
        for b in batches:
            for at, texts in _blocks(b):
                w, bounds = word_hashes(texts)
                places, hashes = fingerprints(w, bounds, k, window)
                i, q = test.candidates(hashes)
                if not len(i):
                    continue
                p = places[i]
                doc = np.searchsorted(bounds, p, side="right") - 1
                own = np.searchsorted(test.bounds, q, side="right") - 1
                first, n = extend(w, p, bounds[doc], bounds[doc + 1], test.words, q, test.bounds[own], test.bounds[own + 1])
                ok = n >= shared
                # many fingerprints lie in one run: each run leaves once
                runs = np.unique(np.stack([doc[ok], own[ok], first[ok] - bounds[doc[ok]], n[ok]], 1), axis=0)
                if len(runs):
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(pa.array(np.array(at)[runs[:, 0]])), items.take(pa.array(runs[:, 1])).cast(pa_type), fields.take(pa.array(runs[:, 1])), pa.array(runs[:, 2]), pa.array(runs[:, 3])], names
                    )

    from pyspark.sql.pandas.types import to_arrow_type

    pa_type = to_arrow_type(schema["item"].dataType)
    return rows.mapInArrow(run, schema)


def _shuffled(rows: DataFrame, sides: DataFrame, schema: T.StructType, shared: int, k: int, window: int) -> DataFrame:
    """A hit carries up to ``shared`` words on either side of a fingerprint, which is enough to tell a leak.

    The pieces of one run lie on one diagonal (the same distance between the two places) and overlap or adjoin, as
    every ``window`` hashes of the run hold a fingerprint; they are put together afterwards.
    """
    around = "h bigint, place bigint, words array<bigint>, at int"

    def prints(df: DataFrame, columns: list[str]) -> DataFrame:
        fields = [df.schema[c] for c in columns]
        out = T.StructType([*fields, *T._parse_datatype_string(around).fields])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                others = b.select(columns)
                narrow = pa.RecordBatch.from_arrays([b.column(0), b.column(b.num_columns - 1)], ["k", "text"])
                for at, texts in _blocks(narrow):
                    w, bounds = word_hashes(texts)
                    places, hashes = fingerprints(w, bounds, k, window)
                    doc = np.searchsorted(bounds, places, side="right") - 1
                    low, high = np.maximum(places - shared, bounds[doc]), np.minimum(places + shared, bounds[doc + 1])
                    n = high - low
                    flat = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(w[flat].view(np.int64)))
                    cols = [others.column(c).take(pa.array(np.array(at)[doc])) for c in columns]
                    yield pa.RecordBatch.from_arrays([*cols, pa.array(hashes.view(np.int64)), pa.array(places - bounds[doc]), lists, pa.array((places - low).astype(np.int32))], out.names)

        return df.select(*columns, "text").mapInArrow(run, out)

    # texts of one key that differ have runs of their own
    a = prints(rows.withColumn("doc", F.xxhash64("text")), ["k", "doc"])
    b = prints(sides.withColumn("other_doc", F.xxhash64("text")), ["item", "field", "other_doc"]).select("item", "field", "other_doc", "h", F.col("place").alias("other_place"), F.col("words").alias("other"), F.col("at").alias("other_at"))
    pairs = a.join(b, "h").select("k", "item", "field", "place", "words", "at", "other", "other_at", "other_place", "doc", "other_doc")
    pieces = T.StructType([*schema.fields, *(T.StructField(c, T.LongType()) for c in ("diagonal", "doc", "other_doc"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(4), batch.column(6)
            xo, yo = x.offsets.to_numpy().astype(np.int64), y.offsets.to_numpy().astype(np.int64)
            xv, yv = x.values.to_numpy(), y.values.to_numpy()
            p, q = xo[:-1] + batch.column(5).to_numpy(), yo[:-1] + batch.column(7).to_numpy()
            first, n = extend(xv, p, xo[:-1], xo[1:], yv, q, yo[:-1], yo[1:])
            ok = n >= shared
            at = batch.column(3).to_numpy()
            place, diagonal = at - (p - first), at - batch.column(8).to_numpy()
            keep = pa.array(ok)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep), batch.column(2).filter(keep), pa.array(place[ok]), pa.array(n[ok]), pa.array(diagonal[ok]), batch.column(9).filter(keep), batch.column(10).filter(keep)], pieces.names)

    own = ["k", "doc", "item", "field", "other_doc", "diagonal"]
    line = Window.partitionBy(*own).orderBy("first_word", "end")
    found = pairs.mapInArrow(run, pieces).withColumn("end", F.col("first_word") + F.col("n_words"))
    parted = found.withColumn("reach", F.max("end").over(line.rowsBetween(Window.unboundedPreceding, -1)))
    numbered = parted.withColumn("run", F.count_if(F.coalesce(F.col("first_word") > F.col("reach"), F.lit(True))).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    whole = numbered.groupBy(*own, "run").agg(F.min("first_word").alias("first_word"), F.max("end").alias("end"))
    return whole.select("k", "item", "field", "first_word", (F.col("end") - F.col("first_word")).alias("n_words"))

"""Problem 4: frequency of every distinct value or term.

1. *Blocks.* Each task counts blocks of records: it codes a block's terms with numbers of its own and keeps two count arrays
   over them, one for occurrences and one for records. A term leaves a block once, however often it occurs.
2. *Dictionary.* The distinct terms of all blocks get global identifiers 0, 1, 2 ... without gaps: they are ranked within
   hash ranges, and a range begins where the ones before end. Identifiers depend on the terms only, not on the tasks.
3. *Encoding.* The blocks' terms are replaced by their identifiers.
4. *Sums.* Encoded counts are shuffled by identifier range and added up in two arrays per range, indexed by identifier.
5. The dictionary gives the terms back.

Nothing global is held in one place: texts are read once, and blocks and dictionary are tables.

Terms are the lines of a text, lowercased, without leading and trailing characters other than letters, digits and
underscore; empty ones are dropped.

Defined results: NULL and empty texts have no term; each input row is one record (queries pass one row per record);
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aula.session import cut_lineage

#: Distinct terms after which a task sends its block; bounds its memory.
BLOCK_TERMS = 200_000
#: Hash ranges in which terms are ranked; only their sizes are known everywhere.
RANGES = 4096
#: Identifiers whose counts are added up in one pair of arrays.
RANGE_SIZE = 1 << 16
EDGE = r"^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$"

RARE_BELOW = 3
COMMON_PERCENT = 20


def lines_as_terms(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of a batch of texts and, for each, the position of its record."""
    lists = pc.split_pattern(text, "\n")
    flat = pc.list_flatten(lists)
    record = pc.list_parent_indices(lists).to_numpy()
    terms = pc.replace_substring_regex(pc.utf8_lower(flat), EDGE, "")
    kept = pc.greater(pc.binary_length(terms), 0)
    return terms.filter(kept), record[kept.to_numpy(zero_copy_only=False)]


def _count_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codes: dict[str, int] = {}
    occurrences, presence = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)

    def send() -> pa.RecordBatch:
        n = len(codes)
        return pa.RecordBatch.from_arrays([pa.array(list(codes), pa.string()), pa.array(occurrences[:n]), pa.array(presence[:n])], ["term", "n_occurrences", "n_records"])

    for b in batches:
        terms, record = lines_as_terms(b.column(0))
        if not len(terms):
            continue
        local = terms.dictionary_encode()
        own = local.indices.to_numpy()
        size = len(local.dictionary)
        # occurrences and distinct records of each of the batch's own codes
        count = np.bincount(own, minlength=size)
        pairs = np.unique(record.astype(np.int64) * size + own)
        there = np.bincount(pairs % size, minlength=size)
        at = np.fromiter((codes.setdefault(t, len(codes)) for t in local.dictionary.to_pylist()), np.int64, size)
        if len(codes) > len(occurrences):
            more = 2 * len(codes) - len(occurrences)
            occurrences, presence = np.pad(occurrences, (0, more)), np.pad(presence, (0, more))
        occurrences[at] += count
        presence[at] += there
        if len(codes) >= BLOCK_TERMS:
            yield send()
            codes = {}
            occurrences[:], presence[:] = 0, 0
    if codes:
        yield send()


def global_dictionary(terms: DataFrame, ranges: int = RANGES) -> DataFrame:
    """``term, term_id``: the distinct ``term`` of all rows, numbered from 0 without gaps."""
    distinct = terms.select("term").distinct().select("term", F.pmod(F.xxhash64("term"), F.lit(ranges)).cast("int").alias("range"))
    ranked = cut_lineage(distinct.withColumn("rank", F.row_number().over(Window.partitionBy("range").orderBy("term"))), "ranks")
    sizes = ranked.groupBy("range").agg(F.count("*").alias("n"))
    begins = sizes.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("begin"))
    return ranked.join(F.broadcast(begins), "range").select("term", (F.col("begin") + F.col("rank") - 1).alias("term_id"))  # at most one row a range


def _add_arrays(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays: dict[int, np.ndarray] = {}
        for b in batches:
            ids, counts = b.column(0).to_numpy(), np.stack([b.column(1).to_numpy(), b.column(2).to_numpy()])
            own = ids // size
            for r in np.unique(own):
                here = own == r
                at = arrays.setdefault(int(r), np.zeros((2, size), np.int64))
                for k in (0, 1):
                    np.add.at(at[k], ids[here] - r * size, counts[k, here])
        for r, (occurrences, presence) in arrays.items():
            used = np.flatnonzero(presence)
            yield pa.RecordBatch.from_arrays([pa.array(used + r * size), pa.array(occurrences[used]), pa.array(presence[used])], ["term_id", "n_occurrences", "n_records"])

    return run


def term_counts(records: DataFrame, text: str = "text", *, ranges: int = RANGES, range_size: int = RANGE_SIZE) -> DataFrame:
    """``term, term_id, n_occurrences, n_records`` over all records."""
    blocks = records.filter(F.col(text) != "").select(F.col(text).alias("text")).mapInArrow(_count_block, "term string, n_occurrences bigint, n_records bigint")
    blocks = cut_lineage(blocks, "blocks")
    dictionary = cut_lineage(global_dictionary(blocks, ranges), "dictionary")
    encoded = blocks.join(dictionary, "term").select("term_id", "n_occurrences", "n_records")
    ranged = encoded.repartition(F.floor(F.col("term_id") / range_size))
    summed = ranged.mapInArrow(_add_arrays(range_size), "term_id bigint, n_occurrences bigint, n_records bigint")
    return summed.join(dictionary, "term_id").select("term", "term_id", "n_occurrences", "n_records")


def mark_terms(counts: DataFrame, n_records: int, *, rare_below: int = RARE_BELOW, common_percent: int = COMMON_PERCENT) -> DataFrame:
    """``counts`` with ``is_rare`` and ``is_common`` (both can hold when there are few records)."""
    return counts.withColumn("is_rare", F.col("n_records") < rare_below).withColumn("is_common", F.col("n_records") * 100 >= F.lit(common_percent * n_records))

"""Problem 6: near-duplicate records with small edits.

Records are sets of terms; two are linked if they share at least ``threshold`` of the terms in either.

Method: signature-coordinate inverted join. A record's signature has ``coordinates`` coordinates, each made of the
minima of ``rows`` hash functions over its terms, so that two records of similarity s agree in a coordinate with
probability s ** rows. Records are posted under their (coordinate, value) pairs, lists are joined with themselves and the
collisions of every pair are counted; pairs that agree in ``matches`` coordinates or more are retained. A task reads its lists
once, sorted, and pairs the entries of a batch of lists at once.

*Prefix and skip.* Such a pair agrees in one of the first coordinates - matches + 1 places of either record in any global
order; the order puts values of short (common) terms last. The other ``matches`` - 1 entries of a record are marked as
skipped: two skipped entries are never merged, so the longest lists make no pairs of their own. What two skipped entries
would have counted is added from the skipped values, of which every entry of a record carries 32 bits.
*Long lists.* A list of more than ``long_list`` entries is not joined with itself. Its members are posted again under their
rarest terms within the list, as many as must hold a shared one if the threshold is met, which is exact.

Retained pairs, those of long lists excepted, are thinned by 64 single minima (four bits each, compared 16 at a time by bit
operations); all are then compared exactly on their terms. With the default parameters a pair of similarity 0.7 is missed with a probability of 3e-5
(0.75: 6e-8) for its coordinates and of 2e-6 for its minima.

Records with equal term sets form a class; only classes are posted and compared, and members are looked up again
at the end, so that copies never meet in a posting list, however many there are.

Defined results: NULL texts, and records with fewer than ``least_terms`` distinct terms, have no links; rows
repeated with the same key are one record; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aula.llm.folding import mix, string_hashes
from aula.llm.term_counts import lines_as_terms
from aula.session import cut_lineage

THRESHOLD = (7, 10)
LEAST_TERMS = 12
COORDINATES = 72
ROWS = 5
MATCHES = 2
#: Of 64 single minima at least so many must agree (expected at 0.7: 46).
SKETCH_MATCHES = 30
#: Entries of a list from which its members are posted under their rarest terms instead.
LONG_LIST = 2000
BLOCK_ROWS = 2000
#: Terms whose hashes are compared at once.
CACHED_TERMS = 500
#: What stands for a list in an entry of a long one.
LONG = -(1 << 20)
#: Pairs of lists that leave a task at once.
PAIR_ROWS = 1 << 16
SEED = 20_240_901

SKETCH = [f"s{i}" for i in range(4)]


class Signer:
    """Signatures of the records of a block."""

    def __init__(self, coordinates: int, rows: int, matches: int) -> None:
        if matches < 1 or coordinates * rows < 64 or matches > coordinates:
            raise ValueError("bad signature parameters")
        self.coordinates, self.rows, self.matches = coordinates, rows, matches
        rng = np.random.default_rng(SEED)
        self.factors = rng.integers(0, 2**63, coordinates * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def terms(self, text: pa.Array, least: int):
        """Kept records, their distinct terms end to end with bounds, and the batch's dictionary with its hashes."""
        lists = pc.split_pattern(text, "\n")
        lines = pc.list_flatten(lists).dictionary_encode()
        coded, place = lines_as_terms(lines.dictionary)  # a line that recurs in the block is made a term once
        coded = coded.dictionary_encode()
        size = max(len(coded.dictionary), 1)
        code_of = np.full(len(lines.dictionary), -1, np.int64)
        code_of[place] = coded.indices.to_numpy()
        code = code_of[lines.indices.to_numpy()]
        there = code >= 0
        pairs = np.sort(pc.list_parent_indices(lists).to_numpy().astype(np.int64)[there] * size + code[there])
        pairs = pairs[np.diff(pairs, prepend=-1) > 0]
        rec, code = pairs // size, pairs % size
        own, n = np.unique(rec, return_counts=True)
        keep = np.repeat(n >= least, n)
        own, n, code = own[n >= least], n[n >= least], code[keep]
        words = coded.dictionary.to_pylist()
        return own, np.concatenate([[0], np.cumsum(n)]), code, coded.dictionary, string_hashes(words), np.fromiter(map(len, words), np.int64, len(words))

    def classes(self, bounds: np.ndarray, code: np.ndarray, hashes: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """An identifier of the term set: independent of the order of terms."""
        with np.errstate(over="ignore"):
            sums = np.add.reduceat(mix(hashes)[code], bounds[:-1])
            return mix(sums * np.uint64(0x9E3779B97F4A7C15) + np.diff(bounds).astype(np.uint64) * np.uint64(8191) + kind.astype(np.uint64)).view(np.int64)

    def minima(self, bounds: np.ndarray, code: np.ndarray, hashes: np.ndarray, lengths: np.ndarray, functions: int) -> np.ndarray:
        """Least hash of every record under every function; its four lowest bits tell how short the term is."""
        with np.errstate(over="ignore"):
            table = ((hashes[:, None] * self.factors[None, :functions]) >> np.uint64(32)).astype(np.uint32)
        short = (15 - np.clip(lengths - 3, 0, 15)).astype(np.uint32)
        table = (table & np.uint32(0xFFFFFFF0)) | short[:, None]
        out = np.empty((len(bounds) - 1, functions), np.uint32)
        at = 0
        while at < len(out):  # as many records at a time as stay in the cache
            to = max(int(np.searchsorted(bounds, bounds[at] + CACHED_TERMS, "right")) - 1, at + 1)
            np.minimum.reduceat(table[code[bounds[at] : bounds[to]]], bounds[at:to] - bounds[at], axis=0, out=out[at:to])
            at = to
        return out

    def postings(self, minima: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """Keys of the (coordinate, value) pairs of each record in the global order; the last matches - 1 are skipped."""
        m = minima.reshape(len(minima), self.coordinates, self.rows)
        keys = np.broadcast_to(np.arange(self.coordinates, dtype=np.uint64) * np.uint64(2) + kind.astype(np.uint64)[:, None] * np.uint64(1 << 20), m.shape[:2])
        with np.errstate(over="ignore"):
            for i in range(self.rows):
                keys = (keys * np.uint64(0x9E3779B97F4A7C15)) ^ m[:, :, i]
                keys = keys ^ (keys >> np.uint64(29))
            keys = mix(keys) >> np.uint64(12)
        commonness = (m & np.uint32(15)).sum(2).astype(np.uint64)
        return np.take_along_axis(keys, np.argsort((commonness << np.uint64(52)) | keys, axis=1), 1).view(np.int64)

    @staticmethod
    def sketches(minima: np.ndarray) -> np.ndarray:
        """Four 64-bit words of 16 four-bit values."""
        nibbles = ((minima[:, :64] >> np.uint32(4)) & np.uint32(15)).astype(np.uint64).reshape(-1, 4, 16)
        return (nibbles << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(2, dtype=np.uint64).view(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, BLOCK_ROWS):
            yield b.slice(i, BLOCK_ROWS)


def class_table(records: DataFrame, signer: Signer, least_terms: int) -> DataFrame:
    """``kind, id, cls, n, s0..s3, terms`` of every record with enough terms. ``records(kind int, id bigint, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _blocks(batches):
            own, bounds, code, words, hashes, lengths = signer.terms(b.column(2), least_terms)
            if not len(own):
                continue
            kind = b.column(0).to_numpy()[own]
            sketch = signer.sketches(signer.minima(bounds, code, hashes, lengths, 64))
            cls = signer.classes(bounds, code, hashes, kind)
            terms = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), words.take(pa.array(code)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(kind.astype(np.int32)), b.column(1).take(pa.array(own)), pa.array(cls), pa.array(np.diff(bounds).astype(np.int32)), *[pa.array(np.ascontiguousarray(sketch[:, i])) for i in range(4)], terms],
                ["kind", "id", "cls", "n", *SKETCH, "terms"],
            )

    return records.select("kind", "id", "text").mapInArrow(run, "kind int, id bigint, cls bigint, n int, s0 bigint, s1 bigint, s2 bigint, s3 bigint, terms array<string>")


def postings(records: DataFrame, signer: Signer, least_terms: int) -> DataFrame:
    """``key, cls, t0, t1 ...``: one row per (coordinate, value) of each class that a task sees.

    Each ``t`` holds 32 bits of one skipped value of the class; the lowest bit of ``t0`` tells whether this entry is skipped.
    """
    tails = [f"t{i}" for i in range(max(signer.matches - 1, 1))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # classes of this task's last records: spares copies that lie together
        for b in _blocks(batches):
            own, bounds, code, _, hashes, lengths = signer.terms(b.column(2), least_terms)
            if not len(own):
                continue
            kind = b.column(0).to_numpy()[own]
            cls = signer.classes(bounds, code, hashes, kind)
            keys = signer.postings(signer.minima(bounds, code, hashes, lengths, len(signer.factors)), kind)
            _, first = np.unique(cls, return_index=True)
            first = np.array([i for i in np.sort(first) if int(cls[i]) not in seen], np.int64)
            if len(seen) > 200_000:
                seen.clear()
            seen.update(map(int, cls[first]))
            if len(first):
                keys = keys[first]
                skip = np.arange(signer.coordinates) > signer.coordinates - signer.matches
                tail = (keys[:, skip] & 0xFFFFFFFF) << 1 if skip.any() else np.zeros((len(first), 1), np.int64)
                columns = [np.repeat(t, signer.coordinates) for t in tail.T]
                columns[0] = columns[0] | np.tile(skip, len(first))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(cls[first], signer.coordinates)), *map(pa.array, columns)], ["key", "cls", *tails])

    return records.select("kind", "id", "text").mapInArrow(run, "key bigint, cls bigint, " + ", ".join(f"{t} bigint" for t in tails))


def _agreeing(a: str, b: str):
    """Number of equal four-bit values of two 64-bit words."""
    x = F.col(a).bitwiseXOR(F.col(b))
    spread = x.bitwiseOR(F.shiftrightunsigned(x, 1))
    spread = spread.bitwiseOR(F.shiftrightunsigned(spread, 2)).bitwiseAND(F.lit(0x1111111111111111))
    return F.lit(16) - F.bit_count(spread)


def list_pairs(lists: DataFrame, matches: int, long_list: int) -> DataFrame:
    """``a, b, one, more``: a row for each list of ``lists(key, cls, t0 ...)`` in which a < b meet and one of them is not skipped,
    with what their skipped values share. A list of more than ``long_list`` entries gives a row ``cls, key, LONG, 0`` of each entry instead.

    Rows come sorted by key and class, so that a list is never held beyond ``long_list`` entries and a batch.
    """

    def pairs(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Of whole lists, each of ``long_list`` entries at most."""
        key = rows[0]
        _, at, n = np.unique(key, return_index=True, return_counts=True)
        left = np.repeat(at + n, n) - np.arange(len(key)) - 1  # entries of the same list behind each
        waiting, size = [], 0
        here = np.flatnonzero(left > 0)
        step = 1
        while len(here):
            x, y = rows[1:, here], rows[1:, here + step]
            met = (x[1] & y[1] & 1) == 0
            x, y = x[:, met], y[:, met]
            more = np.zeros(x.shape[1], np.int64)
            if matches > 1:
                for t in x[1:]:
                    for u in y[1:]:
                        more += (t >> 1) == (u >> 1)
            waiting.append((x[0], y[0], more))
            size += len(more)
            step += 1
            here = here[left[here] >= step]
            if size >= PAIR_ROWS or not len(here):
                a, b, more = map(np.concatenate, zip(*waiting))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.ones(len(a), np.int32)), pa.array(more.astype(np.int32))], ["a", "b", "one", "more"])
                waiting, size = [], 0

    def entries(rows: np.ndarray) -> pa.RecordBatch:
        n = rows.shape[1]
        return pa.RecordBatch.from_arrays([pa.array(rows[1]), pa.array(rows[0]), pa.array(np.full(n, LONG, np.int32)), pa.array(np.zeros(n, np.int32))], ["a", "b", "one", "more"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last list so far, which the next batch may go on with
        long_key = None
        last = None
        for b in batches:
            rows = np.stack([c.to_numpy() for c in b.columns])
            if not rows.shape[1]:
                continue
            # copies that different tasks posted lie together
            new = np.ones(rows.shape[1], bool)
            new[1:] = (rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])
            new[0] = last is None or (rows[0, 0], rows[1, 0]) != last
            last = (rows[0, -1], rows[1, -1])
            rows = rows[:, new]
            if long_key is not None:
                n = int(np.searchsorted(rows[0], long_key, "right"))
                if n:
                    yield entries(rows[:, :n])
                rows = rows[:, n:]
            if held is not None:
                rows = np.concatenate([held, rows], axis=1)
            held = None
            if not rows.shape[1]:
                continue
            long_key = None
            _, at, n = np.unique(rows[0], return_index=True, return_counts=True)
            size = np.repeat(n, n)
            ends = np.arange(rows.shape[1]) >= at[-1]
            crowded = size > long_list
            if crowded.any():
                yield entries(rows[:, crowded])
                if crowded[-1]:
                    long_key = rows[0, -1]
            if not crowded[-1]:
                held = rows[:, ends]
            whole = ~crowded & ~ends & (size > 1)
            if whole.any():
                yield from pairs(rows[:, whole])
        if held is not None and held.shape[1] > 1:
            yield from pairs(held)

    return lists.sortWithinPartitions("key", "cls").mapInArrow(run, "a bigint, b bigint, one int, more int")


def long_list_pairs(entries: DataFrame, terms: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """``a, b`` of all pairs within a list that can meet the threshold, from ``entries(key, cls)`` and ``terms(cls, terms)``.

    Of n terms, in any order, one of the first n - ceil(threshold n) + 1 is shared with every record that is similar
    enough; the order puts terms first that few members of the list have.
    """
    up, down = threshold
    spread = entries.join(terms.hint("merge"), "cls").select("key", "cls", F.size("terms").alias("n"), F.explode("terms").alias("term"))
    common = spread.groupBy("key", "term").agg(F.count("*").alias("df"))
    ranked = spread.join(common.hint("merge"), ["key", "term"]).withColumn("at", F.row_number().over(Window.partitionBy("key", "cls").orderBy("df", "term")))
    first = ranked.filter(F.col("at") <= F.col("n") - F.ceil(F.col("n") * up / down) + 1).select("key", "term", "cls", "n")
    both = first.withColumnsRenamed({"cls": "a", "n": "a_n"}).join(first.withColumnsRenamed({"cls": "b", "n": "b_n"}).hint("merge"), ["key", "term"]).filter("a < b")
    both = both.filter(F.least("a_n", "b_n") * down >= F.greatest("a_n", "b_n") * up)
    return both.select("a", "b").distinct()


def class_links(table: DataFrame, posted: DataFrame, threshold: tuple[int, int], sketch_matches: int, matches: int = MATCHES, long_list: int = LONG_LIST) -> DataFrame:
    """``a, b, shared, either`` for linked classes, a < b."""
    up, down = threshold
    terms = table.select("cls", "terms").dropDuplicates(["cls"])
    lists = posted.filter(" AND ".join(f"{c} IS NOT NULL" for c in posted.columns)).repartition("key")
    # both uses below ask for the same columns and filter by the sum only, so that lists are met and shuffled once
    counted = list_pairs(lists, matches, long_list).repartition("a").groupBy("a", "b").agg((F.sum("one") + F.max("more")).alias("n_matches"))
    retained = counted.filter(F.col("n_matches") >= matches).select("a", "b")
    # the shuffle lets Spark see that there are none, as is usual, and leave the rest out
    crowded = long_list_pairs(counted.filter(F.col("n_matches") < 0).select(F.col("b").alias("key"), F.col("a").alias("cls")).repartition("cls"), terms, threshold)
    sketches = table.select("cls", "n", *SKETCH).dropDuplicates(["cls"])
    # sketches and terms grow with the records, and unpacked they are many times what was shuffled: never broadcast
    side = lambda name: sketches.select(F.col("cls").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in ("n", *SKETCH)]).hint("merge")
    full = lambda name: terms.select(F.col("cls").alias(name), F.col("terms").alias(f"t{name}")).hint("merge")
    agreeing = sum((_agreeing(f"a_{c}", f"b_{c}") for c in SKETCH), F.lit(0))
    both = retained.join(side("a"), "a").join(side("b"), "b")
    both = both.filter(F.least("a_n", "b_n") * down >= F.greatest("a_n", "b_n") * up)
    near = both.filter(agreeing >= sketch_matches).select("a", "b").unionByName(crowded).repartition("a").distinct()
    exact = near.join(full("a"), "a").join(full("b"), "b")
    exact = exact.withColumn("shared", F.size(F.array_intersect("ta", "tb"))).withColumn("either", F.size("ta") + F.size("tb") - F.col("shared"))
    return exact.filter(F.col("shared") * down >= F.col("either") * up).select("a", "b", "shared", "either")


def near_duplicate_classes(
    records: DataFrame,
    *,
    threshold: tuple[int, int] = THRESHOLD,
    least_terms: int = LEAST_TERMS,
    coordinates: int = COORDINATES,
    rows: int = ROWS,
    matches: int = MATCHES,
    sketch_matches: int = SKETCH_MATCHES,
    long_list: int = LONG_LIST,
) -> tuple[DataFrame, DataFrame]:
    """``members(kind, id, cls)`` and ``links(a, b, shared, either)`` between classes."""
    signer = Signer(coordinates, rows, matches)
    table = cut_lineage(class_table(records, signer, least_terms), "classes")
    links = cut_lineage(class_links(table, postings(records, signer, least_terms), threshold, sketch_matches, matches, long_list), "links")
    return table.select("kind", "id", "cls").distinct(), links


def expand(members: DataFrame, links: DataFrame) -> DataFrame:
    """``kind, id_a, id_b`` of all linked records: members of linked classes, and of the same class."""
    m = lambda c, i: members.select(F.col("cls").alias(c), F.col("kind").alias(f"kind_{c}"), F.col("id").alias(i))
    across = links.select("a", "b").join(m("a", "x").hint("merge"), "a").join(m("b", "y").hint("merge"), "b").filter("kind_a = kind_b").select(F.col("kind_a").alias("kind"), "x", "y")
    crowded = members.groupBy("cls").agg(F.count("*").alias("n")).filter("n > 1").select("cls")
    same = members.join(crowded.hint("merge"), "cls", "left_semi")
    within = same.select("cls", "kind", F.col("id").alias("x")).join(same.select("cls", F.col("id").alias("y")).hint("merge"), "cls").filter("x < y").select("kind", "x", "y")
    return across.unionByName(within).select("kind", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def components(edges: DataFrame, *, most_rounds: int = 60) -> DataFrame:
    """``node, root``: the smallest node of its component for every node of ``edges(a, b)``.

    Alternating large-star and small-star rounds; each round is one shuffle on the node and is written, and no node's
    neighbours are collected anywhere but as a minimum.
    """
    now = cut_lineage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = None
    for _ in range(most_rounds):
        ends = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = ends.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = ends.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        now = cut_lineage(small, "edges")
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).collect()[0])
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def groups(members: DataFrame, links: DataFrame) -> DataFrame:
    """``kind, id, group_class, n_links``: one row per record; records without links are groups of their own."""
    sizes = members.groupBy("cls").agg(F.count("*").alias("n"))
    ends = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    far = ends.join(sizes.withColumnsRenamed({"cls": "b", "n": "m"}).hint("merge"), "b").groupBy("a").agg(F.sum("m").alias("m")).withColumnRenamed("a", "cls")
    roots = components(links.select("a", "b")).withColumnRenamed("node", "cls")
    per = sizes.join(far.hint("merge"), "cls", "left").join(roots.hint("merge"), "cls", "left")
    per = per.select("cls", F.coalesce("root", "cls").alias("group_class"), (F.col("n") - 1 + F.coalesce("m", F.lit(0))).alias("n_links"))
    return members.join(per.hint("merge"), "cls").select("kind", "id", "group_class", "n_links")

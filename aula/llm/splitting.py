"""Problem 1: splitting oversized items at natural boundaries.

A text of more than ``limit`` words is cut into pieces of at most ``limit`` words. A piece repeats the last ``overlap``
words of the one before it. Cuts are made greedily, each as far on as the limit allows, at the best kind of boundary
that is in reach: a slide change, else a line break, else the end of a sentence, else (none in reach) at the limit.

Method: every word position of a text is a node. Its *successor* is the farthest legal cut behind it, overlap included,
found for all positions at once by a binary search in the sorted boundaries. All greedy cuts are then derived in
parallel by pointer doubling: the set of cuts reached so far is joined to the successor table, and the table is
squared, until nothing is new; this takes log2(number of cuts) rounds. Texts of one Arrow batch share one table.

A slide change at time t lies in the text at the share of the span that has passed by then, and is moved to the nearest
line break or sentence end within ``snap`` words, if there is one.

Defined results: NULL and empty texts, and texts of up to ``limit`` words, come out as one piece (no piece for NULL
when ``only_oversized``); a word is a longest run of characters that are not white space; slide times that are NULL,
NaN or outside the span, and spans without usable times, give no slide cut; rows repeated in the input come out
repeatedly (queries read records); columns beside the named ones are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LIMIT = 450
OVERLAP = 30
SNAP = 12
#: Texts of one table of successors, in characters; a longer single text has a table of its own.
BLOCK_CHARS = 2_000_000

WORD = re.compile(r"\S+")
SENTENCE_END = re.compile(r"[.!?…。？！][\"'”’»)\]]*$")

PIECES = T.StructType(
    [
        T.StructField("record_kind", T.StringType()),
        T.StructField("item_key", T.StringType()),
        T.StructField("piece_no", T.IntegerType()),
        T.StructField("n_pieces", T.IntegerType()),
        T.StructField("first_word", T.LongType()),
        T.StructField("last_word", T.LongType()),
        T.StructField("n_words", T.IntegerType()),
        T.StructField("cut", T.StringType()),
        T.StructField("text", T.StringType()),
    ]
)
#: Kinds of cut, best first; ``end`` is the end of the text.
KINDS = ("slide", "line", "sentence", "limit", "end")


def farthest(boundaries: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """For each i the largest boundary in (lo[i], hi[i]], else -1."""
    at = np.searchsorted(boundaries, hi, side="right") - 1
    found = np.where(at >= 0, boundaries[np.maximum(at, 0)] if len(boundaries) else -1, -1)
    return np.where(found > lo, found, -1)


def successors(base: np.ndarray, stop: np.ndarray, kinds: list[np.ndarray], limit: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """Successor and kind of cut for every position of texts laid end to end.

    ``base`` and ``stop``: first position and end of the text a position belongs to.
    """
    here = np.arange(len(base))
    reach = np.maximum(here - overlap, base) + limit
    nxt, how = np.minimum(reach, stop), np.full(len(base), len(KINDS) - 2, np.int8)
    for rank in range(len(kinds) - 1, -1, -1):
        # a cut must leave words behind the overlap, or the next piece would not get on
        cut = farthest(kinds[rank], here + overlap, reach)
        nxt, how = np.where(cut >= 0, cut, nxt), np.where(cut >= 0, rank, how)
    ends = reach >= stop
    return np.where(ends, stop, nxt), np.where(ends, len(KINDS) - 1, how).astype(np.int8)


def reached(nxt: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """All positions on the ways from ``starts``, by pointer doubling; an end points at itself."""
    seen = np.zeros(len(nxt), bool)
    seen[starts] = True
    table = nxt
    while True:
        before = np.count_nonzero(seen)
        seen[table[seen]] = True
        if np.count_nonzero(seen) == before and np.array_equal(table, table[table]):
            return seen
        table = table[table]


def slide_positions(times, start, end, n_words: int, natural: np.ndarray, snap: int) -> list[int]:
    if not times or start is None or end is None or not end > start:
        return []
    out = []
    for t in times:
        if t is None or not start < t < end:
            continue
        p = round((t - start) / (end - start) * n_words)
        if len(natural):
            i = np.searchsorted(natural, p)
            near = min((int(natural[j]) for j in (i - 1, i) if 0 <= j < len(natural)), key=lambda x: (abs(x - p), x))
            p = near if abs(near - p) <= snap else p
        if 0 < p < n_words:
            out.append(p)
    return out


def split_block(texts: list[str], slides: list, spans: list, limit: int, overlap: int, snap: int):
    """Pieces of several texts: (text index, first word, end word, kind, first char, end char)."""
    words = [[m.span() for m in WORD.finditer(t)] for t in texts]
    counts = np.array([len(w) for w in words], np.int64)
    offset = np.concatenate([[0], np.cumsum(counts + 1)])  # one node more than words
    total = int(offset[-1])
    base = np.repeat(offset[:-1], counts + 1)
    stop = base + np.repeat(counts, counts + 1)
    marks: list[list[np.ndarray]] = [[], [], []]
    for i, (t, w) in enumerate(zip(texts, words)):
        if counts[i] <= limit:
            continue
        line, sentence = [], []
        for k in range(1, len(w)):
            if "\n" in t[w[k - 1][1] : w[k][0]]:
                line.append(k)
            if SENTENCE_END.search(t, max(w[k - 1][0], w[k - 1][1] - 6), w[k - 1][1]):
                sentence.append(k)
        natural = np.unique(np.array(line + sentence, np.int64))
        for kind, found in enumerate((slide_positions(slides[i], *spans[i], len(w), natural, snap), line, sentence)):
            marks[kind].append(np.unique(np.array(found, np.int64)) + offset[i])
    kinds = [np.concatenate(m) if m else np.empty(0, np.int64) for m in marks]
    # a boundary of a later text must not be taken: reach never passes the own text's end unless that ends the text
    nxt, how = successors(base, stop, kinds, limit, overlap)
    seen = reached(nxt, offset[:-1])
    for i in range(len(texts)):
        nodes = np.flatnonzero(seen[offset[i] : offset[i + 1]])
        cuts = nodes[1:] if len(nodes) > 1 else np.array([0])
        begin = 0
        for end in cuts:
            kind = KINDS[int(how[offset[i] + begin])]
            first = max(begin - overlap, 0)
            c0, c1 = (words[i][first][0], words[i][end - 1][1]) if end else (0, 0)
            yield i, first, int(end), kind, c0, c1
            begin = int(end)
    assert total == len(base)


def split_items(items: DataFrame, *, limit: int = LIMIT, overlap: int = OVERLAP, snap: int = SNAP, only_oversized: bool = False) -> DataFrame:
    """Pieces of ``items(record_kind, item_key, text, slide_timestamps, start_timestamp, end_timestamp)``."""
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be less than half the limit")
    columns = [F.col(c).cast("string") for c in ("record_kind", "item_key", "text")] + [F.col(c) for c in ("slide_timestamps", "start_timestamp", "end_timestamp")]
    rows = items.select(*columns)
    if only_oversized:
        # limit + 1 words of one character with one space between them: no shorter text has more words
        rows = rows.filter(F.length("text") > 2 * limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [c.to_pylist() for c in b.columns]
            todo, size = [], 0
            for i, text in enumerate(cols[2]):
                if text is None:
                    continue
                todo.append(i)
                size += len(text)
                if size >= BLOCK_CHARS:
                    yield block(cols, todo)
                    todo, size = [], 0
            if todo:
                yield block(cols, todo)

    def block(cols, todo) -> pa.RecordBatch:
        texts = [cols[2][i] for i in todo]
        pieces: list[list] = [[] for _ in todo]
        for p in split_block(texts, [cols[3][i] for i in todo], [(cols[4][i], cols[5][i]) for i in todo], limit, overlap, snap):
            pieces[p[0]].append(p)
        out = []
        for j, own in enumerate(pieces):
            if only_oversized and len(own) < 2:
                continue
            for no, (_, first, end, kind, c0, c1) in enumerate(own, 1):
                out.append((cols[0][todo[j]], cols[1][todo[j]], no, len(own), first, end - 1 if end else 0, end - first, kind, texts[j][c0:c1]))
        arrays = [pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string()))]
        return pa.RecordBatch.from_arrays(arrays, PIECES.names)

    return rows.mapInArrow(run, PIECES)

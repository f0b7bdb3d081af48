import random
import re
from collections import Counter

import pytest
from conftest import MID, SMALL
from oracle import assert_same, connect

from aula.llm import term_counts as tc
from aula.llm import term_counts_queries as q


def test_random_against_counter(spark, monkeypatch):
    rnd = random.Random(4)
    words = ["Alpha", "alpha,", "(beta)", "_x_", "é́", "Straße.", "--", "", "a b", "ΩMEGA", "x" * 5000] + [f"t{i}" for i in range(50)]
    rows = [(i, None if i % 11 == 0 else "\n".join(rnd.choice(words) for _ in range(rnd.randrange(0, 30)))) for i in range(200)]
    occ, rec = Counter(), Counter()
    for _, t in rows:
        own = [x for x in (re.sub(r"^[\W]+|[\W]+$", "", w.lower()) for w in (t or "").split("\n")) if x]
        occ.update(own)
        rec.update(set(own))
    for parts in (1, 7):
        got = tc.term_counts(spark.createDataFrame(rows, "term bigint, text string").repartition(parts), ranges=5, range_size=8).collect()
        assert {r.term: r.n_occurrences for r in got} == dict(occ) and {r.term: r.n_records for r in got} == dict(rec)
        assert sorted(r.term_id for r in got) == list(range(len(got)))
        ids = {r.term: r.term_id for r in got}
        assert parts == 1 or ids == before
        before = ids


def test_arrays_are_added_by_identifier():
    import pyarrow as pa

    rows = [(0, 1, 1), (7, 2, 1), (0, 3, 2), (4, 5, 2), (9, 1, 1), (4, 1, 1)]
    for size in range(1, 7):
        batches = [pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows[i : i + size]], pa.int64()) for k in range(3)], ["term_id", "o", "r"]) for i in range(0, len(rows), size)]
        got = sorted(tuple(r.values()) for b in tc._add_arrays(4)(iter(batches)) for r in b.to_pylist())
        assert got == [(0, 4, 3), (4, 6, 3), (7, 2, 1), (9, 1, 1)]


def test_full_blocks_are_sent(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(tc, "BLOCK_TERMS", 2)
    batches = [pa.RecordBatch.from_arrays([pa.array(["a\nb\na", None, "a"])], ["text"]), pa.RecordBatch.from_arrays([pa.array(["a"])], ["text"])]
    assert [b.to_pydict() for b in tc._count_block(iter(batches))] == [{"term": ["a", "b"], "n_occurrences": [3, 1], "n_records": [2, 1]}, {"term": ["a"], "n_occurrences": [1], "n_records": [1]}]


def test_empty_table_and_marks(spark):
    df = spark.createDataFrame([], "text string")
    assert tc.term_counts(df).count() == 0
    counts = spark.createDataFrame([("a", 1), ("b", 3), ("c", 2)], "term string, n_records bigint")
    got = {r.term: (r.is_rare, r.is_common) for r in tc.mark_terms(counts, 15).collect()}
    assert got == {"a": (True, False), "b": (False, True), "c": (True, False)}


@pytest.mark.parametrize("name", sorted(q.QUERIES))
@pytest.mark.parametrize("d", [SMALL, MID])
def test_against_sql(spark, name, d):
    assert_same(q.QUERIES[name](spark, d), connect(d), q.SQL[name])

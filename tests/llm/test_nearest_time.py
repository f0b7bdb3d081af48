import random

import pytest
from conftest import MID, SMALL
from oracle import assert_same, connect

from aula.llm import nearest_time_queries as q
from aula.llm.nearest_time import nearest

L, R = "segment_id bigint, lecture_id string, t double, cell int", "frame_id bigint, lecture_id string, k double, salt string"
ARGS = dict(entity="lecture_id", left_key="segment_id", left_time="t", right_key="frame_id", right_time="k")


@pytest.mark.parametrize("cell_rows", [3, 1000])
def test_random_against_all_pairs(spark, cell_rows):
    rnd = random.Random(1)
    special = [None, float("nan"), float("inf"), -3.5]
    left = [(i, rnd.choice(["a", "a", "a", "b", "c", None]), rnd.choice(special) if i % 17 == 0 else round(rnd.uniform(0, 200), 1), 1) for i in range(200)]
    right = [(i, rnd.choice(["a", "b", None, "d"]), rnd.choice(special) if i % 13 == 0 else round(rnd.uniform(0, 200), 1), "s") for i in range(80)]
    left += left[:5]
    right += right[:9]
    want = []
    for i, e, t, _ in left:
        best = None
        for j, f, k, _ in right:
            if e is None or e != f or t is None or k is None or not abs(t) < 1e15 or not abs(k) < 1e15:
                continue
            if abs(t - k) <= 2.5 and (best is None or (abs(t - k), k, j) < best):
                best = (abs(t - k), k, j)
        if best:
            want.append((i, best[2], round(best[0], 9)))
    got = nearest(spark.createDataFrame(left, L), spark.createDataFrame(right, R), tolerance=2.5, cell_seconds=20, cell_rows=cell_rows, **ARGS).collect()
    assert sorted((r.segment_id, r.frame_id, round(r.distance, 9)) for r in got) == sorted(want)


def test_empty_tables_and_bounds(spark):
    left, right = spark.createDataFrame([(1, "a", 10.0, 1)], L), spark.createDataFrame([(7, "a", 22.0, "x"), (6, "a", -2.0, "x")], R)
    assert [tuple(r) for r in nearest(left, right, tolerance=12, **ARGS).collect()] == [(1, 6, 12.0)]
    assert nearest(left.limit(0), right, tolerance=12, **ARGS).count() == 0
    assert nearest(left, right.limit(0), tolerance=12, **ARGS).count() == 0
    with pytest.raises(ValueError):
        nearest(left, right, tolerance=12, cell_seconds=24, **ARGS)


@pytest.mark.parametrize("name", sorted(q.QUERIES))
@pytest.mark.parametrize("d", [SMALL, MID])
def test_against_sql(spark, name, d):
    assert_same(q.QUERIES[name](spark, d), connect(d), q.SQL[name])

import random

from conftest import MID, SMALL
from oracle import assert_same, connect

import pytest
from aula.operators.intervals import gaps, periods, to_ms
from aula.plans import interval_queries as iq
from pyspark.sql import functions as F

SCHEMA = "k string, start_ms bigint, end_ms bigint"


def brute(rows):
    covered = {}
    for k, s, e in rows:
        if s is not None and e is not None and e > s:
            covered.setdefault(k, []).append((s, e))
    per, gap = set(), set()
    for k, v in covered.items():
        v.sort()
        out = [list(v[0])]
        for s, e in v[1:]:
            if s <= out[-1][1]:
                out[-1][1] = max(out[-1][1], e)
            else:
                out.append([s, e])
        per |= {(k, i + 1, a, b) for i, (a, b) in enumerate(out)}
        gap |= {(k, out[i][1], out[i + 1][0]) for i in range(len(out) - 1)}
    return per, gap


def test_random_spans_cross_cells(spark):
    rnd = random.Random(5)
    rows = []
    for k in ("a", "b", None):
        for _ in range(120):
            s = rnd.randrange(-500, 3000)
            rows.append((k, s, rnd.choice([s + rnd.randrange(0, 40), s - 3, None, s + rnd.choice([1, 900])])))
    rows += rows[:30] + [("c", None, 5), ("d", 1, 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    per, gap = brute(rows)
    for cell in (50, 10_000):
        assert {tuple(r) for r in periods(df, ["k"], cell_ms=cell).collect()} == per
        assert {tuple(r) for r in gaps(df, ["k"], cell_ms=cell).collect()} == gap


def test_empty_extra_columns_and_limits(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert periods(df, ["k"]).count() == 0 and gaps(df, ["k"]).count() == 0
    df = spark.createDataFrame([("a", 0, 5, 1), ("a", 5, 7, 2), ("a", 10, 12, 3), ("a", 200, 201, 4)], SCHEMA + ", _cell int")
    assert {tuple(r) for r in gaps(df, ["k"], longest_ms=100).collect()} == {("a", 7, 10)}
    assert {tuple(r) for r in periods(df, ["k"]).collect()} == {("a", 1, 0, 7), ("a", 2, 10, 12), ("a", 3, 200, 201)}


def test_to_ms(spark):
    rows = spark.createDataFrame([(1.2345,), (float("nan"),), (float("inf"),), (None,)], "x double").select(to_ms(F.col("x"))).collect()
    assert [r[0] for r in rows] == [1235, None, None, None] or [r[0] for r in rows] == [1234, None, None, None]


@pytest.mark.parametrize("name", sorted(iq.QUERIES))
@pytest.mark.parametrize("d", [SMALL, MID])
def test_against_sql(spark, name, d):
    assert_same(iq.QUERIES[name](spark, d), connect(d), iq.SQL[name])

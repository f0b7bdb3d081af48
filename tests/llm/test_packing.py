import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from conftest import MID, SMALL
from oracle import assert_same, connect

from aula.llm import packing as pk
from aula.llm import packing_queries as q


def test_boundaries_against_all_choices():
    rnd = random.Random(1)
    for _ in range(40):
        sizes = np.array(sorted(rnd.sample(range(1, 60), rnd.randrange(1, 9))))
        counts = np.array([rnd.randrange(1, 9) for _ in sizes])
        for b in (1, 2, 3, 20):
            got = pk.bucket_boundaries(sizes, counts, b)
            cost = lambda bounds: sum(c * (min(x for x in bounds if x >= s) - s) for s, c in zip(sizes, counts))
            top = int(sizes[-1])
            best = min(cost([*extra, top]) for k in range(min(b, len(sizes))) for extra in combinations(map(int, sizes[:-1]), k))
            assert got == sorted(set(got)) and got[-1] == top and len(got) <= b and cost(got) == best
    assert pk.bucket_boundaries(np.empty(0, int), np.empty(0, int), 4) == []


def test_pieces_keep_characters_and_capacity():
    for t in ("", "a" * 100, "ü" * 99, "日本" * 50, "a😀" * 41):
        for cap in (4, 5, 16, 100, 101):
            data = t.encode()
            own = pk.piece_bounds(data, cap)
            assert b"".join(data[s:e] for s, e in own) == data and "".join(data[s:e].decode() for s, e in own) == t
            assert all(e - s + (i == len(own) - 1) <= cap for i, (s, e) in enumerate(own))


def check(rows, texts, cap):
    loads = Counter()
    for r in rows:
        loads[r.container_id] += r.n_tokens
    assert all(v <= cap for v in loads.values())
    assert sorted(loads) == list(range(len(loads)))
    per = defaultdict(list)
    for r in rows:
        per[r.doc_id].append(r)
    for k, t in texts.items():
        own = sorted(per.pop(k, []), key=lambda r: r.piece_no)
        if t is None:
            assert not own
            continue
        size = len(t.encode()) + 1
        assert sum(r.n_tokens for r in own) == size and (len(own) == 1) == (size <= cap)
        assert all(r.n_tokens <= r.bucket_tokens for r in own)
    assert not per
    return sum(loads.values()) / (len(loads) * cap) if loads else 1


@pytest.mark.parametrize("cap", [64, 1000])
def test_random_texts(spark, cap):
    rnd = random.Random(cap)
    texts = {i: None if i % 50 == 0 else rnd.choice(["x", "é", "字"]) * int(rnd.expovariate(1 / (cap / 5))) for i in range(600)}
    texts |= {i: "same size" for i in range(1000, 1400)}
    texts[5000] = "y" * (cap * 7)
    df = spark.createDataFrame([(k, t, 1) for k, t in texts.items()], "doc_id bigint, text string, n_tokens int")
    assert check(pk.pack(df, "doc_id", capacity=cap).collect(), texts, cap) > 0.95


def test_empty_table_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "abc"), (1, "abc"), (2, "")], "doc_id bigint, text string")
    assert pk.pack(df.limit(0), "doc_id").count() == 0
    rows = pk.pack(df, "doc_id").collect()
    assert sorted(r.n_tokens for r in rows) == [1, 4, 4] and {r.container_id for r in rows} == {0}


def test_containers_of_the_tables(spark):
    rows = q.p7_containers(spark, MID).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{MID}/documents.parquet").select("doc_id", "text").collect()}
    assert check(rows, texts, pk.CAPACITY) > 0.97
    fill = q.p7_fill(spark, MID).collect()[0]
    assert fill.fullest <= pk.CAPACITY and fill.used_per_mille >= 970


@pytest.mark.parametrize("d", [SMALL, MID])
def test_against_sql(spark, d):
    assert_same(q.p7_found(spark, d), connect(d), q.SQL["p7_found"])

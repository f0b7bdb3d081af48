import random

import pytest
from conftest import MID, SMALL
from oracle import assert_same, connect

from aula.llm import splitting as sp
from aula.llm import splitting_queries as q

SCHEMA = "record_kind string, item_key string, text string, slide_timestamps array<double>, start_timestamp double, end_timestamp double, piece_no int"


def greedy(text, times, start, end, limit, overlap, snap):
    """The plain loop: one cut after another."""
    words = text.split()
    n = len(words)
    if n <= limit:
        return [(0, n, "end")]
    line, sent, at = set(), set(), 0
    import re

    spans = [m.span() for m in re.finditer(r"\S+", text)]
    for k in range(1, n):
        if "\n" in text[spans[k - 1][1] : spans[k][0]]:
            line.add(k)
        if words[k - 1].rstrip("\"'”’»)]")[-1:] in tuple(".!?…。？！"):
            sent.add(k)
    import numpy as np

    slides = set(sp.slide_positions(times, start, end, n, np.array(sorted(line | sent), dtype=int), snap))
    out = []
    while at < n:
        first = max(at - overlap, 0)
        reach = first + limit
        if reach >= n:
            out.append((first, n, "end"))
            break
        for kind, marks in (("slide", slides), ("line", line), ("sentence", sent), ("limit", {reach})):
            ok = [b for b in marks if at + overlap < b <= reach]
            if ok:
                out.append((first, max(ok), kind))
                at = max(ok)
                break
    return out


def texts():
    rnd = random.Random(2)
    out = [None, "", "  \n ", "one", "w " * 10, "w\t" * 11]
    for _ in range(60):
        n = rnd.randrange(1, 120)
        out.append("".join(rnd.choice(["ab", "c.", "d?\"", "e​f"]) + rnd.choice([" "] * 8 + ["\n", " ", "  ", "\n\n"]) for _ in range(n)))
    out.append("long " * 20_000)
    return out


@pytest.mark.parametrize("limit,overlap", [(10, 3), (10, 0), (25, 12)])
def test_against_the_plain_loop(spark, limit, overlap):
    if overlap >= limit // 2:
        overlap = limit // 2 - 1
    rnd = random.Random(limit)
    rows = []
    for i, t in enumerate(texts()):
        times = rnd.choice([None, [], [None, float("nan"), -5.0, 3.0, 50.0, 20.0, 20.0, 99.5]])
        rows.append(("k", str(i), t, times, rnd.choice([0.0, 0.0, None]), rnd.choice([100.0, 100.0, -1.0]), 7))
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {}
    for r in sp.split_items(df, limit=limit, overlap=overlap, snap=2).collect():
        got.setdefault(r.item_key, []).append(r)
    for _, key, t, times, s, e, _ in rows:
        if t is None:
            assert key not in got
            continue
        mine = sorted(got[key], key=lambda r: r.piece_no)
        want = greedy(t, times, s, e, limit, overlap, 2)
        assert [(r.first_word, r.first_word + r.n_words, r.cut) for r in mine] == want
        words = t.split()
        assert all(r.n_words <= limit and r.text.split() == words[r.first_word : r.first_word + r.n_words] for r in mine)
        assert [r.piece_no for r in mine] == list(range(1, len(mine) + 1)) and all(r.n_pieces == len(mine) for r in mine)
        rebuilt = t.split()[:0]
        for k, r in enumerate(mine):
            rebuilt += r.text.split()[overlap if k and r.first_word else 0 :] if not (k and r.first_word == 0) else r.text.split()[len(rebuilt) :]
        assert rebuilt == t.split()


def test_only_oversized_and_empty_table(spark):
    rows = [("k", "a", "w " * 450, None, None, None, 1), ("k", "b", "w " * 451, None, None, None, 1), ("k", "c", None, None, None, None, 1), (None, None, "x\n" * 900, None, None, None, 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sp.split_items(df, only_oversized=True).collect()
    assert {r.item_key for r in got} == {"b", None} and len([r for r in got if r.item_key == "b"]) == 2
    assert sp.split_items(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        sp.split_items(df, limit=10, overlap=5)


def test_pieces_of_the_tables(spark):
    rows = q.p1_pieces(spark, MID).collect()
    assert rows and all(r.n_words <= 450 for r in rows)
    assert len({(r.record_kind, r.item_key, r.piece_no) for r in rows}) == len(rows)
    assert {r.cut for r in rows} & {"slide", "sentence", "line"}


@pytest.mark.parametrize("d", [SMALL, MID])
def test_against_sql(spark, d):
    assert_same(q.p1_found(spark, d), connect(d), q.SQL["p1_found"])

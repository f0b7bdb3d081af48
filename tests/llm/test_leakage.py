import random
import re

import numpy as np
import pytest
from conftest import MID, SMALL

from aula.llm import leakage_queries as q
from aula.llm.folding import fold, word_hashes
from aula.llm.leakage import leaks


def words(t):
    return re.findall(r"[^\W_]+", fold(t)) if t else []


def brute(docs, tests, shared):
    grams = {}
    for item, *fields in tests:
        for name, t in zip(("question", "reference_answer", "passage"), fields):
            w = words(t)
            for i in range(len(w) - shared + 1):
                grams.setdefault(tuple(w[i : i + shared]), set()).add((item, name))
    out = set()
    for doc, t in docs:
        w = words(t)
        for i in range(len(w) - shared + 1):
            out |= {(doc, *x) for x in grams.get(tuple(w[i : i + shared]), ())}
    return out


def test_words_match_regular_expression():
    texts = ["Hello, wörld! x2-y", "", "ｆｕｌｌ　wi​dth café", "Москва_9", "a" * 100_000 + " б", "— …", "İí"]
    h, b = word_hashes(texts)
    own = [words(t) for t in texts]
    assert list(np.diff(b)) == [len(w) for w in own]
    flat = [w for ws in own for w in ws]
    seen = {}
    for w, x in zip(flat, h):
        assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


def test_case_does_not_matter_beside_look_alikes():
    assert words("ТЕКСТ Мир") == words("текст мир") and words("Тhe тext") == words("the text".upper().replace("X", "Х"))
    h, _ = word_hashes(["ТЕКСТ", "текст", "TЕKCT"])
    assert h[0] == h[1] == h[2]


@pytest.mark.parametrize("resident", [0, 10**9])
def test_random_corpus_against_all_grams(spark, resident):
    rnd = random.Random(8)
    vocab = [f"w{i}" for i in range(6)] + ["the", "Ｘ", "é"]
    line = lambda n: [rnd.choice(vocab) for _ in range(n)]
    tests = [(i, " ".join(line(rnd.randrange(0, 20))), rnd.choice([None, "", " ".join(line(30))]), " ".join(line(25))) for i in range(12)]
    docs = [(i, None if i % 9 == 0 else " ".join(line(rnd.randrange(0, 60)))) for i in range(80)]
    for i in range(40):
        t = (tests[i % 12][3] or "").split()
        a = rnd.randrange(0, 15)
        cut = t[a : a + rnd.randrange(4, 14)]
        docs.append((100 + i, " ".join(line(5)) + "\n" + ", ".join(cut).upper() + "; " + " ".join(line(5))))
    docs += docs[-3:]
    df = spark.createDataFrame([(*x, "e") for x in docs], "doc_id bigint, text string, field string")
    td = spark.createDataFrame([(*x, 1) for x in tests], "item_id bigint, question string, reference_answer string, passage string, doc_id int")
    for shared, k in ((6, 4), (7, 7), (5, 1)):
        got = leaks(df, td, shared=shared, k=k, resident_words=resident).collect()
        assert {(r.doc_id, r.item_id, r.field) for r in got} == brute(docs, tests, shared)
        assert len(got) == len({(r.doc_id, r.item_id, r.field) for r in got})
        by = dict(docs)
        for r in got:
            assert r.n_words >= shared and len(words(by[r.doc_id])) >= r.first_word + r.n_words


def test_empty_sides(spark):
    df = spark.createDataFrame([(1, "a b c d e f")], "doc_id bigint, text string")
    td = spark.createDataFrame([(1, "a b c d e f", None, None)], "item_id bigint, question string, reference_answer string, passage string")
    for resident in (0, 100):
        assert leaks(df, td, shared=4, k=2, resident_words=resident).count() == 1
        assert leaks(df.limit(0), td, resident_words=resident).count() == 0
        assert leaks(df, td.limit(0), resident_words=resident).count() == 0
    with pytest.raises(ValueError):
        leaks(df, td, shared=4, k=5)


@pytest.mark.parametrize("d", [SMALL, MID])
def test_tables_against_all_grams(spark, d):
    docs = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    tests = [tuple(r) for r in spark.read.parquet(f"{d}/eval_items.parquet").select("item_id", "question", "reference_answer", "passage").collect()]
    want = brute(docs, tests, 12)
    assert want and {(r.doc_id, r.item_id, r.field) for r in q.p8_leaks(spark, d).collect()} == want
    assert {tuple(r) for r in q.p8_found(spark, d).collect()} == {x[:2] for x in want}

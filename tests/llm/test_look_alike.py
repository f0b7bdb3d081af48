import random
import re
import unicodedata

import pytest
from conftest import MID, SMALL
from oracle import assert_same, connect

from aula.llm import look_alike as la
from aula.llm import look_alike_queries as q


def skeleton(t):
    t = unicodedata.normalize("NFC", re.sub(f"[{la.INVISIBLE}]", "", t))
    return unicodedata.normalize("NFC", t.translate(str.maketrans(la.ALIKE)))


def forms(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return [r.text for r in la.consistent_text(df).orderBy("doc_id").collect()]


def test_examples(spark):
    got = forms(spark, ["ｆｕｌｌ　ｗｉｄｔｈ", "ca​fé", "café", "a b c", "pаper", "co‐op", "Москва есть", "Mосква eсть", None, "", "Größe", "а́", "á", "x  y", "O'Neіl＇"])
    assert got[0] == "full width" and got[1] == got[2] == "café" and got[3] == "a b c" and got[4] == "paper" and got[5] == "co-op"
    assert got[6] == got[7] == "Москва есть" and got[8] is None and got[9] == "" and got[10] == "Größe" and got[11] == got[12] and got[13] == "x  y" and got[14] == "O'Neil'"


def test_random_texts_keep_skeletons(spark):
    rnd = random.Random(3)
    alphabet = "".join(la.ALIKE) + "\u200b\u00ad\u034f\ufe0f\U000e0041" + "́̈̆ abcéßиЯλ.\n-–19"
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(40))) for _ in range(300)] + ["x" * 200_000 + "ｙ"]
    got = forms(spark, texts)
    assert [skeleton(x) for x in got] == [skeleton(t) for t in texts]
    by = {}
    for t, x in zip(texts, got):
        assert by.setdefault(skeleton(t), x) == x


# Written down apart from the operator's tables: texts that look the same, by group.
SAME = [
    ["Spa\u0308ter", "Sp\u00e4ter", "Sp\u04d3ter", "Sp\u0430\u0308ter"],
    ["lecci\u03ccn", "lecci\u03bf\u0301n", "lecci\u043e\u0301n", "lecci\u00f3n"],
    ["mati\u0450re", "mati\u00e8re", "mati\u0435\u0300re"],
    ["\u1f08x", "\u0391\u0313x", "A\u0313x"],
    ["\u045ex", "y\u0306x", "\u0443\u0306x"],
    ["\U0001d400\u2163\u2173", "A\u2163\u2173"],
    ["\u0555\u0585 \u0570", "Oo h"],
    ["a\u2011b\u2010c\uff0dd", "a-b-c-d"],
    ["a\u115fb\ufe0fc\U000e0020", "abc"],
    ["a\u2007b\u205fc\u1680d", "a b c d"],
]


@pytest.mark.parametrize("group", SAME)
def test_texts_that_look_the_same(spark, group):
    assert len(set(forms(spark, group))) == 1


def test_texts_that_look_different(spark):
    texts = ["resume", "r\u00e9sume", "Resume", "resum3", "re sume", "re  sume", "x\u00b2", "x2", "a\u2013b", "a-b", "\u0438", "\u0439", "\u0435", "\u0451"]
    assert len(set(forms(spark, texts))) == len(texts)


def test_pairs_nulls_copies_extra_columns(spark):
    rows = [(1, "abc", 1), (2, "аbc", 1), (3, "abc", 2), (4, "abС", 1), (5, None, 1), (6, None, 1), (7, "", 1), (8, "​", 1), (9, "аbc", 1), (2, "аbc", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, look int")
    got = sorted(tuple(r) for r in la.look_alike_pairs(la.look_keys(df, "doc_id"), "doc_id").collect())
    assert got == [(1, 2), (1, 9), (2, 3), (3, 9), (7, 8)]
    assert la.look_alike_pairs(la.look_keys(df.limit(0), "doc_id"), "doc_id").count() == 0


@pytest.mark.parametrize("name", sorted(q.QUERIES))
@pytest.mark.parametrize("d", [SMALL, MID])
def test_against_sql(spark, name, d):
    assert_same(q.QUERIES[name](spark, d), connect(d), q.SQL[name])

import re
import uuid

import pytest

from aula.functions import text as t
from pyspark.sql import functions as F


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(fn(F.col("x")).alias("y")).collect()[0].y


def test_white_space_like_python(spark):
    chars = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0        　"
    s = "a" + "".join(f"{c}b" for c in chars) + "​c"
    assert one(spark, s, t.count_words) == len(s.split()) and one(spark, "", t.count_words) == 0
    assert one(spark, f"{chars}x{chars}", t.strip) == "x"


def test_words_and_tokens(spark):
    assert [one(spark, w, t.normalize_word) for w in ("(Été),", "_x_", "--", "F1-Score:")] == ["été", "_x_", "", "f1-score"]
    assert [one(spark, w, t.has_letter_or_digit) for w in ("_", "|", "é", "3")] == [True, False, True, True]
    assert one(spark, "", t.raw_words) == [] and one(spark, "a\n\nb", t.raw_words) == ["a", "", "b"]
    assert one(spark, "What is the F1-score? café", t.search_tokens) == ["f1", "score", "caf"]


def test_formats(spark):
    assert [one(spark, s, t.format_timestamp, "double") for s in (0.0, 65.9, 3599.0, 3600.0, 7325.4)] == ["0:00", "1:05", "59:59", "1:00:00", "2:02:05"]
    assert one(spark, "ab cd ef", lambda c: t.truncate_at_word(c, 6)) == "ab cd ..." and one(spark, "abcdefgh", lambda c: t.truncate_at_word(c, 5)) == "abcde ..."
    assert one(spark, "ab", lambda c: t.truncate_at_word(c, 5)) == "ab"
    assert one(spark, ["b", " ", "a", "b"], t.unique_in_order, "array<string>") == ["b", "a"]
    assert [one(spark, v, lambda c: t.round_half_even(c, 2), "double") for v in (0.125, 0.375, 1.5)] == [0.12, 0.38, 1.5]
    assert one(spark, "org/Some-Model", t.model_slug) == "some-model"
    assert [one(spark, p, lambda c: t.slide_url(F.lit("lec_1"), c)) for p in (r"a\b/frame_1.00.jpg", "../x..jpg", "frame 1.jpg")] == ["/slides/lec_1/frame_1.00.jpg", None, None]
    assert [one(spark, p, t.frame_timestamp) for p in ("k/frame_12.50.jpg", "k/other.jpg")] == [12.5, None]
    assert [one(spark, c, t.coverage_banner) == "" for c in ("full", "partial", "none")] == [True, False, False]


def test_identifiers(spark):
    for name in ("lecture_01_0", "é_3", ""):
        assert one(spark, name, t.point_id) == str(uuid.uuid5(uuid.NAMESPACE_URL, name))
    a, b, c = (one(spark, x, lambda col: t.cache_key(m, n, col)) for x, m, n in (("t", "m", 1), ("t", "m2", 1), ("t", "m", 2)))
    assert len({a, b, c}) == 3


def test_embed_text(spark):
    df = spark.createDataFrame([("s", "d", "x"), ("", None, ""), (None, "d", "x")], "s string, d string, x string")
    assert [r.y for r in df.select(t.embed_text(F.col("s"), F.col("d"), F.col("x")).alias("y")).collect()] == ["s\n\nd\n\nx", "", "d\n\nx"]
    assert df.select(t.embed_text(F.col("s"), F.col("d"), F.col("x"), with_description=False).alias("y")).first().y == "s\n\nx"


def test_intervals_and_vectors(spark):
    df = spark.createDataFrame([(0.0, 50.0, 50.0, 80.0), (0.0, 60.0, 50.0, 80.0)], "a double, b double, c double, d double")
    cols = [F.col(c) for c in "abcd"]
    assert [tuple(r) for r in df.select(t.ranges_overlap(*cols), t.overlap_seconds(*cols)).collect()] == [(False, 0.0), (True, 10.0)]
    px = spark.createDataFrame([([0.0] * 4, [255.0] * 2 + [0.0] * 2), ([100.0], [120.0]), ([], [])], "a array<double>, b array<double>")
    assert [r[0] for r in px.select(t.changed_share(F.col("a"), F.col("b"), 20)).collect()] == [0.5, 0.0, 0.0]
    v = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>").select(t.unit_vector(F.col("v")).alias("u")).collect()
    assert v[0].u == pytest.approx([0.6, 0.8]) and v[1].u == [0.0, 0.0]


@pytest.mark.parametrize(
    "text,n,clean,valid,invalid",
    [
        ("Ice melts at zero [4], and [2 ,4] says why.", 5, "Ice melts at zero [4], and [2, 4] says why.", [4, 2], []),
        ("The lake [6] is deep [1,6, 2] .", 5, "The lake is deep [1, 2].", [1, 2], ["6"]),
        ("Rivers [0][9] ; hills [003]", 3, "Rivers; hills [3]", [3], ["0", "9"]),
        ("[x] and [1;2] are no citations", 3, "[x] and [1;2] are no citations", [], []),
        (f"Big [{'7' * 50}, 1]", 1, "Big [1]", [1], ["7" * 50]),
        ("", 2, "", [], []),
        (None, 2, None, None, None),
    ],
)
def test_citations(spark, text, n, clean, valid, invalid):
    df = spark.createDataFrame([(text, n)], "x string, n int")
    r = df.select(t.clean_citations(F.col("x"), F.col("n")).alias("c"), t.valid_citations(F.col("x"), F.col("n")).alias("v"), t.invalid_citations(F.col("x"), F.col("n")).alias("i")).first()
    assert (r.c, r.v, r.i) == (clean, valid, invalid)


@pytest.mark.parametrize(
    "text,parts",
    [
        ("Birds sing at dawn! [2, 3] Owls do not. 40 bats sleep?", ["Birds sing at dawn! [2, 3]", "Owls do not.", "40 bats sleep?"]),
        ("Fruit (E.g. Plums) ripens. so it goes", ["Fruit (E.g. Plums) ripens. so it goes"]),
        ("It rains, i.e. [4] Snow is rare.", ["It rains, i.e. [4]", "Snow is rare."]),
        ("Old vs.\nNew roofs\n\n [1] [2]\n[3] Tiles", ["Old vs. New roofs [1] [2] [3]", "Tiles"]),
        ("[5] Stones first. \"Wood\" later", ["[5] Stones first.", '"Wood" later']),
        (" \n\t\n", []),
        ("", []),
        (None, None),
    ],
)
def test_sentences(spark, text, parts):
    assert one(spark, text, t.sentences) == parts


def test_sentences_of_a_long_text(spark):
    many = " ".join(f"Row {i} is set." for i in range(50_000))
    assert one(spark, many, lambda c: F.size(t.sentences(c))) == 50_000


def test_uncited_sentences(spark):
    assert one(spark, "Fine. Quite so. Grass is green in May [1]. Hay is dry.", t.uncited_sentences) == ["Hay is dry."]
    assert one(spark, "No EXCERPT tells the height. The Materials end here. Bees fly far.", t.uncited_sentences) == ["Bees fly far."]


def test_stop_words_are_distinct_tokens():
    assert len(set(t.STOP_WORDS)) == len(t.STOP_WORDS) and all(re.fullmatch("[a-z]+", w) for w in t.STOP_WORDS)

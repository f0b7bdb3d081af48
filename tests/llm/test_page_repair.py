import difflib

import pyarrow as pa
import pytest
from conftest import MID, SMALL

from aula.llm import page_repair as pr
from aula.llm import page_repair_queries as q
from pyspark.sql import functions as F

BODY = "The lens shows the ob- ject twice. It follows that the market is open. Every rnarket has a nurnber. This is pre- and post-market news."


def test_layout_of_edges():
    kinds = lambda t: pr.layout(t.split())
    assert kinds("Chapter 2 Polyquantic " + BODY) == {0: "header", 1: "header", 2: "header"}
    assert kinds("Chapter 2 Polyquantic 19 " + BODY) == {0: "header", 1: "header", 2: "header", 3: "page"}
    assert kinds("l9 SUPER HANDOUT Figure 3 shows it. " + BODY) == {0: "page", 1: "header", 2: "header"}
    assert kinds("Figure 3 shows it. " + BODY) == {}
    n = len(BODY.split())
    assert kinds(BODY + " Robot Sensing Notes -15-") == {n: "header", n + 1: "header", n + 2: "header", n + 3: "page"}
    assert kinds(BODY + " low- rank thread 23 of 96") == {n + 3: "page", n + 4: "page", n + 5: "page"}
    assert kinds(BODY + " Page 7") == {n: "page", n + 1: "page"}
    assert kinds("Chapter 2 Polyquantic") == {} and pr.layout([]) == {}


@pytest.mark.parametrize(
    "read,printed,n",
    [("rnarket", "market", 1), ("9r0up", "group", 2), ("mterkernule", "interkernule", 1), ("quasikement", "quasikernent", 1), ("cyde", "cycle", 1), ("siirvey", "survey", 1), ("tvvice", "twice", 1), ("c1ccfrocnccphalograph", "electroencephalograph", 6), ("cat", "cat", 0)],
)
def test_confusions_are_counted_without_a_cap(spark, read, printed, n):
    assert pr.canonical(read) == pr.canonical(printed) and pr.confusions(read, printed)[0] == n
    assert spark.createDataFrame([(printed,)], "x string").select(pr.canonical_column(F.col("x"))).first()[0] == pr.canonical(printed)


def test_every_confusion_keeps_the_canonical_form():
    for read, many in pr.CONFUSIONS.items():
        for printed in many:
            assert pr.canonical(f"x{read}x") == pr.canonical(f"x{printed}x") and pr.confusions(f"x{read}x", f"x{printed}x")[0] == 1
    assert pr.confusions("dog", "cat") is None and pr.confusions("", "a") is None


def test_long_words_torn_words_and_run_together_words(spark):
    words = "electroencephalograph magnetometer sparse window barrier matrix"
    lines = ["c1ccfrocnccphalograph", "magne", "tom", "eter", "sparsewindow", "sparscwindowbarrier", "mafrix", "unknownword"]
    frames = spark.createDataFrame([(1, "\n".join(lines), [0.9, 0.2, 0.3, 0.2, 0.9, 0.9, 0.9, 0.9])], "frame_id bigint, text string, word_confidences array<double>")
    got = pr.repair(frames, [spark.createDataFrame([(words,)], "t string")]).collect()[0]
    assert got.cleaned_text == "electroencephalograph magnetometer sparse window sparse window barrier matrix unknownword"
    assert {x.line_no for x in got.lines} == {1, 5, 6, 7}


def test_columns_are_taken_apart_as_rows():
    """Confidences and choices of all rows of a batch at once: NULL rows, NULL and missing values, and slices."""
    sure = pa.array([[0.2], None, [], [0.9, None, -1.0, 0.0, 0.6, 0.59], [0.1, float("nan")]], pa.list_(pa.float64()))
    first, low = pr._low(sure.slice(1))
    assert first == [0, 0, 0, 6, 8] and low.tolist() == [False, False, False, True, False, True, True, False]
    word = pa.struct([("at", pa.int32()), ("to", pa.int32()), ("word", pa.string()), ("cost", pa.float64()), ("evidence", pa.float64())])
    kind = pa.list_(pa.struct([("line", pa.int32()), ("source", pa.string()), ("words", pa.list_(word))]))
    one = lambda w: dict(zip(("at", "to", "word", "cost", "evidence"), w))
    a, b = (0, 3, "één", 1.0, 2.0), (1, 4, "two", 0.5, 0.0)
    rows = [[{"line": 9, "source": "x", "words": [one(b)]}], None, [{"line": 2, "source": "p", "words": [one(a), one(b)]}, {"line": 2, "source": "p|q", "words": None}], [], [{"line": 0, "source": "r", "words": [one(b)]}]]
    got = list(pr._options(pa.array(rows, kind).slice(1)))
    assert got == [{}, {2: [("p", [a, b]), ("p|q", [])]}, {}, {0: [("r", [b])]}]
    assert list(pr._options(pa.array([None], kind))) == [{}] and pr._low(pa.array([None], sure.type))[0] == [0, 0]


def test_readings_of_torn_and_broken_words():
    of = lambda text, low=(): list(pr.readings(text.split(), {}, set(low)))
    assert of("mar- ket lens") == [(0, "mar|ket"), (2, "lens")]
    assert of("pre- and post") == [(2, "post")]
    assert of("magne tom eter", [1]) == [(0, "magne"), (0, "magne+tom"), (0, "magne+tom+eter"), (1, "tom+eter"), (2, "eter")]
    assert of("magne tom eter") == [(0, "magne"), (2, "eter")]


def test_paragraphs_keep_all_words():
    words = (BODY.split() * 30) + ["tail"]
    out = pr.paragraphs(words)
    assert out.split() == words and out.count("\n\n") > 3
    assert pr.paragraphs([]) == ""


@pytest.fixture(scope="module")
def small(spark):
    page = "\n".join(("Chapter 2 Lenses " + BODY + " two- sided mar- kct 12").split())
    rows = [(1, page, None, 5), (2, None, None, 5), (3, "", [0.1], 5), (4, "Market\nobject\nnumber\n•\n\nopen\nmark\net", [0.9, 0.9, 0.9, 0.9, 0.9, 0.9, 0.2, 0.3], 5), (5, "x" * 30_000, [], 5)]
    frames = spark.createDataFrame(rows, "frame_id bigint, text string, word_confidences array<double>, line int")
    plain = [spark.createDataFrame([("market object number two-sided", None), (None, "")], "a string, b string")]
    return {r.frame_id: r for r in pr.repair(frames, plain).collect()}, page.split("\n")


def test_small_page(small):
    got, tokens = small
    lines = {(tokens[x.line_no - 1], x.noise_kind) for x in got[1].lines}
    assert lines == {("Chapter", "header"), ("2", "header"), ("Lenses", "header"), ("ob-", "hyphen"), ("rnarket", "misread"), ("nurnber.", "misread"), ("two-", "hyphen"), ("mar-", "hyphen"), ("kct", "misread"), ("12", "page")}
    text = got[1].cleaned_text
    assert "object twice." in text and "Every market has a number." in text and "pre- and post-market" in text and "two-sided market" in text and "Chapter" not in text and "12" not in text.split()


def test_nulls_empty_and_torn_words(small):
    got, _ = small
    assert got[2].lines == [] and got[2].cleaned_text is None and got[3].lines == [] and got[3].cleaned_text == ""
    assert got[4].lines == [] and got[4].cleaned_text.endswith("open market") and got[5].cleaned_text == "x" * 30_000


def test_empty_table(spark):
    frames = spark.createDataFrame([], "frame_id bigint, text string, word_confidences array<double>")
    assert pr.repair(frames, [spark.createDataFrame([("a b c",)], "t string")]).count() == 0


def test_held_out_accuracy(spark):
    """Misread words of frames that a vision model read too, with a lexicon from the other frames and the speech."""
    d = "/root/testdata/sf0.1"
    table = spark.read.parquet(f"{d}/visual_metadata.parquet").dropDuplicates(["frame_id"])
    plain = [table.filter("frame_id % 2 = 0").select("clean_text", "title"), spark.read.parquet(f"{d}/transcript_segments.parquet").select("text")]
    lines = pr.repair(table.select("frame_id", "text", "word_confidences"), plain).select("frame_id", F.explode("lines").alias("x")).filter("x.noise_kind = 'misread'").select("frame_id", "x.line_no").collect()
    found = {tuple(r) for r in lines}
    right = wrong = missed = 0
    for r in table.filter("frame_id % 2 = 1 AND clean_text <> '' AND text <> ''").select("frame_id", "text", "clean_text").collect():
        a, b = r.text.split("\n"), r.clean_text.split()
        for tag, i1, i2, j1, j2 in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
            for i in range(i1, i2):
                hit = (r.frame_id, i + 1) in found
                if tag == "equal":
                    wrong += hit
                elif tag == "replace" and i2 - i1 == j2 - j1 and pr.normal(a[i]) != pr.normal(b[j1 + i - i1]):
                    right += hit
                    missed += not hit
    print("misread words: right", right, "wrong", wrong, "missed", missed)
    assert right > 200 and wrong <= 0.02 * right and missed <= 0.03 * right


@pytest.mark.parametrize("d", [SMALL, MID])
def test_tables(spark, d):
    rows = q.p2_found(spark, d).collect()
    assert len({(r.frame_id, r.line_no) for r in rows}) == len(rows)
    kinds = {r.noise_kind for r in rows}
    assert kinds <= {"hyphen", "header", "page", "misread"} and (d == SMALL or len(kinds) == 4)
    texts = q.p2_texts(spark, d).collect()
    assert len(texts) == spark.read.parquet(f"{d}/visual_metadata.parquet").select("frame_id").distinct().count()

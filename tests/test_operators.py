"""Scenarios on hand-made rows: boundaries, ties and what must not be lost."""

import random

import pytest

from aula.operators import answers as an
from aula.operators import chunking as ck
from aula.operators import retrieval as rt
from aula.operators import timeline as tl
from aula.operators import verify as v
from aula.operators.cells import with_last, with_next
from aula.operators.keyframes import sample_times, select_keyframes
from aula.operators.ocr_clean import candidates, clean, counters, split_reply
from aula.operators.evaluation import hop_metrics, metrics
from aula.session import cut_lineage
from pyspark.sql import functions as F

SEG = "segment_id bigint, lecture_id string, start_timestamp double, end_timestamp double, text string"
KF = "frame_id bigint, lecture_id string, keyframe_timestamp double, text string, title string, description string, content_type string, clean_text string, cleaned_text string, slide_number int, image_path string, word_confidences array<double>"


def seg(spark, rows):
    return spark.createDataFrame(rows, SEG)


def frames(spark, times, titles=None, lecture="a"):
    return spark.createDataFrame([(i, lecture, t, f"text{i}", (titles or [""] * len(times))[i], None, None, "", None, None, f"k/frame_{t:.2f}.jpg", None) for i, t in enumerate(times)], KF)


def test_alignment_boundaries(spark):
    s = seg(spark, [(i, "a", t, t + 1, "x") for i, t in enumerate([5.0, 99.0, 100.0, 150.0])] + [(9, "a", None, None, "x"), (10, None, 5.0, 6.0, "x"), (11, "b", 5.0, 6.0, "x")])
    got = {r.segment_id: r.keyframe_timestamp for r in tl.align(s, frames(spark, [100.0, 0.0])).collect()}
    assert got == {0: 0.0, 1: 0.0, 2: 100.0, 3: 100.0, 9: None, 10: None, 11: None}
    assert tl.align(s.limit(0), frames(spark, [1.0])).count() == 0


def test_neighbours_cross_cells(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice(["a", "b", None]), rnd.uniform(0, 100), i, rnd.choice([None, i])) for i in range(200)]
    df = spark.createDataFrame(rows, "e string, t double, i int, v int")
    got = with_next(with_last(df, "e", ["t", "i"], F.col("v"), "last", size=7.0), "e", ["t", "i"], F.col("i"), "next", size=7.0)
    for e in ("a", "b", None):
        own = sorted((r for r in rows if r[0] == e), key=lambda r: (r[1], r[2]))
        seen, want = None, {}
        for k, r in enumerate(own):
            seen = r[3] if r[3] is not None else seen
            want[r[2]] = (seen, own[k + 1][2] if k + 1 < len(own) else None)
        assert {r.i: (r.last, r.next) for r in got.filter(F.col("e").eqNullSafe(F.lit(e))).collect()} == want


def test_knowledge_objects(spark):
    s = seg(spark, [(1, "a", 0.0, 4.0, " Salt dissolves"), (2, "a", 5.0, 9.0, " in warm water\t"), (3, "a", 100.0, 110.0, " crystals form later"), (4, "a", -5.0, -1.0, "noise")])
    f = frames(spark, [0.0, 50.0, 100.0])
    got = sorted(tl.knowledge_objects(f, tl.align(s, f)).collect(), key=lambda r: r.start_timestamp)
    assert [(r.transcript, r.end_timestamp, r.content_type) for r in got] == [("Salt dissolves in warm water", 50.0, ""), ("", 100.0, ""), ("crystals form later", 110.0, "")]


def objects(spark, spans, titles):
    return spark.createDataFrame(
        [(i, "L", s, e, "", titles[i], f"slide{i}", "", "", f"clean{i}", "", None, f"p{i}") for i, (s, e) in enumerate(spans)],
        "object_id bigint, lecture_id string, start_timestamp double, end_timestamp double, transcript string, title string, slide_text string, slide_description string, content_type string, clean_text string, cleaned_text string, slide_number int, image_path string",
    )


def pieces(spark, n, slide_of):
    rows = [(i, "L", 5.0 * i, 5.0 * i + 4, " ".join(f"s{5 * i}_{k}" for k in range(10)), slide_of(5.0 * i)) for i in range(n)]
    return spark.createDataFrame(rows, SEG + ", keyframe_timestamp double")


def build(spark, n, spans, titles, slide_of, **rules):
    return sorted(ck.build_chunks(pieces(spark, n, slide_of), objects(spark, spans, titles), ck.ChunkRules(**rules)).collect(), key=lambda c: c.start_timestamp)


SMALL = dict(target=25, most=40, overlap=1, least_last=0)


def test_chunks_of_one_slide(spark):
    got = build(spark, 6, [(0.0, 30.0)], ["T"], lambda t: 0.0, **SMALL)
    assert [len(c.text.split()) for c in got] == [30, 30, 20] and [c.chunk_id for c in got] == ["L_0", "L_10", "L_20"]
    assert [(c.start_timestamp, c.end_timestamp) for c in got] == [(0.0, 14.0), (10.0, 24.0), (20.0, 29.0)]
    assert [(c.prev_chunk_id, c.next_chunk_id) for c in got] == [(None, "L_10"), ("L_0", "L_20"), ("L_10", None)]
    assert [len(c.text.split()) for c in build(spark, 6, [(0.0, 30.0)], ["T"], lambda t: 0.0, target=25, most=40, overlap=1, least_last=50)] == [30, 40]
    assert len(build(spark, 6, [(0.0, 30.0)], ["T"], lambda t: 0.0, target=25, most=35, overlap=1, least_last=50)) == 3


def test_slide_aware_and_silent_slides(spark):
    aware = dict(target=15, most=40, overlap=1, least_last=0, slide_aware=True, aware_min=15)
    slide_of = lambda t: 0.0 if t < 15 else 15.0
    got = build(spark, 6, [(0.0, 15.0), (15.0, 30.0)], ["A", "B"], slide_of, **aware)
    assert len(got[0].text.split()) == 30 and got[0].slide_timestamps == [0.0]
    plain = build(spark, 6, [(0.0, 15.0), (15.0, 30.0)], ["A", "B"], slide_of, **{**aware, "slide_aware": False})
    assert len(plain[0].text.split()) == 20
    same = build(spark, 6, [(0.0, 15.0), (15.0, 30.0)], ["Same title", "Same TITLE"], slide_of, **aware)
    assert same[0].slide_timestamps == [0.0, 15.0]
    silent = build(spark, 6, [(0.0, 12.0), (12.0, 15.0), (15.0, 30.0), (30.0, 40.0)], ["A", "x", "B", "end"], lambda t: 0.0 if t < 15 else 15.0, **SMALL)
    assert 12.0 not in silent[0].slide_timestamps and 12.0 in silent[1].slide_timestamps and 30.0 in silent[-1].slide_timestamps
    with pytest.raises(ValueError):
        ck.ChunkRules(slide_text="other")
    lost = pieces(spark, 2, lambda t: 7.0)
    assert ck.missing_slides(lost, objects(spark, [(0.0, 30.0)], ["T"])).count() == 2


def test_keyframe_selection(spark):
    df = spark.createDataFrame([("u", 1, 0.0, 1.0), ("u", 2, 1.0, 1.5), ("u", 3, 2.0, 2.1), ("u", 4, 9.0, 2.1), ("u", 5, None, 9.0), ("w", 6, 0.0, None)], "e string, i int, t double, v double")
    got = sorted(r.i for r in select_keyframes(df, entity="e", time="t", tie="i", value="v", area=1.0, longest_gap=7.0).collect())
    assert got == [1, 3, 4, 6]
    px = spark.createDataFrame([("u", 1, 0.0, [0.0] * 4), ("u", 2, 1.0, [255.0] + [0.0] * 3), ("u", 3, 2.0, [255.0] * 2 + [0.0] * 2)], "e string, i int, t double, v array<double>")
    assert sorted(r.i for r in select_keyframes(px, entity="e", time="t", tie="i", value="v", area=0.3, longest_gap=50.0, pixel_threshold=40.0).collect()) == [1, 3]
    videos = spark.createDataFrame([("a", 2.5), ("b", 0.0)], "video_id string, duration double")
    assert [r.second for r in sample_times(videos, 1.0).orderBy("second").collect()] == [0.0, 1.0, 2.0]


def test_ocr_candidates_and_clean(spark):
    words = {"file": 10, "the": 8, "enough": 5, "almost": 4, "rare": 1, "42": 10, "of": 10}
    f = spark.createDataFrame([(i, "a", "\n".join(w for w, n in words.items() if i < n), None) for i in range(10)], "frame_id bigint, lecture_id string, text string, word_confidences array<double>")
    assert [(r.word, r.n_frames) for r in candidates(f).orderBy(F.desc("n_frames")).collect()] == [("file", 10), ("the", 8), ("enough", 5)]
    reply = spark.createDataFrame([("a", ["FILE:", "Nothing", "file"])], "lecture_id string, words array<string>")
    judged = split_reply(candidates(f), reply).collect()[0]
    assert judged.interface_words == ["file"] and judged.kept_as_content == ["enough", "the"]
    one = [(1, "a", "File\nViscosity\n~\nqZ\nflow", [0.88, 0.97, 0.1, 0.05, 0.8]), (2, "a", "x\ny", [0.3, -1.0]), (3, "a", "low", None), (4, "b", None, None)]
    junk = spark.createDataFrame([("a", ["file"])], "lecture_id string, interface_words array<string>")
    out = {r.frame_id: r for r in clean(spark.createDataFrame(one, f.schema), junk).collect()}
    assert out[1].cleaned_text == "Viscosity flow" and (out[1].before, out[1].after, out[1].dropped_symbol, out[1].dropped_interface, out[1].dropped_low_confidence) == (5, 2, 1, 1, 1)
    assert out[2].cleaned_text == "x y" and out[3].cleaned_text == "low" and out[3].without_confidences == 1 and out[4].cleaned_text == ""
    assert {r.lecture_id: r.before for r in counters(clean(spark.createDataFrame(one, f.schema), junk)).collect()} == {"a": 8, "b": 0}


def ranked(spark, lists):
    rows = [(1, no, m, x, float(s), r) for no, (m, items) in enumerate(lists) for r, (x, s) in enumerate(items, 1)]
    return spark.createDataFrame(rows, "qid bigint, list_no int, method string, id string, score double, rank int")


def order(df):
    return [r.id for r in df.orderBy("rank").collect()]


def test_fusion(spark):
    d = lambda *xs: ("dense", [(x, 0.5) for x in xs])
    assert order(rt.fuse(ranked(spark, [d("x", "y", "z"), d("y", "w")]), 10)) == ["y", "x", "w", "z"]
    assert order(rt.fuse(ranked(spark, [d("a", "b"), d("b", "a")]), 10)) == ["a", "b"] and order(rt.fuse(ranked(spark, [d("first"), d("second")]), 10)) == ["first", "second"]
    got = rt.fuse(ranked(spark, [("dense", [("x", 0.8)]), ("bm25", [("x", 14.2), ("y", 9.0)])]), 10).orderBy("rank").collect()
    assert [(r.id, r.score) for r in got] == [("x", 0.8), ("y", 0.0)]


def test_rerank(spark):
    df = spark.createDataFrame([(1, "a", 1, 0.5), (1, "mid", 2, 0.1), (1, "b", 3, 0.9)], "qid bigint, id string, rank int, pair_score double")
    assert order(rt.rerank(df, 3)) == ["b", "a", "mid"]
    blend = rt.rerank(df, 3, "blend").orderBy("rank").collect()
    assert [r.id for r in blend] == ["a", "b", "mid"] and blend[0].score == 0.5
    with pytest.raises(ValueError):
        rt.rerank(df, 3, "other")


def test_bm25_and_dense(spark):
    docs = spark.createDataFrame([(f"d{i}", "a", f"{i}", t) for i, t in enumerate(["bootstrap alpha", "bootstrap beta", "bootstrap gamma", "bootstrap delta", "bootstrap omega", ""])], "id string, lecture_id string, seq string, embed_text string")
    q = spark.createDataFrame([(1, "a", "the bootstrap"), (2, "a", "the of"), (3, "b", "bootstrap"), (4, "a", "alpha")], "qid bigint, lecture_id string, question string")
    got = rt.bm25_topk(rt.corpus_terms(docs, "embed_text"), q, 2).collect()
    assert {r.qid for r in got} == {1, 3, 4} and len([r for r in got if r.qid == 1]) == 2 and all(r.score > 0 for r in got)
    assert {r.qid for r in rt.bm25_topk(rt.corpus_terms(docs, "embed_text"), q, 2, filtered=True).collect()} == {1, 4}
    points = spark.createDataFrame([("a_0", "a", "1", [1.0, 0.0, 0.0]), ("a_100", "a", "2", [0.0, 1.0, 0.0]), ("b_0", "b", "3", [0.1, 0.9, 0.0]), ("n", "b", "4", None)], "id string, lecture_id string, seq string, vector array<double>")
    asked = spark.createDataFrame([(1, None, [0.0, 2.0, 0.0]), (2, "b", [0.0, 1.0, 0.0])], "qid bigint, lecture_id string, vector array<double>")
    for block in (1, 100):
        out = rt.dense_topk(points, asked, 3, block=block)
        assert order(out.filter("qid = 1")) == ["a_100", "b_0", "a_0"] and order(out.filter("qid = 2")) == ["b_0"]
    assert rt.dense_topk(points, asked.limit(0), 3).count() == 0
    for bad in ([], ["other"]):
        with pytest.raises(ValueError):
            rt.plan_signals(bad)
    assert rt.describe(["full"]) == "dense" and rt.describe(["full", "bm25"]) == "dense + keyword fusion" and rt.describe(["bm25", "bm25_speech"]) == "keyword fusion"


def test_metrics(spark):
    rows = [(1, True, "full", "t", 1), (2, True, "partial", None, 2), (3, True, None, "t", None), (4, True, "full", "t", 4), (5, False, None, None, None)]
    got = {r.grp: r for r in metrics(spark.createDataFrame(rows, "qid bigint, answerable boolean, answer_completeness string, item_type string, hit_rank int")).collect()}
    assert (got["all"].hits_at_1, got["all"].hits_at_3, got["all"].hits_at_5, got["all"].mrr) == (1, 2, 3, 0.4375)
    assert got["partial"]["count"] == 1 and got["full"]["count"] == 3 and got["type:t"]["count"] == 3
    place = "struct<lecture_id:string,ranges:array<struct<s:double,e:double>>>"
    hop = lambda s: ("L", [(s, s + 10.0)])
    items = spark.createDataFrame([(1, "L", [], [], [hop(0.0), hop(100.0)]), (2, "L", [], [], [hop(200.0), hop(500.0)])], f"qid bigint, lecture_id string, answer_ranges array<struct<s:double,e:double>>, extra_locations array<{place}>, hops array<{place}>")
    chunks = spark.createDataFrame([(f"c{i}", "L", 100.0 * i, 100.0 * i + 50) for i in range(3)], "id string, lecture_id string, start_timestamp double, end_timestamp double")
    results = spark.createDataFrame([(1, "c0", 1), (1, "c1", 3), (2, "c2", 2)], "qid bigint, id string, rank int")
    assert {r.k: (r.all_hops, r.hop_recall) for r in hop_metrics(results, chunks, items).collect()} == {1: (0.0, 0.25), 3: (0.5, 0.75), 5: (0.5, 0.75)}


def test_checks_find_what_was_broken(spark):
    s = [(1, "a", 5.0, 8.0, "tides rise"), (2, "a", 20.0, 30.0, "twice each day"), (3, "a", 105.0, 110.0, "moon and sun")]
    f = frames(spark, [0.0, 100.0], ["A", "B"]).withColumn("description", F.lit("d")).withColumn("content_type", F.lit("chart")).withColumn("cleaned_text", F.lit(""))
    good = seg(spark, s)
    al = cut_lineage(tl.align(good, f), "aligned")
    obs = cut_lineage(tl.knowledge_objects(f, al), "objects")
    chunks = cut_lineage(ck.build_chunks(al, obs), "chunks")

    def failing(only=None, segments=good, shots=f, objs=obs, aligned=al, ch=chunks):
        known = v.lectures_of(segments, shots, objs, aligned, ch)
        checks = {
            "t": lambda: v.check_transcript(segments, known), "k": lambda: v.check_keyframes(shots, known), "o": lambda: v.check_objects(objs, shots, segments),
            "a": lambda: v.check_alignment(aligned, segments, objs), "c": lambda: v.check_chunks(ch, objs, aligned, known),
        }
        return {r.check for r in v.union([checks[x]() for x in only or checks]).filter("status = 'FAIL'").collect()}

    assert failing() == set()
    assert failing("t", segments=seg(spark, [(1, "a", 5.0, 4.0, "tides rise"), *s[1:]])) == {"transcript ends after it starts"}
    assert "vision has a description" in failing("k", shots=f.withColumn("description", F.lit(None).cast("string")))
    assert failing("o", objs=obs.withColumn("transcript", F.lit(""))) == {"no speech lost or duplicated"}
    assert failing("a", aligned=al.withColumn("keyframe_timestamp", F.lit(0.0))) == {"alignment agrees with the slide spans"}
    assert failing("c", ch=chunks.withColumn("next_chunk_id", F.lit("x"))) == {"chunks point at the next one"}
    assert failing("c", ch=chunks.withColumn("slide_timestamps", F.array(F.lit(0.0)))) >= {"every slide is in some chunk"}
    assert failing("c", ch=chunks.withColumn("text", F.lit("other words"))) == {"all speech is in some chunk"}
    assert failing("c", ch=chunks.limit(0)) == {"chunks exist"}
    assert failing("o", objs=obs.limit(0)) == {"one object per keyframe", "no speech lost or duplicated"}
    assert failing("t", segments=good.limit(0)) == {"transcript has speech"} and failing("k", shots=f.limit(0)) == {"keyframes exist"}
    assert failing("o", objs=obs.withColumn("image_path", F.lit("d/b/keyframes/frame_0.00.jpg"))) == {"every object names its lecture"}
    assert [r.second for r in v.silent_slides(obs.withColumn("transcript", F.lit(" "))).orderBy("second").collect()] == [0, 100]
    images = f.select("lecture_id", F.col("image_path").alias("path"), F.col("keyframe_timestamp").alias("second"))
    named = lambda im: {r.check for r in v.check_files(im, f).filter("status = 'FAIL'").collect()}
    assert named(images) == set() and named(images.limit(1)) == {"keyframe files match the metadata", "every image path exists"}
    assert named(images.union(images.limit(1))) == {"keyframe files match the metadata"}


def test_lost_speech_against_all_pairs(spark):
    rnd = random.Random(9)
    some = lambda k: [rnd.choice([None, round(rnd.uniform(0, 50), 1)]) if rnd.random() < 0.1 else round(rnd.uniform(0, 50), 1) for _ in range(k)]
    speech = [(i, rnd.choice("ab"), *some(2), rnd.choice(["x", "y", ""])) for i in range(150)]
    chunks = [(rnd.choice("ab"), *some(2), rnd.choice(["x y", "x", None])) for _ in range(25)] + [("a", 0.0, 1e9, "x")]
    want = {i for i, l, s, e, t in speech if not any(l == m and None not in (s, e, a, b, h) and a <= s and e <= b and t in h for m, a, b, h in chunks)}
    got = v.lost_speech(spark.createDataFrame(speech, "segment_id bigint, lecture_id string, s double, e double, said string"), spark.createDataFrame(chunks, "lecture_id string, cs double, ce double, held string"), size=7.0, most_cells=3)
    assert {r.segment_id for r in got.collect()} == want


def test_ask(spark):
    def model(batch):
        if any("kappa" in p for p in batch):
            raise RuntimeError("no reply")
        full = {"coverage": "full", "answer": "A claim without any source at all. True [2]. False [9]."}
        return [full if "alpha" in p else {"coverage": "none", "answer": "No source here today."} if "omega" in p else {"coverage": "partial", "answer": "Nothing is cited by me."} for p in batch]

    cols = "id string, lecture_id string, seq string, start_timestamp double, end_timestamp double, slide_titles array<string>, clean_text string, cleaned_text string, slide_description string, text string, embed_text string, image_paths array<string>"
    texts = ["alpha beta", "gamma delta", "omega delta", "kappa sigma", "theta", "alpha iota"]
    chunks = spark.createDataFrame([(f"c{i}", "a", str(i), 60.0 * i, 9.0, ["T", "T"], "", "shown", "", t, t, [f"k\\frame_{i}.jpg"]) for i, t in enumerate(texts)], cols)
    asked = [(1, "a", "alpha?"), (2, "a", "omega"), (3, "a", "nothing known"), (4, None, "sigma"), (5, "a", "theta")]
    q = spark.createDataFrame(asked, "qid bigint, lecture_id string, question string")
    got = {r.qid: r for r in an.ask(chunks, q, model, k=2, signals=("bm25",)).collect()}
    assert got[1].answerable and got[1].cited == [2] and got[1].closest == [] and got[1].text.endswith("False.") and len(got[1].warnings) == 2 and got[1].banner == ""
    assert [tuple(s)[:7] for s in got[1].sources] == [(2, "a", "5:00", "0:09", ["T"], "/slides/a/frame_5.jpg", "alpha iota")]
    assert not got[2].answerable and [s.number for s in got[2].closest] == [1] and got[2].warnings == [] and got[2].banner and got[2].sources == []
    assert not got[3].answerable and got[3].text == an.NOTHING_FOUND and got[3].coverage == "none" and got[3].closest == [] and got[3].warnings == [] and not got[3].failed
    assert got[4].failed and got[4].text is None and not got[4].answerable and got[4].closest == []
    assert got[5].answerable and got[5].coverage == "partial" and got[5].warnings == ["cites no source"] and got[5].banner
    found = {r.qid: r for r in an.ask(chunks, q, None, k=2, signals=("bm25",)).collect()}
    assert [s.lecture_id for s in found[1].closest] == ["a", "a"] and {r.mode for r in found.values()} == {"search"} and found[3].closest == []


def test_answer_totals(spark):
    rows = [(True, False, True, "full", "full", False), (True, True, False, "full", "none", False), (False, True, False, None, "none", False), (None, True, False, None, "none", False), (True, False, True, "partial", "partial", False), (True, None, None, "full", None, True)]
    df = spark.createDataFrame(rows, "answerable boolean, refused boolean, cites_right boolean, completeness string, coverage string, failed boolean")
    assert tuple(an.answer_totals(df).collect()[0]) == (1, 1, 2, 1, 0, 1)

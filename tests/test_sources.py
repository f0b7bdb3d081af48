import json

import pytest
from conftest import SMALL

from aula import conf
from aula.sources import files, providers
from aula.sources.tables import read_records, read_table
from aula.sources.vector_store import VectorStore, collection_name
from aula.streaming import arrivals
from pyspark.sql import types as T


def test_records_are_distinct(spark):
    for table, key in (("transcript_segments", "segment_id"), ("chunks", "chunk_id")):
        a, b = read_table(spark, SMALL, table), read_records(spark, SMALL, table)
        assert b.count() == a.select(key).distinct().count() and "ingested_at" not in b.columns
    assert read_records(spark, SMALL, "documents", "doc_id").columns == ["doc_id"]


def test_json_lists(spark, tmp_path):
    schema = T.StructType([T.StructField("start", T.DoubleType()), T.StructField("text", T.StringType())])
    (tmp_path / "a.json").write_text(json.dumps([{"start": 1.0, "text": "x"}, {"start": 2.0}]))
    assert [tuple(r) for r in files.read_json_list(spark, str(tmp_path / "a.json"), schema).collect()] == [(1.0, "x"), (2.0, None)]
    (tmp_path / "b.json").write_text('[{"start": "no number"')
    with pytest.raises(Exception):
        files.read_json_list(spark, str(tmp_path / "b.json"), schema).collect()
    files.write_json(spark.createDataFrame([(1.0, "y")], schema), str(tmp_path / "out"))
    assert spark.read.schema(schema).json(str(tmp_path / "out")).collect()[0].text == "y"


def test_images_videos_and_results(spark, tmp_path):
    for lecture, names in (("l1", ["a.mp4"]), ("l2", ["a.mp4", "b.mkv"]), ("l3", ["frame_12.50.jpg", "frame_3.00.jpg", "x.jpg"])):
        (tmp_path / lecture).mkdir()
        for n in names:
            (tmp_path / lecture / n).write_bytes(b"1")
    assert sorted(r.second for r in files.scan_images(spark, str(tmp_path)).collect()) == [3.0, 12.5]
    videos = files.find_videos(spark, str(tmp_path))
    assert files.one_video(videos, "l1").endswith("l1/a.mp4")
    with pytest.raises(ValueError):
        files.one_video(videos, "l2")
    with pytest.raises(FileNotFoundError):
        files.one_video(videos, "l3")
    one, two = files.save_results(tmp_path, {"a": 1}), files.save_results(tmp_path, {"a": 2})
    assert one != two and json.loads(one.read_text()) == {"a": 1}
    names = spark.createDataFrame([("b",), ("a",), ("../x",), ("a",)], "lecture_id string")
    assert [r[0] for r in files.list_lectures(names).collect()] == ["a", "b"]


def test_vector_store(spark, tmp_path):
    store = VectorStore(spark, str(tmp_path), collection_name(spark, "org/Model-X"))
    assert store.at.endswith("/course_chunks__model-x") and store.count() == 0 and store.layout() is None
    chunks = spark.createDataFrame([("a_0", "a", 0.0, "one"), ("a_9", "a", 9.0, "two"), ("b_0", "b", 0.0, "three")], "chunk_id string, lecture_id string, start_timestamp double, text string")
    vectors = chunks.selectExpr("chunk_id", "explode(array('full', 'speech')) AS signal").selectExpr("chunk_id", "signal", "array(1.0D, 0.0D) AS vector")
    with pytest.raises(ValueError):
        store.upsert(chunks, vectors)
    store.create(["speech", "full"], 2)
    store.create(["full", "speech"], 2)
    with pytest.raises(ValueError):
        store.create(["full"], 2)
    store.upsert(chunks, vectors)
    store.upsert(chunks, vectors)
    assert store.count() == 3 and store.count("a") == 2 and [r.chunk_id for r in store.load().collect()] == ["a_0", "a_9", "b_0"]
    store.upsert(chunks.filter("chunk_id = 'a_9'"), vectors)
    assert store.count() == 3 and store.points("full").count() == 3
    with pytest.raises(ValueError):
        store.upsert(chunks, vectors.filter("signal = 'full'"))
    assert store.index("a", chunks.filter("lecture_id = 'a'"), vectors) is False
    assert store.index("a", chunks.filter("chunk_id = 'a_0'"), vectors.filter("chunk_id = 'a_0'")) is True and store.count("a") == 1
    store.delete_lecture("a")
    assert store.count() == 1


def test_providers(spark):
    df = spark.createDataFrame([(1, "x"), (2, "x"), (3, None)], "i int, t string")
    got = {r.i: r.v for r in providers.apply(df, "t", "v", providers.get("encoder", "hash"), "array<double>").collect()}
    assert got[1] == got[2] == providers.hash_vectors(["x"])[0] and got[3] is None
    some = spark.createDataFrame([(1, "p", None), (2, "q", ""), (3, "r", "done")], "i int, path string, description string")
    assert {r.i: r.description for r in providers.apply_pending(some, "path", "description", providers.get("vision", "echo")).collect()} == {1: "picture p", 2: "", 3: "done"}
    with pytest.raises(ValueError):
        providers.get("encoder", "absent")
    with pytest.raises(ValueError):
        providers.register("absent", "x", list)
    waits, calls = [], []

    def flaky(batch):
        calls.append(1)
        if len(calls) < 3:
            raise RuntimeError
        return batch

    assert providers.with_retries(flaky, 3, 1.0, waits.append)([1]) == [1] and waits == [1.0, 2.0]
    slept = []
    limit = providers.RateLimit(60, clock=lambda: 100.0, sleep=slept.append)
    for _ in range(3):
        limit.wait()
    assert slept == [1.0, 2.0] and providers.count_over_limit([1, 3, 4], 3) == 1


def test_settings(tmp_path):
    assert conf.EngineConf.from_env({"AULA_TOP_K": "3", "AULA_RERANK": "true", "AULA_SIGNALS": "full, bm25"}).signals == ("full", "bm25")
    for bad in ({"AULA_RERANK_MODE": "other"}, {"AULA_TOP_K": "0"}):
        with pytest.raises(ValueError):
            conf.EngineConf.from_env(bad)
    assert conf.lecture_settings(tmp_path) == conf.LECTURE_DEFAULTS
    (tmp_path / "settings.json").write_text('{"keyframes": {"longest_gap": 5}}')
    assert conf.lecture_settings(tmp_path)["keyframes"]["longest_gap"] == 5 and conf.LECTURE_DEFAULTS["keyframes"]["longest_gap"] == 60.0
    for bad in ('{"other": {}}', '{"keyframes": {"typo": 1}}'):
        (tmp_path / "settings.json").write_text(bad)
        with pytest.raises(ValueError):
            conf.lecture_settings(tmp_path)
    assert conf.check_question(" why? ", None, [], 5) == "why?"
    for args in (("", None, [], 5), ("q", "x", ["y"], 5), ("q", None, [], 11), ("q" * 1001, None, [], 5)):
        with pytest.raises(ValueError):
            conf.check_question(*args)


def test_streams(spark, tmp_path):
    rows = read_table(spark, SMALL, "transcript_segments")
    rows.orderBy("ingested_at").repartition(4).write.parquet(str(tmp_path / "in"))
    stream = arrivals.arrivals(spark, str(tmp_path / "in"), rows)
    once = arrivals.run_to_memory(arrivals.first_deliveries(stream, "segment_id", within="9000 days").select("segment_id"), "once", str(tmp_path / "c1"))
    assert once.count() == rows.select("segment_id").distinct().count()
    hours = arrivals.run_to_memory(arrivals.counts_by_hour(arrivals.arrivals(spark, str(tmp_path / "in"), rows), late="9000 days"), "hours", str(tmp_path / "c2"), "complete")
    assert hours.agg({"n": "sum"}).collect()[0][0] == rows.count()


def test_vector_cache_encodes_each_text_once(spark, tmp_path):
    from aula.sources.vector_cache import VectorCache

    cache = VectorCache(spark, str(tmp_path), "m", 9)
    texts = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, "b"), (5, "")], "i int, t string")
    assert cache.fill(texts, "t", providers.get("encoder", "hash")) == 3 and cache.fill(texts, "t", None) == 0
    got = {r.i: r.vector for r in cache.encode(texts, "t", None).collect()}
    assert got[1] == got[2] == providers.hash_vectors(["a"])[0] and got[3] is None and got[5] is not None
    more = spark.createDataFrame([("c",), ("a",)], "t string")
    assert cache.fill(more, "t", providers.get("encoder", "hash")) == 1
    assert VectorCache(spark, str(tmp_path), "other", 9).missing(more, "t").count() == 2 and cache.fill(more.limit(0), "t", None) == 0


def test_failing_inputs_have_no_result(spark):
    def picky(batch):
        if "bad" in batch:
            raise ValueError("bad")
        return [x.upper() for x in batch]

    df = spark.createDataFrame([("a",), ("bad",), (None,), ("c",)], "x string").coalesce(1)
    assert {r.x: r.y for r in providers.apply(df, "x", "y", picky, skip_errors=True).collect()} == {"a": "A", "bad": None, None: None, "c": "C"}
    for kind in providers.KINDS:
        if kind not in ("encoder", "pair"):
            assert len(providers.get(kind, "echo")(["x/y.mp4"])) == 1

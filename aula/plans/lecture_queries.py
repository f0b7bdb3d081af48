"""Queries on the lecture timeline: alignment, knowledge objects, chunks, keyframes, OCR clean-up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aula.functions.text import changed_share, frame_timestamp, search_tokens
from aula.operators.cells import asof_backward
from aula.operators.chunking import ChunkRules, build_chunks, fold, pieces, titles_of
from aula.operators.keyframes import select_keyframes
from aula.operators.ocr_clean import average_confidence, candidates, clean, counters, split_reply
from aula.operators.timeline import align, knowledge_objects, shown_at, slide_changes, speech_around
from aula.session import cut_lineage
from aula.sources.tables import read_records, read_table

AWARE = ChunkRules(slide_aware=True)
#: Words of menus and tool bars, standing in for the reply of a model.
INTERFACE_REPLY = ["File", "Edit", "View", "Insert", "Cell", "Kernel", "Widgets", "Help", "Tools", "Window", "Options", "Search", "Home", "Review"]


def segments(spark: SparkSession, d: str) -> DataFrame:
    return read_records(spark, d, "transcript_segments").filter("start_timestamp IS NOT NULL")


def keyframes(spark: SparkSession, d: str) -> DataFrame:
    return read_records(spark, d, "visual_metadata")


def aligned(spark: SparkSession, d: str) -> DataFrame:
    return align(segments(spark, d), keyframes(spark, d))


def objects(spark: SparkSession, d: str) -> DataFrame:
    return knowledge_objects(keyframes(spark, d), cut_lineage(aligned(spark, d), "aligned"))


def stages(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Aligned speech and knowledge objects, each written once, as the stages of the pipeline are."""
    speech = cut_lineage(aligned(spark, d), "aligned")
    return speech, cut_lineage(knowledge_objects(keyframes(spark, d), speech), "objects")


def moments(spark: SparkSession, d: str) -> DataFrame:
    """Starts of all answer ranges of the evaluation items."""
    items = read_table(spark, d, "eval_items").select("item_id", "lecture_id", F.posexplode("answer_ranges").alias("pos", "r"))
    return items.select((F.col("item_id") * 100 + F.col("pos")).alias("moment_id"), "lecture_id", F.col("r.s").alias("second"))


def asof_events(spark: SparkSession, d: str) -> DataFrame:
    """For each click of a user the last view at or before it."""
    events = read_table(spark, d, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    views = events.filter("event_type = 'view'").select("user_id", "t", F.col("event_id").alias("view_id"))
    clicks = events.filter("event_type = 'click'").select("user_id", "t", "event_id")
    return asof_backward(clicks, views, entity="user_id", left_time="t", right_time="t", payload=["view_id"], size=86_400.0 * 30).select("event_id", "user_id", "view_id")


def timeline_align(spark: SparkSession, d: str) -> DataFrame:
    return aligned(spark, d).select("segment_id", "lecture_id", "keyframe_timestamp")


def timeline_knowledge(spark: SparkSession, d: str) -> DataFrame:
    return objects(spark, d).select("object_id", "lecture_id", "start_timestamp", "end_timestamp", "transcript", "title", "slide_description", "content_type", "cleaned_text")


def slide_change(spark: SparkSession, d: str) -> DataFrame:
    frames = keyframes(spark, d).filter("keyframe_timestamp IS NOT NULL").select(F.col("frame_id").alias("object_id"), "lecture_id", F.col("keyframe_timestamp").alias("start_timestamp"), "title")
    return slide_changes(frames).select("object_id", "is_change")


def moment_lookup(spark: SparkSession, d: str) -> DataFrame:
    return shown_at(moments(spark, d), objects(spark, d)).select("moment_id", "object_id")


def moment_speech(spark: SparkSession, d: str) -> DataFrame:
    return speech_around(moments(spark, d), segments(spark, d))


def _fold(spark: SparkSession, d: str, rules: ChunkRules) -> DataFrame:
    numbered = cut_lineage(pieces(*stages(spark, d)), "pieces")
    return fold(numbered, rules).join(numbered.select("lecture_id", "seq", "segment_id"), ["lecture_id", "seq"]).select("segment_id", "lecture_id", F.col("bucket").cast("int").alias("bucket"))


def chunk_fold(spark: SparkSession, d: str) -> DataFrame:
    return _fold(spark, d, ChunkRules())


def chunk_fold_slide_aware(spark: SparkSession, d: str) -> DataFrame:
    return _fold(spark, d, AWARE)


def chunk_texts(spark: SparkSession, d: str) -> DataFrame:
    chunks = build_chunks(*stages(spark, d))
    return chunks.select(
        "chunk_id", "lecture_id", "start_timestamp", "end_timestamp", F.md5("text").alias("text_md5"), F.md5("embed_text").alias("embed_md5"), F.md5("slide_text").alias("slide_md5"),
        F.size("slide_timestamps").alias("n_slides"), F.array_join(F.col("slide_timestamps").cast("array<decimal(18,3)>").cast("array<string>"), ",").alias("slides"),
    )


def chunk_links(spark: SparkSession, d: str) -> DataFrame:
    return build_chunks(*stages(spark, d)).select("chunk_id", "prev_chunk_id", "next_chunk_id")


def unique_titles(spark: SparkSession, d: str) -> DataFrame:
    return titles_of(read_records(spark, d, "chunks", "chunk_id", "slide_titles")).select("chunk_id", F.array_join("titles", " | ").alias("titles"))


def image_scan(spark: SparkSession, d: str) -> DataFrame:
    """Time stamps in image paths."""
    return read_records(spark, d, "visual_metadata", "frame_id", "image_path").select("frame_id", frame_timestamp(F.col("image_path")).alias("second"))


def keyframe_select(spark: SparkSession, d: str) -> DataFrame:
    events = read_table(spark, d, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return select_keyframes(events, entity="user_id", time="t", tie="event_id", value="value", area=40.0, longest_gap=86_400.0).select("user_id", "event_id")


def keyframe_diff(spark: SparkSession, d: str) -> DataFrame:
    """Change between each vector and the one before, as if they were images."""
    v = read_table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    before = v.select((F.col("vec_id") + 1).alias("vec_id"), F.col("a").alias("b"))
    return v.join(before, "vec_id").select("vec_id", F.round(changed_share(F.col("a"), F.col("b"), 0.1), 6).alias("share"))


def _frames(spark: SparkSession, d: str) -> DataFrame:
    return read_records(spark, d, "visual_metadata", "frame_id", "lecture_id", "text", "word_confidences")


def df_candidates(spark: SparkSession, d: str) -> DataFrame:
    return candidates(_frames(spark, d))


def df_candidates_capped(spark: SparkSession, d: str) -> DataFrame:
    """The same with a low threshold and a cap of ten, which then decides."""
    return candidates(_frames(spark, d), share=0.05, least=2, most=10)


def _reply(spark: SparkSession, d: str) -> DataFrame:
    found = candidates(_frames(spark, d))
    replies = found.select("lecture_id").distinct().withColumn("words", F.array(*[F.lit(w) for w in [*INTERFACE_REPLY, "View", "nothing"]]))
    return split_reply(found, replies)


def junk_terms(spark: SparkSession, d: str) -> DataFrame:
    return _reply(spark, d).select("lecture_id", F.array_join("interface_words", " ").alias("interface_words"), F.array_join("kept_as_content", " ").alias("kept_as_content"))


def ocr_clean(spark: SparkSession, d: str) -> DataFrame:
    return clean(_frames(spark, d), _reply(spark, d)).select("frame_id", "cleaned_text", "before", "after")


def ocr_counters(spark: SparkSession, d: str) -> DataFrame:
    return counters(clean(_frames(spark, d), _reply(spark, d)))


def ocr_confidence(spark: SparkSession, d: str) -> DataFrame:
    return _frames(spark, d).select("frame_id", F.round(average_confidence(F.col("word_confidences")), 6).alias("average"))


def tokenize(spark: SparkSession, d: str) -> DataFrame:
    docs = read_records(spark, d, "documents", "doc_id", "text").select("doc_id", F.explode(search_tokens(F.col("text"))).alias("token"))
    return docs.groupBy("doc_id", "token").agg(F.count("*").alias("n"))


from aula.functions.text import STOP_WORDS, WS_RE2  # noqa: E402

STOP_SQL = "(" + ", ".join(f"'{w}'" for w in STOP_WORDS) + ")"
_strip = lambda c: f"regexp_replace({c}, '^{WS_RE2}+|{WS_RE2}+$', '', 'g')"
_norm = lambda c: f"regexp_replace(lower({c}), '^[^\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+$', '', 'g')"

BASE = f"""
seg AS (SELECT segment_id, any_value(lecture_id) AS lecture_id, any_value(start_timestamp) AS s, any_value(end_timestamp) AS e, any_value(text) AS text
  FROM transcript_segments GROUP BY segment_id HAVING any_value(start_timestamp) IS NOT NULL),
kf AS (SELECT frame_id, any_value(lecture_id) AS lecture_id, any_value(keyframe_timestamp) AS t, any_value(text) AS text, any_value(title) AS title, any_value(description) AS description,
  any_value(content_type) AS content_type, any_value(clean_text) AS clean_text, any_value(cleaned_text) AS cleaned_text, any_value(word_confidences) AS word_confidences, any_value(image_path) AS image_path
  FROM visual_metadata GROUP BY frame_id),
shots AS (SELECT DISTINCT lecture_id, t FROM kf WHERE t IS NOT NULL),
al AS (SELECT seg.*, shots.t AS kt FROM seg ASOF LEFT JOIN shots ON seg.lecture_id = shots.lecture_id AND seg.s >= shots.t),
last_end AS (SELECT lecture_id, e AS last_end FROM al QUALIFY row_number() OVER (PARTITION BY lecture_id ORDER BY s DESC, segment_id DESC) = 1),
spoken AS (SELECT lecture_id, kt, string_agg({_strip("coalesce(text, '')")}, ' ' ORDER BY s, segment_id) AS transcript FROM al WHERE kt IS NOT NULL GROUP BY ALL),
ob AS (SELECT frame_id AS object_id, kf.lecture_id, t AS s, coalesce(lead(t) OVER (PARTITION BY kf.lecture_id ORDER BY t, frame_id), last_end) AS e, coalesce(transcript, '') AS transcript,
  coalesce(title, '') AS title, coalesce(text, '') AS slide_text, coalesce(description, '') AS slide_description, coalesce(content_type, '') AS content_type,
  coalesce(clean_text, '') AS clean_text, coalesce(cleaned_text, '') AS cleaned_text
  FROM kf JOIN last_end ON kf.lecture_id = last_end.lecture_id LEFT JOIN spoken ON spoken.lecture_id = kf.lecture_id AND spoken.kt = kf.t WHERE t IS NOT NULL)"""

_MOMENTS = """
moments AS (SELECT item_id * 100 + i - 1 AS moment_id, lecture_id, r.s AS second FROM (
  SELECT item_id, lecture_id, unnest(answer_ranges) AS r, generate_subscripts(answer_ranges, 1) AS i FROM eval_items))"""


def fold_sql(rules: ChunkRules) -> str:
    """The fold as a recursion over piece numbers, with an overlap of one piece."""
    assert rules.overlap == 1
    aware = "TRUE" if rules.slide_aware else "FALSE"
    return f"""
titles AS (SELECT lecture_id, s AS kt, max(lower({_strip("title")})) AS own FROM ob GROUP BY ALL),
ordered AS (SELECT al.lecture_id, segment_id, al.s, al.e, al.kt, own, {_strip("coalesce(al.text, '')")} AS text,
    row_number() OVER (PARTITION BY al.lecture_id ORDER BY al.kt NULLS FIRST, al.s, segment_id) AS seq
  FROM al LEFT JOIN titles ON al.lecture_id = titles.lecture_id AND al.kt = titles.kt WHERE al.lecture_id IN (SELECT lecture_id FROM ob)),
pc AS (SELECT *, len(list_filter(regexp_split_to_array(text, '{WS_RE2}+'), lambda x: x <> '')) AS w, coalesce(own <> '', FALSE) AS titled,
    coalesce(own <> '' AND before <> '' AND own <> before, FALSE) AS changed
  FROM (SELECT *, lag(own) OVER (PARTITION BY lecture_id ORDER BY seq) AS before FROM ordered)),
fo AS (
  SELECT lecture_id, seq, segment_id, w, 0 AS bucket, 0 AS carried, 0 AS carried_words,
    CASE WHEN w >= {rules.target} AND NOT ({aware} AND titled) THEN 1 ELSE 0 END AS nb,
    CASE WHEN w >= {rules.target} AND NOT ({aware} AND titled) THEN 0 ELSE w END AS words,
    CASE WHEN w >= {rules.target} AND NOT ({aware} AND titled) THEN 0 ELSE 1 END AS n,
    CASE WHEN w >= {rules.target} AND NOT ({aware} AND titled) THEN 0 ELSE 1 END AS fresh
  FROM pc WHERE seq = 1
  UNION ALL
  SELECT lecture_id, seq, segment_id, w, b1, CASE WHEN f1 = 0 THEN n1 ELSE -1 END, CASE WHEN f1 = 0 THEN w1 ELSE 0 END,
    b1 + CASE WHEN post THEN 1 ELSE 0 END, CASE WHEN post THEN CASE WHEN n1 > 0 THEN w ELSE 0 END ELSE w1 + w END,
    CASE WHEN post THEN CASE WHEN n1 > 0 THEN 1 ELSE 0 END ELSE n1 + 1 END, CASE WHEN post THEN 0 ELSE f1 + 1 END
  FROM (SELECT *, w1 + w >= {rules.target} AND NOT ({aware} AND titled) AS post FROM (
    SELECT p.lecture_id, p.seq, p.segment_id, p.w, p.titled,
      f.nb + CASE WHEN pre THEN 1 ELSE 0 END AS b1, CASE WHEN pre THEN CASE WHEN f.n > 1 THEN f.w ELSE 0 END ELSE f.words END AS w1,
      CASE WHEN pre THEN CASE WHEN f.n > 1 THEN 1 ELSE 0 END ELSE f.n END AS n1, CASE WHEN pre THEN 0 ELSE f.fresh END AS f1
    FROM (SELECT f.*, p.seq AS ps, f.fresh > 0 AND (f.words + p.w > {rules.most} OR ({aware} AND f.words >= {rules.aware_min} AND p.changed)) AS pre
          FROM fo f JOIN pc p ON f.lecture_id = p.lecture_id AND p.seq = f.seq + 1) f
    JOIN pc p ON f.lecture_id = p.lecture_id AND p.seq = f.ps))),
bk AS (SELECT lecture_id, bucket, sum(w) AS new_words, max(carried_words) AS old_words, max(bucket) OVER (PARTITION BY lecture_id) AS last_bucket FROM fo GROUP BY lecture_id, bucket),
gone AS (SELECT lecture_id, last_bucket FROM bk WHERE last_bucket > 0 AND bucket >= last_bucket - 1 GROUP BY ALL
  HAVING sum(CASE WHEN bucket = last_bucket THEN new_words END) < {rules.least_last}
    AND sum(CASE WHEN bucket < last_bucket THEN new_words + old_words END) + sum(CASE WHEN bucket = last_bucket THEN new_words END) <= {rules.most}),
folded AS (SELECT fo.lecture_id, seq, segment_id, CASE WHEN bucket = gone.last_bucket THEN bucket - 1 ELSE bucket END AS bucket,
  CASE WHEN bucket = gone.last_bucket THEN -1 ELSE carried END AS carried FROM fo LEFT JOIN gone ON fo.lecture_id = gone.lecture_id)"""


_CHUNKS = f"""{BASE}, {fold_sql(ChunkRules())},
mem AS (SELECT lecture_id, bucket, seq FROM folded
  UNION ALL SELECT a.lecture_id, a.bucket + 1, a.seq FROM (SELECT *, row_number() OVER (PARTITION BY lecture_id, bucket ORDER BY seq DESC) AS back FROM folded) a
    JOIN folded b ON a.lecture_id = b.lecture_id AND b.bucket = a.bucket + 1 AND b.carried >= a.back),
sp AS (SELECT mem.lecture_id, mem.bucket, arg_min(pc.s, seq) AS s, arg_max(pc.e, seq) AS e, arg_max(struct_pack(e := pc.e), seq).e AS e2, string_agg(pc.text, ' ' ORDER BY seq) AS text FROM mem JOIN pc USING (lecture_id, seq) GROUP BY ALL),
per AS (SELECT lecture_id, kt, min(bucket) AS bucket FROM folded JOIN pc USING (lecture_id, seq) GROUP BY ALL),
silent AS (SELECT DISTINCT lecture_id, s AS kt FROM ob WHERE (lecture_id, s) NOT IN (SELECT lecture_id, kt FROM per WHERE kt IS NOT NULL)),
blank AS (SELECT silent.lecture_id, silent.kt, coalesce((SELECT arg_min(per.bucket, per.kt) FROM per WHERE per.lecture_id = silent.lecture_id AND per.kt > silent.kt),
  (SELECT max(bucket) FROM folded WHERE folded.lecture_id = silent.lecture_id)) AS bucket FROM silent),
shown AS (SELECT DISTINCT mem.lecture_id, mem.bucket, kt FROM mem JOIN pc USING (lecture_id, seq) WHERE kt IS NOT NULL UNION SELECT lecture_id, bucket, kt FROM blank WHERE bucket IS NOT NULL),
listed AS (SELECT shown.lecture_id, shown.bucket, count(*) AS n_slides, string_agg(CAST(CAST(kt AS DECIMAL(18,3)) AS VARCHAR), ',' ORDER BY kt, object_id) AS slides,
  coalesce(string_agg(nullif(slide_text, ''), chr(10) ORDER BY kt, object_id), '') AS slide_text, coalesce(string_agg(nullif(clean_text, ''), chr(10) ORDER BY kt, object_id), '') AS clean_text,
  coalesce(string_agg(nullif(slide_description, ''), chr(10) ORDER BY kt, object_id), '') AS slide_description
  FROM shown JOIN ob ON ob.lecture_id = shown.lecture_id AND ob.s = shown.kt GROUP BY ALL),
ch AS (SELECT sp.lecture_id || '_' || CAST(CAST(trunc(sp.s) AS BIGINT) AS VARCHAR) AS chunk_id, sp.lecture_id, sp.bucket, sp.s, e2 AS e, sp.text, coalesce(n_slides, 0) AS n_slides, coalesce(slides, '') AS slides,
  coalesce(slide_text, '') AS slide_text, coalesce(clean_text, '') AS clean_text, coalesce(slide_description, '') AS slide_description FROM sp LEFT JOIN listed ON sp.lecture_id = listed.lecture_id AND sp.bucket = listed.bucket)"""

_OCR = f"""{BASE},
tok AS (SELECT frame_id, lecture_id, unnest(string_split(text, chr(10))) AS w, generate_subscripts(string_split(text, chr(10)), 1) AS i,
   len(word_confidences) IS NOT DISTINCT FROM len(string_split(text, chr(10))) AS ok, word_confidences FROM kf WHERE text <> ''),
dfw AS (SELECT lecture_id, word, count(*) AS n_frames FROM (SELECT DISTINCT lecture_id, frame_id, {_norm('w')} AS word FROM tok) WHERE length(word) >= 3 AND regexp_full_match(word, '\\p{{L}}+') GROUP BY ALL),
tot AS (SELECT lecture_id, count(*) AS n FROM kf GROUP BY ALL),
cand AS (SELECT lecture_id, word, n_frames FROM dfw JOIN tot USING (lecture_id) WHERE n_frames >= greatest(5, n * 0.25)
  QUALIFY row_number() OVER (PARTITION BY lecture_id ORDER BY n_frames DESC, word) <= 80),
menu AS (SELECT lower(unnest({[*INTERFACE_REPLY]})) AS word, generate_subscripts({[*INTERFACE_REPLY]}, 1) AS i),
judged AS (SELECT tok.*, CASE WHEN NOT regexp_matches(w, '[\\p{{L}}\\p{{N}}_]') THEN 'symbol'
    WHEN cand.word IS NOT NULL AND {_norm('w')} IN (SELECT word FROM menu) THEN 'interface'
    WHEN ok AND word_confidences[i] >= 0 AND word_confidences[i] < 0.3 THEN 'low_confidence' ELSE 'keep' END AS reason
  FROM tok LEFT JOIN cand ON cand.lecture_id = tok.lecture_id AND cand.word = {_norm('w')}),
cleaned AS (SELECT kf.frame_id, kf.lecture_id, coalesce(string_agg(CASE WHEN reason = 'keep' THEN w END, ' ' ORDER BY i), '') AS cleaned_text, count(w) AS before, count_if(reason = 'keep') AS after,
  count_if(reason = 'symbol') AS dropped_symbol, count_if(reason = 'interface') AS dropped_interface, count_if(reason = 'low_confidence') AS dropped_low_confidence,
  CASE WHEN count(w) > 0 AND NOT bool_and(ok) THEN 1 ELSE 0 END AS without_confidences FROM kf LEFT JOIN judged USING (frame_id) GROUP BY ALL)"""

QUERIES = {
    f.__name__: f
    for f in (
        asof_events, timeline_align, timeline_knowledge, slide_change, moment_lookup, moment_speech, chunk_fold, chunk_fold_slide_aware, chunk_texts, chunk_links, unique_titles,
        image_scan, keyframe_select, keyframe_diff, df_candidates, df_candidates_capped, junk_terms, ocr_clean, ocr_counters, ocr_confidence, tokenize,
    )
}
SQL = {
    "asof_events": """SELECT c.event_id, c.user_id, v.event_id AS view_id FROM (SELECT * FROM events WHERE event_type = 'click') c
  ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON c.user_id = v.user_id AND c.ts >= v.ts""",
    "timeline_align": f"WITH {BASE} SELECT segment_id, lecture_id, kt AS keyframe_timestamp FROM al",
    "timeline_knowledge": f"WITH {BASE} SELECT object_id, lecture_id, s AS start_timestamp, e AS end_timestamp, transcript, title, slide_description, content_type, cleaned_text FROM ob",
    "slide_change": f"""WITH {BASE}, own AS (SELECT frame_id, lecture_id, t, lower({_strip("coalesce(title, '')")}) AS own FROM kf WHERE t IS NOT NULL)
  SELECT frame_id AS object_id, coalesce(own <> '' AND before <> '' AND own <> before, FALSE) AS is_change FROM (SELECT *, lag(own) OVER (PARTITION BY lecture_id ORDER BY t, frame_id) AS before FROM own)""",
    "moment_lookup": f"WITH {BASE}, {_MOMENTS} SELECT moment_id, arg_max(object_id, struct_pack(s := ob.s, o := object_id)) AS object_id FROM moments JOIN ob ON moments.lecture_id = ob.lecture_id AND ob.s <= second AND second < ob.e GROUP BY moment_id",
    "moment_speech": f"WITH {BASE}, {_MOMENTS} SELECT moment_id, segment_id FROM moments JOIN seg ON moments.lecture_id = seg.lecture_id AND seg.s BETWEEN second - 10 AND second + 10",
    "chunk_fold": f"WITH RECURSIVE {BASE}, {fold_sql(ChunkRules())} SELECT segment_id, lecture_id, CAST(bucket AS INTEGER) AS bucket FROM folded",
    "chunk_fold_slide_aware": f"WITH RECURSIVE {BASE}, {fold_sql(AWARE)} SELECT segment_id, lecture_id, CAST(bucket AS INTEGER) AS bucket FROM folded",
    "chunk_texts": f"""WITH RECURSIVE {_CHUNKS} SELECT chunk_id, lecture_id, s AS start_timestamp, e AS end_timestamp, md5(text) AS text_md5,
  md5(concat_ws(chr(10) || chr(10), nullif(clean_text, ''), nullif(slide_description, ''), text)) AS embed_md5, md5(slide_text) AS slide_md5, CAST(n_slides AS INTEGER) AS n_slides, slides FROM ch""",
    "chunk_links": f"""WITH RECURSIVE {_CHUNKS} SELECT chunk_id, lag(chunk_id) OVER w AS prev_chunk_id, lead(chunk_id) OVER w AS next_chunk_id FROM ch WINDOW w AS (PARTITION BY lecture_id ORDER BY bucket)""",
    "unique_titles": f"""WITH c AS (SELECT chunk_id, any_value(slide_titles) AS ts FROM chunks GROUP BY chunk_id), u AS (SELECT chunk_id, unnest(ts) AS t, generate_subscripts(ts, 1) AS i FROM c),
  f AS (SELECT chunk_id, t, min(i) AS i FROM u WHERE {_strip('t')} <> '' GROUP BY ALL)
  SELECT c.chunk_id, coalesce(string_agg(t, ' | ' ORDER BY i), '') AS titles FROM c LEFT JOIN f USING (chunk_id) WHERE ts IS NOT NULL GROUP BY 1 UNION ALL SELECT chunk_id, NULL FROM c WHERE ts IS NULL""",
    "image_scan": "SELECT frame_id, TRY_CAST(nullif(regexp_extract(any_value(image_path), 'frame_([0-9]+(?:\\.[0-9]+)?)\\.jpg$', 1), '') AS DOUBLE) AS second FROM visual_metadata GROUP BY frame_id",
    "keyframe_select": """WITH RECURSIVE o AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS t, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
  r AS (SELECT user_id, event_id, i, t AS lt, v AS lv, TRUE AS kept FROM o WHERE i = 1
    UNION ALL SELECT user_id, event_id, i, CASE WHEN k THEN t ELSE lt END, CASE WHEN k THEN v ELSE lv END, k
    FROM (SELECT o.*, r.lt, r.lv, abs(o.v - r.lv) > 40 OR o.t - r.lt >= 86400 AS k FROM r JOIN o ON o.user_id = r.user_id AND o.i = r.i + 1))
  SELECT user_id, event_id FROM r WHERE kept""",
    "keyframe_diff": """SELECT a.vec_id, round(len(list_filter(list_zip(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), lambda p: abs(p[1] - p[2]) > 0.1)) / len(a.embedding), 6) AS share
  FROM embeddings a JOIN embeddings b ON a.vec_id = b.vec_id + 1""",
    "df_candidates": f"WITH {_OCR} SELECT lecture_id, word, n_frames FROM cand",
    "df_candidates_capped": f"WITH {_OCR} SELECT lecture_id, word, n_frames FROM dfw JOIN tot USING (lecture_id) WHERE n_frames >= greatest(2, n * 0.05) QUALIFY row_number() OVER (PARTITION BY lecture_id ORDER BY n_frames DESC, word) <= 10",
    "junk_terms": f"""WITH {_OCR} SELECT lecture_id, coalesce(string_agg(CASE WHEN m.i IS NOT NULL THEN cand.word END, ' ' ORDER BY m.i), '') AS interface_words,
  coalesce(string_agg(CASE WHEN m.i IS NULL THEN cand.word END, ' ' ORDER BY cand.word), '') AS kept_as_content FROM cand LEFT JOIN menu m ON cand.word = m.word GROUP BY lecture_id""",
    "ocr_clean": f"WITH {_OCR} SELECT frame_id, cleaned_text, CAST(before AS INTEGER) AS before, CAST(coalesce(after, 0) AS INTEGER) AS after FROM cleaned",
    "ocr_counters": f"""WITH {_OCR} SELECT lecture_id, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in ('before', 'after', 'dropped_symbol', 'dropped_interface', 'dropped_low_confidence', 'without_confidences'))}
  FROM cleaned GROUP BY lecture_id""",
    "ocr_confidence": f"WITH {BASE} SELECT frame_id, round(list_avg(list_filter(word_confidences, lambda x: x >= 0)), 6) AS average FROM kf",
    "tokenize": f"SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM documents) WHERE token NOT IN {STOP_SQL} GROUP BY ALL",
}

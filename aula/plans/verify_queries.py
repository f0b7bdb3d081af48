"""Integrity checks over the stored tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aula.operators import verify as v
from aula.plans.lecture_queries import BASE, _strip
from aula.functions.text import WS_RE2, frame_timestamp
from aula.sources.tables import read_records, read_table


TABLES = ("transcript_segments", "visual_metadata", "knowledge_objects", "aligned_segments", "chunks")


def lectures(spark: SparkSession, d: str) -> DataFrame:
    return v.lectures_of(*[read_table(spark, d, t) for t in TABLES])


def verify_transcript(spark: SparkSession, d: str) -> DataFrame:
    return v.check_transcript(read_records(spark, d, "transcript_segments", "segment_id", "lecture_id", "start_timestamp", "end_timestamp"), lectures(spark, d))


def verify_keyframes(spark: SparkSession, d: str) -> DataFrame:
    return v.check_keyframes(read_records(spark, d, "visual_metadata"), lectures(spark, d))


def verify_content_types(spark: SparkSession, d: str) -> DataFrame:
    return v.content_types(read_records(spark, d, "visual_metadata", "frame_id", "lecture_id", "content_type"))


def verify_files(spark: SparkSession, d: str) -> DataFrame:
    """The pictures that the objects' run left, as the stored files, against the keyframes of this run."""
    stored = read_records(spark, d, "knowledge_objects", "object_id", "lecture_id", "image_path").filter("image_path <> ''")
    images = stored.select("lecture_id", F.col("image_path").alias("path"), frame_timestamp(F.col("image_path")).alias("second"))
    return v.check_files(images, read_records(spark, d, "visual_metadata", "frame_id", "lecture_id", "image_path", "keyframe_timestamp"))


def verify_objects(spark: SparkSession, d: str) -> DataFrame:
    return v.check_objects(read_records(spark, d, "knowledge_objects"), read_records(spark, d, "visual_metadata", "frame_id", "lecture_id", "keyframe_timestamp"), read_records(spark, d, "transcript_segments"))


def verify_silent_slides(spark: SparkSession, d: str) -> DataFrame:
    return v.silent_slides(read_records(spark, d, "knowledge_objects", "object_id", "lecture_id", "start_timestamp", "transcript"))


def verify_alignment(spark: SparkSession, d: str) -> DataFrame:
    return v.check_alignment(read_records(spark, d, "aligned_segments"), read_records(spark, d, "transcript_segments"), read_records(spark, d, "knowledge_objects"))


def verify_chunks(spark: SparkSession, d: str) -> DataFrame:
    return v.check_chunks(read_records(spark, d, "chunks"), read_records(spark, d, "knowledge_objects"), read_records(spark, d, "aligned_segments"), lectures(spark, d))


def verify_summary(spark: SparkSession, d: str) -> DataFrame:
    return v.summary(v.union([f(spark, d) for f in (verify_transcript, verify_keyframes, verify_files, verify_objects, verify_alignment, verify_chunks)]))


_W = lambda c: f"len(list_filter(regexp_split_to_array(coalesce({c}, ''), '{WS_RE2}+'), lambda x: x <> ''))"
_OBJ = """so AS (SELECT object_id, any_value(lecture_id) AS lecture_id, any_value(start_timestamp) AS s, any_value(end_timestamp) AS e, any_value(transcript) AS transcript, any_value(image_path) AS ip
  FROM knowledge_objects GROUP BY object_id HAVING any_value(start_timestamp) IS NOT NULL)"""


def _checks(source: str, checks: dict[str, tuple[str, str]]) -> str:
    parts = [f"SELECT lecture_id, '{name}' AS \"check\", {repr(bad)} AS bad, CAST(coalesce({c}, 0) AS BIGINT) AS n FROM {source}" for name, (c, bad) in checks.items()]
    return "SELECT lecture_id, \"check\", CASE WHEN bad = 'INFO' THEN 'INFO' WHEN n = 0 THEN 'PASS' ELSE bad END AS status, n FROM (" + " UNION ALL ".join(parts) + ")"


_LECTURES = "all_l AS (" + " UNION ".join(f"SELECT lecture_id FROM {t} WHERE lecture_id IS NOT NULL" for t in TABLES) + ")"


def _exist(rows: str, name: str) -> str:
    return f"""SELECT lecture_id, '{name}' AS "check", CASE WHEN n = 0 THEN 'PASS' ELSE 'FAIL' END AS status, CAST(n AS BIGINT) AS n
FROM (SELECT lecture_id, CASE WHEN lecture_id IN (SELECT lecture_id FROM {rows}) THEN 0 ELSE 1 END AS n FROM all_l)"""


_HUNDREDTH = lambda c: f"round_even(CAST({c} AS DECIMAL(38,6)), 2)"

QUERIES = {f.__name__: f for f in (verify_transcript, verify_keyframes, verify_content_types, verify_files, verify_objects, verify_silent_slides, verify_alignment, verify_chunks, verify_summary)}
SQL = {
    "verify_transcript": f"""WITH {BASE}, {_LECTURES}, o AS (SELECT *, lag(s) OVER (PARTITION BY lecture_id ORDER BY segment_id) AS before FROM seg), c AS (SELECT lecture_id, count_if(e < s) AS bad, count_if(s < before) AS ord FROM o GROUP BY 1)
{_exist('seg', 'transcript has speech')} UNION ALL
{_checks('c', {'transcript ends after it starts': ('bad', 'FAIL'), 'transcript is in time order': ('ord', 'FAIL')})}""",
    "verify_keyframes": f"""WITH {_LECTURES}, f AS (SELECT frame_id, any_value(lecture_id) AS lecture_id, any_value(keyframe_timestamp) AS t, any_value(description) AS d, any_value(content_type) AS ct, any_value(cleaned_text) AS cl, any_value(title) AS title,
  any_value(slide_number) AS sn, TRY_CAST(nullif(regexp_extract(any_value(image_path), 'frame_([0-9]+(?:\\.[0-9]+)?)\\.jpg$', 1), '') AS DOUBLE) AS named FROM visual_metadata GROUP BY frame_id),
c AS (SELECT lecture_id, count(t) - count(DISTINCT round_even(CAST(t AS DECIMAL(38,6)), 2)) AS twice, count(*) FILTER (d IS NULL) AS nd, count(*) FILTER (ct IS NULL) AS nt, count(*) FILTER (cl IS NULL) AS nc,
  count(*) FILTER (coalesce(abs(named - t) > 0.0051, TRUE)) AS un, count(*) FILTER (title = '') AS ti, count(sn) AS sn FROM f GROUP BY 1)
{_exist('f', 'keyframes exist')} UNION ALL
{_checks('c', {'keyframe timestamps are unique': ('twice', 'FAIL'), 'vision has a description': ('nd', 'FAIL'), 'vision has a content type': ('nt', 'FAIL'), 'clean-up is complete': ('nc', 'FAIL'), 'image names match the metadata': ('un', 'FAIL'), 'keyframes without a title': ('ti', 'INFO'), 'slide numbers': ('sn', 'INFO')})}""",
    "verify_content_types": "SELECT lecture_id, coalesce(ct, 'none') AS content_type, count(*) AS n FROM (SELECT frame_id, any_value(lecture_id) AS lecture_id, any_value(content_type) AS ct FROM visual_metadata GROUP BY 1) GROUP BY ALL",
    "verify_objects": f"""WITH {BASE}, {_OBJ}, chained AS (SELECT *, lead(s) OVER (PARTITION BY lecture_id ORDER BY s, object_id) AS nx FROM so),
per AS (SELECT lecture_id, count(*) AS nf, min(t) AS first FROM kf WHERE t IS NOT NULL GROUP BY 1),
cnt AS (SELECT lecture_id, count(*) AS n, count(*) FILTER (nx IS NOT NULL AND e IS DISTINCT FROM nx) AS broken, count(*) FILTER (e < s) AS back, sum({_W('transcript')}) AS words, count(*) FILTER ({_strip("coalesce(transcript, '')")} = '') AS silent,
  count(*) FILTER (string_split_regex(ip, '[\\\\/]')[-3] <> lecture_id) AS astray, floor((arg_max(struct_pack(e := e), struct_pack(s := s, o := object_id)).e - min(s)) / 60) AS minutes,
  count(*) FILTER ((lecture_id, s) NOT IN (SELECT lecture_id, t FROM shots)) AS apart FROM chained GROUP BY 1),
said AS (SELECT seg.lecture_id, sum(CASE WHEN s >= first THEN {_W('text')} END) AS said, sum(CASE WHEN s < first THEN {_W('text')} END) AS early FROM seg JOIN per USING (lecture_id) GROUP BY 1),
c AS (SELECT lecture_id, coalesce(n, 0) AS n, broken, back, coalesce(words, 0) AS words, silent, astray, minutes, apart, nf, said, early FROM cnt FULL JOIN per USING (lecture_id) LEFT JOIN said USING (lecture_id))
{_checks('c', {'one object per keyframe': ('abs(n - coalesce(nf, 0))', 'FAIL'), 'every object names its lecture': ('astray', 'FAIL'), 'objects start at their keyframe': ('apart', 'FAIL'), 'ends chain into the next start': ('broken', 'FAIL'), 'no object ends before it starts': ('back', 'FAIL'), 'no speech lost or duplicated': ('abs(words - coalesce(said, 0))', 'FAIL'), 'speech before the first keyframe': ('early', 'WARN'), 'slides nobody spoke during': ('silent', 'WARN'), 'minutes covered by the slides': ('minutes', 'INFO')})}""",
    "verify_alignment": f"""WITH {BASE}, {_OBJ}, spans AS (SELECT lecture_id, s AS slide, max(coalesce(e, 'inf'::DOUBLE)) AS slide_end FROM so GROUP BY ALL),
st AS (SELECT segment_id, any_value(keyframe_timestamp) AS stored, TRUE AS there FROM aligned_segments GROUP BY 1),
j AS (SELECT seg.segment_id, seg.lecture_id, seg.s, slide, slide_end, stored, there, coalesce(slide IS NOT NULL AND seg.s >= slide_end, FALSE) AS outside
  FROM seg ASOF LEFT JOIN spans ON seg.lecture_id = spans.lecture_id AND seg.s >= spans.slide LEFT JOIN st ON st.segment_id = seg.segment_id),
c AS (SELECT lecture_id, count(*) FILTER (there IS NULL) AS missing, count(*) FILTER (outside) AS outside, count(*) FILTER (there AND NOT outside AND stored IS DISTINCT FROM slide) AS other FROM j GROUP BY 1)
{_checks('c', {'alignment covers every segment': ('missing', 'FAIL'), 'all speech is on some slide': ('outside', 'FAIL'), 'alignment agrees with the slide spans': ('other', 'FAIL')})}""",
    "verify_chunks": f"""WITH {BASE}, {_OBJ}, {_LECTURES}, k AS (SELECT chunk_id, any_value(lecture_id) AS lecture_id, any_value(start_timestamp) AS s, any_value(end_timestamp) AS e, any_value(text) AS text, any_value(slide_timestamps) AS st,
  any_value(prev_chunk_id) AS pv, any_value(next_chunk_id) AS nx FROM chunks GROUP BY 1 HAVING any_value(start_timestamp) IS NOT NULL),
lk AS (SELECT *, {_W('text')} AS w, lag(chunk_id) OVER x AS before, lead(chunk_id) OVER x AS after FROM k WINDOW x AS (PARTITION BY lecture_id ORDER BY s, chunk_id)),
cnt AS (SELECT lecture_id, count(*) AS n, count(*) FILTER (pv IS DISTINCT FROM before) AS p, count(*) FILTER (nx IS DISTINCT FROM after) AS x, count(*) FILTER (w > 450) AS big, min(w) AS least, max(w) AS most, list_sort(list(w))[count(*) // 2 + 1] AS middle FROM lk GROUP BY 1),
sl AS (SELECT lecture_id, s AS t, max(e) AS slide_end FROM so GROUP BY ALL), fi AS (SELECT lecture_id, min(t) AS first FROM sl GROUP BY 1),
un AS (SELECT chunk_id, lecture_id, unnest(st) AS t FROM k),
per AS (SELECT k.chunk_id, k.lecture_id, k.s, k.e, first, count(un.t) AS n, count(*) FILTER (un.t IS NOT NULL AND slide_end IS NULL) AS unknown, min(un.t) AS earliest, greatest(0, max(slide_end)) AS latest
  FROM k LEFT JOIN un USING (chunk_id) LEFT JOIN sl ON sl.lecture_id = k.lecture_id AND sl.t = un.t LEFT JOIN fi ON fi.lecture_id = k.lecture_id GROUP BY ALL),
tm AS (SELECT lecture_id, count(*) FILTER (n = 0 OR (unknown = 0 AND coalesce((s < earliest AND s >= first) OR e > latest + 10, FALSE))) AS outside, count(*) FILTER (n > 0 AND unknown > 0) AS unknown FROM per GROUP BY 1),
uc AS (SELECT lecture_id, count(*) AS uncovered FROM sl WHERE (lecture_id, t) NOT IN (SELECT lecture_id, t FROM un WHERE t IS NOT NULL) GROUP BY 1),
sp AS (SELECT segment_id, any_value(lecture_id) AS lecture_id, any_value(start_timestamp) AS s, any_value(end_timestamp) AS e, {_strip("coalesce(any_value(text), '')")} AS said FROM aligned_segments GROUP BY 1),
lo AS (SELECT lecture_id, count(*) AS lost FROM sp WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.lecture_id = sp.lecture_id AND k.s <= sp.s AND sp.e <= k.e AND contains(k.text, sp.said)) GROUP BY 1),
c AS (SELECT cnt.*, outside, unknown, uncovered, lost FROM cnt LEFT JOIN tm USING (lecture_id) LEFT JOIN uc USING (lecture_id) LEFT JOIN lo USING (lecture_id))
{_exist('k', 'chunks exist')} UNION ALL
{_checks('c', {'chunk ids are unique': ('0', 'FAIL'), 'chunks point at the one before': ('p', 'FAIL'), 'chunks point at the next one': ('x', 'FAIL'), 'no chunk is over the maximum': ('big', 'FAIL'), 'smallest chunk': ('least', 'INFO'), 'median chunk': ('middle', 'INFO'), 'largest chunk': ('most', 'INFO'), 'chunk times lie inside their slides': ('outside', 'FAIL'), 'chunks list known slides': ('unknown', 'FAIL'), 'every slide is in some chunk': ('uncovered', 'FAIL'), 'all speech is in some chunk': ('lost', 'FAIL')})}""",
}
SQL |= {
    "verify_silent_slides": f"""WITH {_OBJ} SELECT lecture_id, CAST(trunc(s) AS BIGINT) AS second FROM so WHERE {_strip("coalesce(transcript, '')")} = ''""",
    "verify_files": rf"""WITH im AS (SELECT object_id, any_value(lecture_id) AS lecture_id, any_value(image_path) AS p FROM knowledge_objects GROUP BY 1 HAVING any_value(image_path) <> ''),
st AS (SELECT lecture_id, array_to_string(string_split(replace(p, '\', '/'), '/')[-3:], '/') AS p, {_HUNDREDTH("TRY_CAST(nullif(regexp_extract(p, 'frame_([0-9]+(?:[.][0-9]+)?)[.]jpg$', 1), '') AS DOUBLE)")} AS t FROM im),
fr AS (SELECT frame_id, any_value(lecture_id) AS lecture_id, array_to_string(string_split(replace(any_value(image_path), '\', '/'), '/')[-3:], '/') AS p, {_HUNDREDTH('any_value(keyframe_timestamp)')} AS t FROM visual_metadata GROUP BY 1),
tm AS (SELECT coalesce(a.lecture_id, b.lecture_id) AS lecture_id, coalesce(a.n, 0) - coalesce(b.n, 0) AS surplus, (a.n IS NULL OR b.n IS NULL)::INTEGER AS alone
  FROM (SELECT lecture_id, t, count(*) AS n FROM st GROUP BY ALL) a FULL JOIN (SELECT lecture_id, t, count(*) AS n FROM fr GROUP BY ALL) b ON a.lecture_id = b.lecture_id AND a.t IS NOT DISTINCT FROM b.t),
c AS (SELECT lecture_id, greatest(sum(alone), abs(sum(surplus))) AS bad, (SELECT count(*) FROM fr WHERE fr.lecture_id = tm.lecture_id AND NOT EXISTS (SELECT 1 FROM st WHERE st.lecture_id = fr.lecture_id AND st.p = fr.p)) AS missing FROM tm GROUP BY lecture_id)
{_checks('c', {'keyframe files match the metadata': ('bad', 'FAIL'), 'every image path exists': ('missing', 'FAIL')})}""",
}
_ALL = " UNION ALL ".join(f"SELECT * FROM ({SQL[k]})" for k in ("verify_transcript", "verify_keyframes", "verify_files", "verify_objects", "verify_alignment", "verify_chunks"))
SQL["verify_summary"] = f'SELECT "check", status, count(*) AS lectures, CAST(sum(n) AS BIGINT) AS n FROM ({_ALL}) GROUP BY ALL'

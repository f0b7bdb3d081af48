"""Queries on search, evaluation and answers, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aula.functions.text import ABBREVIATIONS, ABOUT_MATERIAL, LEAST_CITED_WORDS, STOP_WORDS, WS_RE2, cache_key, format_timestamp, point_id, preview, result_line, sentences, source_line, uncited_sentences
from aula.operators import answers as an
from aula.operators.answers import ask, check_answers, describe, prompts
from aula.operators.evaluation import hop_metrics, mean_length, metrics, ranks, score_range
from aula.operators.retrieval import B, DIGITS, EPSILON, K1, RRF_K, bm25_topk, corpus_stats, corpus_terms, dense_topk, fuse, hash_encode, retrieve
from aula.plans.lecture_queries import _strip
from aula.session import cut_lineage
from aula.sources.providers import get
from aula.sources.tables import read_records, read_table

TOP = 10


def _seq(lecture: Column, start: Column, key: Column) -> Column:
    """Order of lecture and time as one string."""
    return F.concat(lecture, F.lit("|"), F.lpad(F.round(F.coalesce(start, F.lit(-1.0)) * 1000).cast("bigint").cast("string"), 15, "0"), F.lit("|"), key)


def chunk_rows(spark: SparkSession, d: str, *more: str) -> DataFrame:
    """Chunks with the two texts that are searched, written once; other columns are read where they are needed."""
    chunks = read_records(spark, d, "chunks", "chunk_id", "lecture_id", "start_timestamp", "end_timestamp", "text", "embed_text", *more).withColumnRenamed("chunk_id", "id")
    return cut_lineage(chunks.withColumn("seq", _seq(F.col("lecture_id"), F.col("start_timestamp"), F.col("id"))), "chunks")


#: What prompts and lines show of a chunk beside the searched columns.
SHOWN = ("slide_titles", "clean_text", "cleaned_text", "slide_description", "image_paths")


def items(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "eval_items").withColumnRenamed("item_id", "qid")


def _index(chunks: DataFrame) -> DataFrame:
    """The inverted index, written once as statistics and scores both read it."""
    return cut_lineage(corpus_terms(chunks, "embed_text"), "index")


def bm25_stats(spark: SparkSession, d: str) -> DataFrame:
    return corpus_stats(_index(chunk_rows(spark, d)), []).select("term", "df", F.round("idf", 6).alias("idf"), F.round("avgdl", 6).alias("avgdl"))


def _out(df: DataFrame) -> DataFrame:
    return df.select("qid", F.col("id").alias("chunk_id"), F.round("score", 6).alias("score"), "rank")


def bm25_top(spark: SparkSession, d: str) -> DataFrame:
    return _out(bm25_topk(_index(chunk_rows(spark, d)), items(spark, d), TOP))


def bm25_top_filtered(spark: SparkSession, d: str) -> DataFrame:
    return _out(bm25_topk(_index(chunk_rows(spark, d)), items(spark, d), TOP, filtered=True))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("lecture_id"), F.col("vec_id").alias("seq"), F.col("embedding").alias("vector"))


def knn_topk(spark: SparkSession, d: str) -> DataFrame:
    """Every vector whose number is divisible by 50, against all vectors."""
    v = _vectors(spark, d)
    asked = v.filter("id % 50 = 0").select(F.col("id").alias("qid"), F.lit(None).cast("string").alias("lecture_id"), "vector")
    return dense_topk(v, asked, 5).select("qid", "id", F.round("score", 6).alias("score"), "rank")


def knn_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    """The same among vectors of the query's own label."""
    v = _vectors(spark, d)
    return dense_topk(v, v.filter("id % 50 = 0").select(F.col("id").alias("qid"), "lecture_id", "vector"), 5).select("qid", "id", F.round("score", 6).alias("score"), "rank")


def rrf_two(spark: SparkSession, d: str) -> DataFrame:
    """Fusion of the vectors and the vectors with their halves swapped."""
    v = _vectors(spark, d)
    asked = v.filter("id % 50 = 0").select(F.col("id").alias("qid"), F.lit(None).cast("string").alias("lecture_id"), "vector")
    swapped = v.withColumn("vector", F.concat(F.slice("vector", 33, 32), F.slice("vector", 1, 32)))
    a = dense_topk(v, asked, 20).select("qid", F.lit(0).alias("list_no"), F.lit("dense").alias("method"), "id", "score", "rank")
    b = dense_topk(swapped, asked, 20).select("qid", F.lit(1).alias("list_no"), F.lit("dense").alias("method"), "id", "score", "rank")
    return fuse(a.unionByName(b), TOP).select("qid", "id", F.round("score", 6).alias("score"), F.round("fused", 9).alias("fused"), "rank")


def encode_chunks(spark: SparkSession, d: str) -> DataFrame:
    made = hash_encode(chunk_rows(spark, d), ["id"], "embed_text")
    return made.select(F.col("id").alias("chunk_id"), F.array_join(F.transform("vector", lambda x: F.format_string("%.4f", F.round(x, 4))), " ").alias("vector"))


def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    return _out(retrieve(chunk_rows(spark, d), items(spark, d), k=TOP))


def hybrid_search_filtered(spark: SparkSession, d: str) -> DataFrame:
    return _out(retrieve(chunk_rows(spark, d), items(spark, d), k=TOP, filtered=True))


def rerank_replace(spark: SparkSession, d: str) -> DataFrame:
    return _out(retrieve(chunk_rows(spark, d), items(spark, d), k=5, signals=("bm25",), rerank_mode="replace"))


def rerank_blend(spark: SparkSession, d: str) -> DataFrame:
    return _out(retrieve(chunk_rows(spark, d), items(spark, d), k=5, signals=("bm25",), rerank_mode="blend"))


def _evaluated(spark: SparkSession, d: str, *more: str):
    """As an evaluation searches: every lecture with all signals, questions without a lecture included."""
    chunks, asked = chunk_rows(spark, d, *more), items(spark, d)
    return cut_lineage(retrieve(chunks, asked, k=TOP), "results"), chunks, asked


def eval_ranks(spark: SparkSession, d: str) -> DataFrame:
    results, chunks, asked = _evaluated(spark, d)
    return ranks(results, chunks, asked, TOP).select("qid", "hit_rank", "strict_rank", F.round("top_score", 6).alias("top_score"))


def eval_metrics(spark: SparkSession, d: str) -> DataFrame:
    results, chunks, asked = _evaluated(spark, d)
    return metrics(ranks(results, chunks, asked, TOP))


def eval_metrics_strict(spark: SparkSession, d: str) -> DataFrame:
    results, chunks, asked = _evaluated(spark, d)
    return metrics(ranks(results, chunks, asked, TOP), "strict_rank")


def eval_hops(spark: SparkSession, d: str) -> DataFrame:
    return hop_metrics(*_evaluated(spark, d))


def eval_score_range(spark: SparkSession, d: str) -> DataFrame:
    results, chunks, asked = _evaluated(spark, d)
    return score_range(ranks(results, chunks, asked, TOP))


def eval_mean_length(spark: SparkSession, d: str) -> DataFrame:
    results, chunks, _ = _evaluated(spark, d)
    return mean_length(results, chunks)


def point_ids(spark: SparkSession, d: str) -> DataFrame:
    return read_records(spark, d, "chunks", "chunk_id").select("chunk_id", point_id(F.col("chunk_id")).alias("point_id"))


def cache_keys(spark: SparkSession, d: str) -> DataFrame:
    return read_records(spark, d, "documents", "doc_id", "text").select("doc_id", cache_key("hash-64", 3072, F.col("text")).alias("key"))


def previews(spark: SparkSession, d: str) -> DataFrame:
    return read_records(spark, d, "documents", "doc_id", "text").select("doc_id", preview(F.col("text")).alias("preview"))


def fmt_time(spark: SparkSession, d: str) -> DataFrame:
    return read_records(spark, d, "transcript_segments", "segment_id", "start_timestamp").filter("start_timestamp IS NOT NULL").select("segment_id", format_timestamp(F.col("start_timestamp")).alias("shown"))


def source_lines(spark: SparkSession, d: str) -> DataFrame:
    c = read_records(spark, d, "chunks", "chunk_id", "lecture_id", "start_timestamp", "end_timestamp", "slide_titles")
    return c.select("chunk_id", source_line(F.lit(1), F.col("lecture_id"), F.col("start_timestamp"), F.col("end_timestamp"), F.coalesce("slide_titles", F.array().cast("array<string>"))).alias("line"))


def result_lines(spark: SparkSession, d: str) -> DataFrame:
    results, chunks, _ = _evaluated(spark, d, "slide_titles")
    line = result_line(F.col("rank"), F.col("score"), F.col("lecture_id"), F.col("start_timestamp"), F.col("end_timestamp"), F.coalesce("slide_titles", F.array().cast("array<string>")))
    return results.join(chunks, "id").select("qid", "rank", line.alias("line"))


def _answers(spark: SparkSession, d: str) -> DataFrame:
    """Reference answers as a model could have written them: in turn without a citation, with one that does not exist,
    with good, bad and missing ones, and with good ones in a refusal."""
    kind, text = F.pmod("qid", F.lit(4)), F.col("reference_answer")
    written = (
        F.when(kind == 0, F.concat(text, F.lit(" It is said once more, cf. The last part of the lecture.")))
        .when(kind == 1, F.concat(text, F.lit(" [7].")))
        .when(kind == 2, F.concat(F.lit("In short [02, 7]. "), text, F.lit(" [3,1] Then it goes on. See [0] .\n[2] Nothing more")))
        .otherwise(F.concat(text, F.lit(" [1]. The material says no more.")))
    )
    coverage = F.when(kind == 3, "none").when(kind == 2, "partial").otherwise("full")
    return items(spark, d).filter("reference_answer IS NOT NULL").select("qid", written.alias("answer"), F.lit(3).alias("n_sources"), coverage.alias("coverage"))


def citations(spark: SparkSession, d: str) -> DataFrame:
    c = check_answers(_answers(spark, d))
    return c.select("qid", "answerable", "cleaned", F.array_join(F.col("cited").cast("array<string>"), ",").alias("cited"), F.array_join("invalid", ",").alias("invalid"), F.size("warnings").alias("n_warnings"))


def split_sentences(spark: SparkSession, d: str) -> DataFrame:
    docs = read_records(spark, d, "documents", "doc_id", "text")
    return docs.select("doc_id", F.posexplode(sentences(F.col("text"))).alias("pos", "sentence"))


def uncited(spark: SparkSession, d: str) -> DataFrame:
    return _answers(spark, d).select("qid", F.posexplode(uncited_sentences(F.col("answer"))).alias("pos", "sentence"))


def ask_answers(spark: SparkSession, d: str) -> DataFrame:
    """The whole way from question to checked answer with the stand-in model."""
    asked = ask(chunk_rows(spark, d, *SHOWN), items(spark, d).select("qid", "lecture_id", "question"), get("answer", "echo"), k=3, signals=("bm25",))
    names = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(" ", x.number.cast("string"), x.lecture_id, x.start_label)), " / ")
    return asked.select("qid", "mode", "coverage", "answerable", "banner", "text", F.array_join(F.col("cited").cast("array<string>"), ",").alias("cited"), F.size("warnings").alias("n_warnings"), names("sources").alias("sources"), names("closest").alias("closest"))


def describe_sources(spark: SparkSession, d: str) -> DataFrame:
    """All chunks as a reader would see them."""
    c = read_records(spark, d, "chunks", "chunk_id", "lecture_id", "start_timestamp", "end_timestamp", "text", *SHOWN).withColumn("x", describe(F.lit(1), F.length(F.coalesce("text", F.lit(""))) / 1000.0))
    return c.select("chunk_id", "x.lecture_id", "x.start_label", "x.end_label", F.array_join("x.titles", " | ").alias("titles"), "x.image_url", "x.excerpt", "x.score")


def prompt_build(spark: SparkSession, d: str) -> DataFrame:
    results, chunks, asked = _evaluated(spark, d, *SHOWN)
    return prompts(results.filter("rank <= 5"), chunks, asked.select("qid", "question"))


STOP_SQL = "(" + ", ".join(f"'{w}'" for w in STOP_WORDS) + ")"
_BASE = f"""
ch AS (SELECT chunk_id, any_value(lecture_id) AS lecture_id, any_value(start_timestamp) AS s, any_value(end_timestamp) AS e, any_value(text) AS text, any_value(embed_text) AS embed_text,
  any_value(lecture_id) || '|' || lpad(CAST(CAST(round(coalesce(any_value(start_timestamp), -1) * 1000) AS BIGINT) AS VARCHAR), 15, '0') || '|' || chunk_id AS seq FROM chunks GROUP BY chunk_id),
tok AS (SELECT chunk_id, unnest(regexp_extract_all(lower(coalesce(embed_text, '')), '[a-z0-9]+')) AS term FROM ch),
post AS (SELECT chunk_id, term, count(*) AS tf FROM tok WHERE term NOT IN {STOP_SQL} GROUP BY ALL),
len AS (SELECT ch.chunk_id, lecture_id, seq, coalesce(sum(tf), 0) AS dl FROM ch LEFT JOIN post USING (chunk_id) GROUP BY ALL),
qt AS (SELECT item_id AS qid, lecture_id, term, count(*) AS qn FROM (SELECT item_id, lecture_id, unnest(regexp_extract_all(lower(question), '[a-z0-9]+')) AS term FROM eval_items) WHERE term NOT IN {STOP_SQL} GROUP BY ALL)"""


def _bm25_sql(filtered: bool, k: int, name: str) -> str:
    """``filtered``: by lecture, and over all of them for questions without one."""
    own = "SELECT lecture_id AS g, * FROM len UNION ALL " if filtered else ""
    return f"""
{name}_l AS ({own}SELECT '*' AS g, * FROM len),
{name}_n AS (SELECT g, count(*) AS n_docs, avg(dl) AS avgdl FROM {name}_l GROUP BY 1),
{name}_d AS (SELECT g, term, count(*) AS df FROM post JOIN {name}_l USING (chunk_id) GROUP BY ALL),
{name}_r AS (SELECT g, term, df, avgdl, ln(n_docs - df + 0.5) - ln(df + 0.5) AS raw FROM {name}_d JOIN {name}_n USING (g)),
{name}_i AS (SELECT g, term, df, avgdl, CASE WHEN raw < 0 THEN {EPSILON} * avg(raw) OVER (PARTITION BY g) ELSE raw END AS idf FROM {name}_r),
{name} AS (SELECT qid, chunk_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, seq) AS rank FROM (
  SELECT qid, chunk_id, seq, round(score, {DIGITS}) AS score FROM (
    SELECT qid, l.chunk_id, l.seq, sum(qn * idf * tf * {K1 + 1} / (tf + {K1} * (1 - {B} + {B} * dl / avgdl))) AS score
    FROM qt q JOIN post p ON q.term = p.term JOIN {name}_l l ON l.chunk_id = p.chunk_id AND l.g = {"coalesce(q.lecture_id, '*')" if filtered else "'*'"} JOIN {name}_i i ON i.term = q.term AND i.g = l.g
    GROUP BY ALL) WHERE score > 0) QUALIFY rank <= {k})"""


def _encode_sql(name: str, source: str, key: str, text: str) -> str:
    return f"""
{name}_t AS (SELECT {key}, CAST(('0x' || substr(md5(term), 1, 4)) AS BIGINT) % 64 AS b, count(*) AS n FROM (SELECT {key}, unnest(regexp_extract_all(lower(coalesce({text}, '')), '[a-z0-9]+')) AS term FROM {source}) WHERE term NOT IN {STOP_SQL} GROUP BY ALL),
{name}_n AS (SELECT {key}, sqrt(sum(n * n)) AS norm FROM {name}_t GROUP BY ALL)"""


def _dense_sql(name: str, points: str, k: int, filtered: bool) -> str:
    same = "AND (q.lecture_id IS NULL OR c.lecture_id = q.lecture_id)" if filtered else ""
    return f"""
{name} AS (SELECT qid, chunk_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, seq) AS rank FROM (
  SELECT q.item_id AS qid, c.chunk_id, c.seq, round(coalesce(max(dot) / (max(qn.norm) * max(pn.norm)), 0), {DIGITS}) AS score
  FROM eval_items q JOIN ch c ON TRUE {same} LEFT JOIN enq_n qn ON qn.item_id = q.item_id LEFT JOIN {points}_n pn ON pn.chunk_id = c.chunk_id
  LEFT JOIN (SELECT a.item_id, b.chunk_id, sum(a.n * b.n) AS dot FROM enq_t a JOIN {points}_t b ON a.b = b.b GROUP BY ALL) x ON x.item_id = q.item_id AND x.chunk_id = c.chunk_id
  GROUP BY q.item_id, c.chunk_id, c.seq) QUALIFY rank <= {k})"""


def _hybrid_sql(filtered: bool) -> str:
    return f"""WITH {_BASE}, {_encode_sql('enq', 'eval_items', 'item_id', 'question')}, {_encode_sql('ens', 'ch', 'chunk_id', 'text')}, {_encode_sql('enf', 'ch', 'chunk_id', 'embed_text')},
{_dense_sql('ds', 'ens', 20, filtered)}, {_dense_sql('df', 'enf', 20, filtered)}, {_bm25_sql(filtered, 20, 'bm')},
lists AS (SELECT qid, 0 AS l, 'dense' AS m, chunk_id, score, rank FROM ds UNION ALL SELECT qid, 1, 'dense', chunk_id, score, rank FROM df UNION ALL SELECT qid, 2, 'bm25', chunk_id, score, rank FROM bm),
fused AS (SELECT qid, chunk_id, coalesce(max(CASE WHEN m = 'dense' THEN score END), 0) AS score, list_reduce(list_prepend(CAST(0 AS DOUBLE), list(CAST(1.0 AS DOUBLE) / ({RRF_K} + rank) ORDER BY l)), lambda a, b: a + b) AS f, min(struct_pack(l := l, r := rank)) AS first FROM lists GROUP BY ALL)
SELECT qid, chunk_id, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY f DESC, first) AS rank FROM fused QUALIFY rank <= {TOP}"""


_RERANK = f"""WITH {_BASE}, {_bm25_sql(False, 20, 'bm')},
qs AS (SELECT qid, list(DISTINCT term) AS t FROM qt GROUP BY qid), cs AS (SELECT chunk_id, list(DISTINCT term) AS t FROM post GROUP BY chunk_id),
pairs AS (SELECT qid, chunk_id, rank, len(list_intersect(qs.t, cs.t)) / len(list_distinct(list_concat(qs.t, cs.t))) AS score FROM bm JOIN qs USING (qid) JOIN cs USING (chunk_id)),
re AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, rank) AS nr FROM pairs)"""

#: Unrounded scores, as what shows them rounds them itself.
_RES = "res AS (" + _hybrid_sql(False).replace("round(score, 6) AS score", "score") + ")"
_EVAL = f"""WITH {_BASE}, {_RES},
main AS (SELECT item_id AS qid, CAST(NULL AS BIGINT) AS hop, lecture_id, unnest(answer_ranges) AS r FROM eval_items),
more AS (SELECT item_id AS qid, CAST(NULL AS BIGINT) AS hop, x.lecture_id, unnest(x.ranges) AS r FROM (SELECT item_id, unnest(extra_locations) AS x FROM eval_items)
  UNION ALL SELECT item_id, hop, x.lecture_id, unnest(x.ranges) FROM (SELECT item_id, generate_subscripts(hops, 1) AS hop, unnest(hops) AS x FROM eval_items)),
loc AS (SELECT qid, hop, lecture_id, r.s AS rs, r.e AS re FROM main UNION ALL SELECT qid, hop, lecture_id, r.s, r.e FROM more),
hits AS (SELECT res.qid, res.rank, loc.hop, coalesce(ch.s < re AND ch.e > rs, FALSE) AS hit, coalesce(re > rs AND greatest(0, least(ch.e, re) - greatest(ch.s, rs)) / (re - rs) >= 0.5, FALSE) AS covered
  FROM res JOIN ch USING (chunk_id) JOIN loc ON loc.qid = res.qid AND loc.lecture_id = ch.lecture_id),
per AS (SELECT i.item_id AS qid, i.answerable, answer_completeness, item_type, CASE WHEN i.answerable THEN min(CASE WHEN hit THEN hits.rank END) END AS hit_rank,
  CASE WHEN i.answerable THEN min(CASE WHEN covered THEN hits.rank END) END AS strict_rank, max(t.score) AS top_score
  FROM eval_items i LEFT JOIN hits ON hits.qid = i.item_id LEFT JOIN (SELECT * FROM res WHERE rank = 1) t ON t.qid = i.item_id GROUP BY i.item_id, i.answerable, answer_completeness, item_type)"""


def _metrics_sql(column: str) -> str:
    return f"""{_EVAL}, g AS (SELECT {column} AS r, unnest(list_filter(['all', CASE WHEN answer_completeness = 'partial' THEN 'partial' ELSE 'full' END, 'type:' || item_type], lambda x: x IS NOT NULL)) AS grp FROM per WHERE answerable)
SELECT grp, count(*) AS count, {', '.join(f'CAST(count(*) FILTER (r <= {k}) AS BIGINT) AS hits_at_{k}' for k in (1, 3, 5))}, round(avg(coalesce(1.0 / r, 0)), 6) AS mrr FROM g GROUP BY grp"""


def _knn_sql(same: str, k: int = 5) -> str:
    return f"""SELECT qid, id, round(score, 6) AS score, rank FROM (SELECT a.vec_id AS qid, b.vec_id AS id, s AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY s DESC, b.vec_id) AS rank
  FROM (SELECT a.vec_id, b.vec_id AS other, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), {DIGITS}) AS s FROM embeddings a JOIN embeddings b ON {same} WHERE a.vec_id % 50 = 0) p
  JOIN embeddings a ON a.vec_id = p.vec_id JOIN embeddings b ON b.vec_id = p.other) WHERE rank <= {k}"""


_TIME = lambda c: f"CASE WHEN {c} >= 3600 THEN printf('%d:%02d:%02d', CAST(trunc({c}) AS BIGINT) // 3600, CAST(trunc({c}) AS BIGINT) // 60 % 60, CAST(trunc({c}) AS BIGINT) % 60) ELSE printf('%d:%02d', CAST(trunc({c}) AS BIGINT) // 60, CAST(trunc({c}) AS BIGINT) % 60) END"

QUERIES = {
    f.__name__: f
    for f in (
        bm25_stats, bm25_top, bm25_top_filtered, knn_topk, knn_topk_filtered, rrf_two, encode_chunks, hybrid_search, hybrid_search_filtered, rerank_replace, rerank_blend, eval_ranks, eval_metrics,
        eval_metrics_strict, eval_hops, eval_score_range, eval_mean_length, describe_sources, point_ids, cache_keys, previews, fmt_time, source_lines, result_lines, citations, split_sentences, uncited, prompt_build, ask_answers,
    )
}
SQL = {
    "bm25_stats": f"WITH {_BASE}, {_bm25_sql(False, 1, 'bm')} SELECT term, df, round(idf, 6) AS idf, round(avgdl, 6) AS avgdl FROM bm_i",
    "bm25_top": f"WITH {_BASE}, {_bm25_sql(False, TOP, 'bm')} SELECT qid, chunk_id, round(score, 6) AS score, rank FROM bm",
    "bm25_top_filtered": f"WITH {_BASE}, {_bm25_sql(True, TOP, 'bm')} SELECT qid, chunk_id, round(score, 6) AS score, rank FROM bm",
    "knn_topk": _knn_sql("TRUE"),
    "knn_topk_filtered": _knn_sql("a.label = b.label"),
    "encode_chunks": f"""WITH {_BASE}, {_encode_sql('enf', 'ch', 'chunk_id', 'embed_text')}, m AS (SELECT chunk_id, map_from_entries(list((b, n))) AS m FROM enf_t GROUP BY chunk_id)
SELECT ch.chunk_id, array_to_string(list_transform(range(64), lambda i: printf('%.4f', round(coalesce(m.m[i] / norm, 0), 4))), ' ') AS vector FROM ch LEFT JOIN m USING (chunk_id) LEFT JOIN enf_n USING (chunk_id)""",
    "hybrid_search": _hybrid_sql(False),
    "hybrid_search_filtered": _hybrid_sql(True),
    "rerank_replace": f"{_RERANK} SELECT qid, chunk_id, round(score, 6) AS score, nr AS rank FROM re WHERE nr <= 5",
    "rerank_blend": f"""{_RERANK}, bl AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY CAST(1.0 AS DOUBLE) / ({RRF_K} + rank) + CAST(1.0 AS DOUBLE) / ({RRF_K} + nr) DESC, rank) AS br FROM re)
SELECT qid, chunk_id, round(score, 6) AS score, br AS rank FROM bl WHERE br <= 5""",
    "eval_ranks": f"{_EVAL} SELECT qid, CAST(hit_rank AS INTEGER) AS hit_rank, CAST(strict_rank AS INTEGER) AS strict_rank, round(top_score, 6) AS top_score FROM per",
    "eval_metrics": _metrics_sql("hit_rank"),
    "eval_metrics_strict": _metrics_sql("strict_rank"),
    "eval_hops": f"""{_EVAL}, several AS (SELECT item_id AS qid, len(hops) AS total FROM eval_items WHERE len(hops) > 0), first AS (SELECT qid, hop, min(rank) AS r FROM hits WHERE hop IS NOT NULL AND hit GROUP BY ALL),
counted AS (SELECT k, qid, total, count(*) FILTER (r <= k) AS found FROM several LEFT JOIN first USING (qid) CROSS JOIN (SELECT unnest([1, 3, 5]) AS k) GROUP BY ALL)
SELECT k, count(*) AS n_questions, round(avg(CASE WHEN found = total THEN 1.0 ELSE 0.0 END), 6) AS all_hops, round(sum(found) / sum(total), 6) AS hop_recall FROM counted GROUP BY k""",
    "eval_score_range": f"{_EVAL} SELECT answerable, round(min(top_score), 6) AS least, round(max(top_score), 6) AS most FROM per GROUP BY answerable",
    "eval_mean_length": f"{_EVAL} SELECT count(*) AS n, round(avg(ch.e - ch.s), 6) AS seconds FROM res JOIN ch USING (chunk_id) WHERE rank = 1",
    "point_ids": """WITH h AS (SELECT DISTINCT chunk_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(chunk_id)) AS h FROM chunks)
SELECT chunk_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || printf('%02x', (CAST('0x' || substr(h, 17, 2) AS INTEGER) & 63) | 128) || substr(h, 19, 2) || '-' || substr(h, 21, 12) AS point_id FROM h""",
    "cache_keys": "SELECT doc_id, sha256('hash-64' || chr(10) || '3072' || chr(10) || text) AS key FROM documents",
    "previews": "SELECT doc_id, CASE WHEN length(t) > 220 THEN regexp_replace(t[1:220], ' [^ ]*$', '') || ' ...' ELSE t END AS preview FROM (SELECT doc_id, replace(text, chr(10), ' ') AS t FROM documents)",
    "fmt_time": f"SELECT DISTINCT segment_id, {_TIME('start_timestamp')} AS shown FROM transcript_segments WHERE start_timestamp IS NOT NULL",
}

_TITLES = """titles AS (SELECT chunk_id, coalesce(string_agg(t, ' | ' ORDER BY i), '') AS titles FROM (SELECT chunk_id, t, min(i) AS i FROM (
  SELECT chunk_id, unnest(ts) AS t, generate_subscripts(ts, 1) AS i FROM (SELECT chunk_id, any_value(slide_titles) AS ts FROM chunks GROUP BY 1)) WHERE trim(t) <> '' GROUP BY ALL) GROUP BY 1)"""
_SHOWN = lambda c: f"CASE WHEN {c} IS NULL THEN '-:--' ELSE {_TIME(c)} END"
_SPAN = f"{_SHOWN('s')} || ' - ' || {_SHOWN('e')}"
_EXTRA = "cx AS (SELECT chunk_id, any_value(slide_titles) AS ts, any_value(clean_text) AS c1, any_value(cleaned_text) AS c2, any_value(slide_description) AS sd, any_value(image_paths) AS im FROM chunks GROUP BY 1)"
_CIT = rf"\[[0-9]+(?:{WS_RE2}*,{WS_RE2}*[0-9]+)*\]"


def _sentences_sql(t: str) -> str:
    pieces = f"flatten(list_transform(list_filter(list_transform(string_split({t}, chr(10)), lambda x: {_strip('x')}), lambda x: x <> ''), lambda x: string_split(regexp_replace(x, '([.!?]){WS_RE2}+([A-Z0-9\"''(\\[`])', '\\1' || chr(10) || '\\2', 'g'), chr(10))))"
    lead = f"regexp_extract(p, '^(?:{_CIT}{WS_RE2}*)+')"
    ends = " OR ".join(f"ends_with(lower(pcs[i - 1]), '{a}')" for a in ABBREVIATIONS)
    written = f"""list_transform(pcs, lambda p, i: CASE WHEN i = 1 THEN p WHEN {lead} <> '' THEN ' ' || {_strip(lead)} || CASE WHEN p[length({lead}) + 1:] = '' THEN '' ELSE chr(10) || p[length({lead}) + 1:] END
      WHEN {ends} THEN ' ' || p ELSE chr(10) || p END)"""
    return f"(SELECT CASE WHEN len(pcs) = 0 THEN [] ELSE string_split(array_to_string({written}, ''), chr(10)) END FROM (SELECT {pieces} AS pcs))"


_TURNS = r"""answers AS (SELECT item_id AS qid, CASE item_id % 4 WHEN 0 THEN reference_answer || ' It is said once more, cf. The last part of the lecture.' WHEN 1 THEN reference_answer || ' [7].'
    WHEN 2 THEN 'In short [02, 7]. ' || reference_answer || ' [3,1] Then it goes on. See [0] .' || chr(10) || '[2] Nothing more' ELSE reference_answer || ' [1]. The material says no more.' END AS t,
    CASE item_id % 4 WHEN 3 THEN 'none' WHEN 2 THEN 'partial' ELSE 'full' END AS coverage FROM eval_items WHERE reference_answer IS NOT NULL)"""
_OPEN = lambda t: f"list_filter({_sentences_sql(t)}, lambda s: NOT regexp_matches(s, '{_CIT}') AND len(list_filter(regexp_split_to_array(s, '{WS_RE2}+'), lambda x: x <> '')) >= {LEAST_CITED_WORDS} AND NOT regexp_matches(lower(s), '{'|'.join(ABOUT_MATERIAL)}'))"


def _checked_sql(source: str) -> str:
    """``qid, coverage, cleaned, cited, invalid, open`` of ``source(qid, t, n, coverage)``."""
    good = "list_filter(list_transform(regexp_extract_all(inside[i], '[0-9]+'), lambda x: CAST(x AS BIGINT)), lambda x: x BETWEEN 1 AND n)"
    first = lambda good: f"list_transform(list_sort(list_distinct(list_filter(nums, lambda x: {good}))), lambda x: struct_pack(at := list_position(nums, x), x := x))"
    return f"""
cut AS (SELECT *, regexp_split_to_array(t, '{_CIT}') AS between, regexp_extract_all(t, '{_CIT}') AS inside, flatten(list_transform(regexp_extract_all(t, '{_CIT}'), lambda m: list_transform(regexp_extract_all(m, '[0-9]+'), lambda x: CAST(x AS BIGINT)))) AS nums FROM {source}),
made AS (SELECT qid, coverage, n, {_strip(f"regexp_replace(regexp_replace(array_to_string(list_transform(between, lambda b, i: b || CASE WHEN i > len(inside) THEN '' ELSE CASE WHEN len({good}) > 0 THEN '[' || array_to_string({good}, ', ') || ']' ELSE '' END END), ''), ' {{2,}}', ' ', 'g'), '{WS_RE2}+([.,;:])', '\\1', 'g')")} AS cleaned,
  list_transform(list_sort({first('x BETWEEN 1 AND n')}), lambda y: y.x) AS cited, list_transform(list_sort({first('x NOT BETWEEN 1 AND n')}), lambda y: y.x) AS invalid FROM cut),
checked AS (SELECT *, {_OPEN('cleaned')} AS open FROM made)"""


_WARNINGS = "CAST((len(invalid) > 0)::INTEGER + (coverage <> 'none' AND len(cited) = 0)::INTEGER + (coverage <> 'none' AND len(cited) > 0 AND len(open) > 0)::INTEGER AS INTEGER)"
_URL = r"""CASE WHEN regexp_full_match(lecture_id, '[A-Za-z0-9_-]+') AND regexp_full_match(regexp_extract(im[1], '[^\\/]*$'), '[A-Za-z0-9_-]+(\.[A-Za-z0-9_-]+)*\.(jpg|jpeg|png)') THEN '/slides/' || lecture_id || '/' || regexp_extract(im[1], '[^\\/]*$') END"""
_SAID = _strip("coalesce(text, '')")
_PART = lambda name, c: f"CASE WHEN {_strip(c)} <> '' THEN chr(10) || '{name}' || {_strip(c)} ELSE '' END"
_EXCERPT = f"""'[' || rank || '] ' || lecture_id || ', ' || {_SPAN} || CASE WHEN len(coalesce(ts, [])) > 0 THEN chr(10) || '{an.TITLES}' || array_to_string(list_transform(ts, lambda x: coalesce(x, '')), ' | ') ELSE '' END
  || {_PART(an.SLIDE, f"CASE WHEN {_strip(chr(99) + 'oalesce(c1, chr(32))')} <> '' THEN c1 ELSE coalesce(c2, '') END")} || {_PART(an.PICTURE, "coalesce(sd, '')")} || chr(10) || '{an.SPEECH}' || {_SAID}"""

SQL |= {
    "source_lines": f"""WITH {_BASE}, {_TITLES} SELECT chunk_id, '[1] ' || lecture_id || ' | ' || {_SPAN} || CASE WHEN titles <> '' THEN ' | ' || titles ELSE '' END AS line
FROM ch LEFT JOIN titles USING (chunk_id)""",
    "result_lines": f"""WITH {_BASE}, {_RES}, {_TITLES} SELECT qid, rank, rank || '. score ' || printf('%.3f', score) || '  ' || lecture_id || '  ' || {_SPAN} || '  ' ||
CASE WHEN titles <> '' THEN titles ELSE '(no slide titles)' END AS line FROM res JOIN ch USING (chunk_id) LEFT JOIN titles USING (chunk_id)""",
    "describe_sources": f"""WITH {_BASE}, {_TITLES}, {_EXTRA} SELECT chunk_id, lecture_id, {_SHOWN('s')} AS start_label, {_SHOWN('e')} AS end_label, coalesce(titles, '') AS titles, {_URL} AS image_url,
  CASE WHEN length({_SAID}) > {an.EXCERPT_CHARACTERS} THEN regexp_replace({_SAID}[1:{an.EXCERPT_CHARACTERS}], ' [^ ]*$', '') || ' ...' ELSE {_SAID} END AS excerpt, round_even(length(coalesce(text, '')) / 1000.0, 3) AS score
FROM ch JOIN cx USING (chunk_id) LEFT JOIN titles USING (chunk_id)""",
    "prompt_build": f"""WITH {_BASE}, {_RES}, {_EXTRA}, x AS (SELECT qid, rank, {_EXCERPT} AS x FROM res JOIN ch USING (chunk_id) JOIN cx USING (chunk_id) WHERE rank <= 5)
SELECT qid, '{an.QUESTION}' || any_value({_strip('question')}) || '{an.EXCERPTS}' || string_agg(x, '{an.BETWEEN}' ORDER BY rank) AS prompt FROM x JOIN eval_items i ON i.item_id = qid GROUP BY qid""",
    "split_sentences": f"""SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, s AS sentence FROM (SELECT doc_id, unnest(ss) AS s, generate_subscripts(ss, 1) AS i FROM (SELECT doc_id, {_sentences_sql('text')} AS ss FROM documents WHERE text IS NOT NULL))""",
    "uncited": f"""WITH {_TURNS} SELECT qid, CAST(i - 1 AS INTEGER) AS pos, s AS sentence FROM (SELECT qid, unnest(ss) AS s, generate_subscripts(ss, 1) AS i FROM (SELECT qid, {_OPEN('t')} AS ss FROM answers))""",
    "citations": f"""WITH {_TURNS}, numbered AS (SELECT *, 3 AS n FROM answers), {_checked_sql('numbered')}
SELECT qid, coverage <> 'none' AS answerable, cleaned, array_to_string(cited, ',') AS cited, array_to_string(invalid, ',') AS invalid, {_WARNINGS} AS n_warnings FROM checked""",
    "rrf_two": f"""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS a, list_concat(CAST(embedding AS DOUBLE[])[33:64], CAST(embedding AS DOUBLE[])[1:32]) AS b FROM embeddings),
p AS (SELECT q.vec_id AS qid, v.vec_id AS id, round(list_cosine_similarity(q.a, v.a), {DIGITS}) AS x, round(list_cosine_similarity(q.a, v.b), {DIGITS}) AS y FROM v q JOIN v ON TRUE WHERE q.vec_id % 50 = 0),
l AS (SELECT qid, id, 0 AS l, x AS score, row_number() OVER (PARTITION BY qid ORDER BY x DESC, id) AS rank FROM p QUALIFY rank <= 20
  UNION ALL SELECT qid, id, 1, y, row_number() OVER (PARTITION BY qid ORDER BY y DESC, id) AS rank FROM p QUALIFY rank <= 20),
f AS (SELECT qid, id, max(score) AS score, list_reduce(list_prepend(CAST(0 AS DOUBLE), list(CAST(1.0 AS DOUBLE) / ({RRF_K} + rank) ORDER BY l)), lambda a, b: a + b) AS fused, min(struct_pack(l := l, r := rank)) AS first FROM l GROUP BY ALL)
SELECT qid, id, round(score, 6) AS score, round(fused, 9) AS fused, row_number() OVER (PARTITION BY qid ORDER BY fused DESC, first) AS rank FROM f QUALIFY rank <= {TOP}""",
    "ask_answers": f"""WITH {_BASE}, {_bm25_sql(False, 3, 'res')}, {_EXTRA}, x AS (SELECT qid, rank, {_EXCERPT} AS x, rank || ' ' || lecture_id || ' ' || {_SHOWN('s')} AS d FROM res JOIN ch USING (chunk_id) JOIN cx USING (chunk_id)),
pr AS (SELECT item_id AS qid, '{an.QUESTION}' || {_strip('any_value(question)')} AS q, count(rank) AS n, list(d ORDER BY rank) AS ds, length('{an.QUESTION}' || {_strip('any_value(question)')} || '{an.EXCERPTS}' || string_agg(x, '{an.BETWEEN}' ORDER BY rank)) AS size FROM eval_items LEFT JOIN x ON x.qid = item_id GROUP BY item_id),
replies AS (SELECT qid, ds, n, CASE WHEN n = 0 THEN '{an.NOTHING_FOUND}' ELSE q || ' [1]. See also the rest [2, 9].' END AS t, CASE WHEN n = 0 OR contains(q, ' not ') THEN 'none' WHEN size < 2000 THEN 'partial' ELSE 'full' END AS coverage FROM pr),
{_checked_sql('replies')}
SELECT qid, 'answer' AS mode, coverage, coverage <> 'none' AS answerable, CASE coverage WHEN 'none' THEN 'The lecture material does not cover this question.' WHEN 'partial' THEN 'The lecture material covers only part of this question.' ELSE '' END AS banner,
  cleaned AS text, array_to_string(cited, ',') AS cited, {_WARNINGS} AS n_warnings, array_to_string(list_transform(cited, lambda c: ds[c]), ' / ') AS sources, CASE WHEN coverage = 'none' AND n > 0 THEN array_to_string(ds[1:3], ' / ') ELSE '' END AS closest
FROM checked JOIN (SELECT qid, ds FROM replies) USING (qid)""",
}

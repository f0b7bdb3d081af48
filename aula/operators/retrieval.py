"""Search: exact dense k-NN, BM25, reciprocal-rank fusion, reranking, and the planner that composes them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aula.functions.text import search_tokens, unit_vector
from aula.session import cut_lineage

K1, B, EPSILON = 1.5, 0.75, 0.25
RRF_K = 60
CANDIDATES = 20
DIMENSIONS = 64
# The names of the signals and the texts they read.
KEYWORD_SIGNALS = {"bm25": "embed_text", "bm25_speech": "text"}
DENSE_SIGNALS = {"full": "embed_text", "speech": "text"}
#: Query vectors compared at once; more queries are worked off in blocks of this size.
QUERY_BLOCK = 4096
#: Scores are ranked as rounded to so many digits, so that sums taken in another order rank alike.
DIGITS = 9


def plan_signals(signals: list[str]) -> tuple[list[str], list[str]]:
    """Dense and keyword signals, in order. An unknown or missing signal is an error."""
    unknown = [s for s in signals if s not in KEYWORD_SIGNALS and s not in DENSE_SIGNALS]
    if unknown or not signals:
        raise ValueError(f"signals must be some of {[*DENSE_SIGNALS, *KEYWORD_SIGNALS]}, not {signals}")
    return [s for s in signals if s in DENSE_SIGNALS], [s for s in signals if s in KEYWORD_SIGNALS]


def describe(signals: list[str]) -> str:
    dense, keyword = plan_signals(signals)
    if dense and keyword:
        return "dense + keyword fusion"
    kind = "dense" if dense else "keyword"
    return kind if len(signals) == 1 else f"{kind} fusion"


def hash_encode(texts: DataFrame, key: list[str], text: str, dimensions: int = DIMENSIONS) -> DataFrame:
    """``key, vector``: counts of a text's search tokens by a hash of the token, at unit length.

    A deterministic stand-in for a text encoder. Texts without tokens have a zero vector.
    """
    bucket = F.conv(F.substring(F.md5("token"), 1, 4), 16, 10).cast("int") % dimensions
    tokens = texts.select(*key, F.explode(search_tokens(F.col(text))).alias("token")).groupBy(*key, bucket.alias("b")).agg(F.count("*").cast("double").alias("n"))
    counts = tokens.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("b", "n"))).alias("m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0.0)))
    return texts.select(*key).join(counts, key, "left").select(*key, unit_vector(F.when(F.col("m").isNull(), F.array_repeat(F.lit(0.0), dimensions)).otherwise(dense)).alias("vector"))


def dense_topk(points: DataFrame, queries: DataFrame, k: int, *, block: int = QUERY_BLOCK) -> DataFrame:
    """``qid, id, score, rank``: the k points of the largest cosine for each query.

    ``points(id, lecture_id, seq, vector)``, ``queries(qid, lecture_id, vector)``; a query with a lecture searches only
    that one. Ties go to the smaller ``seq``. Each task keeps its own best k per query, so at most k rows per query and
    task are shuffled; queries are stated, and held in blocks of a fixed size.
    """
    n = queries.count()
    out = None
    for i in range(max(1, -(-n // block))):
        part = queries if n <= block else queries.filter(F.pmod(F.xxhash64("qid"), F.lit(-(-n // block))) == i)
        rows = part.select("qid", "lecture_id", "vector").collect()
        made = _dense_block(points, [r.qid for r in rows], [r.lecture_id for r in rows], [list(map(float, r.vector)) for r in rows], k)
        out = made if out is None else out.unionByName(made)
    order = Window.partitionBy("qid").orderBy(F.col("score").desc(), "seq")
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("qid", "id", "score", "rank")


def _dense_block(points: DataFrame, ids: list, lectures: list, vectors: list, k: int) -> DataFrame:
    schema = points.schema
    out = f"qid bigint, id {schema['id'].dataType.simpleString()}, seq {schema['seq'].dataType.simpleString()}, score double"
    matrix = np.asarray(vectors, float).reshape(len(ids), -1) if ids else np.zeros((0, 1))
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    matrix = np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)
    qids = np.asarray(ids, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows or not len(qids):
                continue
            vec = b.column(3)
            m = vec.values.to_numpy(zero_copy_only=False).astype(float)[vec.offsets[0].as_py() : vec.offsets[-1].as_py()].reshape(b.num_rows, -1)
            size = np.linalg.norm(m, axis=1, keepdims=True)
            score = np.round(np.divide(m, size, out=np.zeros_like(m), where=size > 0) @ matrix.T, DIGITS)
            names = b.column(1)
            order = np.argsort(np.argsort(np.array(b.column(2).to_pylist(), dtype=object), kind="stable"), kind="stable")
            everything, members = np.arange(b.num_rows), {}
            for x in {x for x in lectures if x is not None}:
                members[x] = np.flatnonzero(pc.equal(names, x).to_numpy(zero_copy_only=False).astype(bool))
            picked, whose = [], []
            for q in range(len(qids)):
                rows = everything if lectures[q] is None else members[lectures[q]]
                own = score[rows, q]
                if len(rows) > k:  # all rows as good as the k-th, ties included
                    near = own >= np.partition(own, len(own) - k)[len(own) - k]
                    rows, own = rows[near], own[near]
                best = rows[np.lexsort((order[rows], -own))[:k]]
                picked.append(best)
                whose.append(np.full(len(best), q))
            at, q = np.concatenate(picked), np.concatenate(whose)
            take = pa.array(at)
            yield pa.RecordBatch.from_arrays([pa.array(qids[q]), b.column(0).take(take), b.column(2).take(take), pa.array(score[at, q])], ["qid", "id", "seq", "score"])

    return points.filter("vector IS NOT NULL").select("id", "lecture_id", "seq", F.col("vector").cast("array<double>").alias("vector")).mapInArrow(run, out)


def corpus_terms(docs: DataFrame, text: str) -> DataFrame:
    """``id, lecture_id, seq, term, tf, dl``: postings with document lengths. Documents without tokens have one row with
    a NULL term, as they count for the average length."""
    tokens = docs.select("id", "lecture_id", "seq", search_tokens(F.coalesce(F.col(text), F.lit(""))).alias("t")).withColumn("dl", F.size("t"))
    return tokens.select("id", "lecture_id", "seq", "dl", F.explode_outer("t").alias("term")).groupBy("id", "lecture_id", "seq", "dl", "term").agg(F.count("term").alias("tf"))


def corpus_stats(terms: DataFrame, by: list[str]) -> DataFrame:
    """``by, term, idf, avgdl``: inverse document frequencies over the whole corpus or over each lecture's own."""
    docs = terms.select(*by, "id", "dl").distinct().groupBy(*by).agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))
    df = terms.filter("term IS NOT NULL").groupBy(*by, "term").agg(F.count("*").alias("df"))
    joined = df.join(docs, by) if by else df.join(F.broadcast(docs))  # one row
    raw = joined.withColumn("raw", F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.groupBy(*by).agg(F.avg("raw").alias("mean"))
    both = raw.join(mean, by) if by else raw.join(F.broadcast(mean))  # one row
    return both.select(*by, "term", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"), "avgdl")


def bm25_topk(terms: DataFrame, questions: DataFrame, k: int, *, filtered: bool = False) -> DataFrame:
    """``qid, id, score, rank`` of ``questions(qid, lecture_id, question)`` over ``corpus_terms``.

    Only scores above 0 (before rounding); repeated query words count again. Scores are ranked as rounded to ``DIGITS``,
    as sums taken in another order differ beyond; ties go to the smaller ``seq``. ``filtered``: each question searches,
    and takes its statistics from, its own lecture; one without a lecture searches all.
    """
    if filtered:
        everywhere = bm25_topk(terms, questions.filter("lecture_id IS NULL"), k)
        return _bm25(terms, questions.filter("lecture_id IS NOT NULL"), k, ["lecture_id"]).unionByName(everywhere)
    return _bm25(terms, questions, k, [])


def _bm25(terms: DataFrame, questions: DataFrame, k: int, by: list[str]) -> DataFrame:
    words = questions.select("qid", *by, F.explode(search_tokens(F.col("question"))).alias("term")).groupBy("qid", *by, "term").agg(F.count("*").alias("qn"))
    weighted = words.join(corpus_stats(terms, by), [*by, "term"])
    hits = weighted.join(terms.select("id", "lecture_id", "seq", "dl", "term", "tf") if by else terms.select("id", "seq", "dl", "term", "tf"), [*by, "term"])
    part = F.col("qn") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = hits.groupBy("qid", "id", "seq").agg(F.sum(part).alias("score")).filter("score > 0").withColumn("score", F.round("score", DIGITS))
    order = Window.partitionBy("qid").orderBy(F.col("score").desc(), "seq")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("qid", "id", "score", "rank")


def fuse(ranked: DataFrame, k: int) -> DataFrame:
    """``qid, id, score, fused, rank`` of ``ranked(qid, list_no, method, id, score, rank)``.

    Contributions are added in list order, so that equal sums are equal. The score shown is the best dense one, 0 for
    records that only keyword lists found. Ties go to the record seen first.
    """
    seen = ranked.groupBy("qid", "id").agg(
        F.array_sort(F.collect_list(F.struct("list_no", "rank"))).alias("r"), F.coalesce(F.max(F.when(F.col("method") == "dense", F.col("score"))), F.lit(0.0)).alias("score")
    )
    fused = seen.withColumn("fused", F.aggregate("r", F.lit(0.0), lambda s, x: s + 1.0 / (F.lit(float(RRF_K)) + x.rank))).withColumn("first", F.col("r")[0])
    order = Window.partitionBy("qid").orderBy(F.col("fused").desc(), "first")
    return fused.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("qid", "id", "score", "fused", "rank")


def jaccard(a: Column, b: Column) -> Column:
    """A deterministic stand-in for a pair scorer: shared tokens of all tokens."""
    x, y = F.array_distinct(search_tokens(a)), F.array_distinct(search_tokens(b))
    return F.when(F.size(F.array_union(x, y)) > 0, F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))).otherwise(0.0)


def rerank(results: DataFrame, k: int, mode: str = "replace") -> DataFrame:
    """``results(qid, id, rank, pair_score)`` in the scorer's order, or blended with the first order by rank fusion."""
    if mode not in ("replace", "blend"):
        raise ValueError("mode must be replace or blend")
    new = F.row_number().over(Window.partitionBy("qid").orderBy(F.col("pair_score").desc(), "rank"))
    both = results.withColumn("new_rank", new).withColumnRenamed("rank", "old_rank")
    if mode == "blend":
        blended = 1.0 / (F.lit(float(RRF_K)) + F.col("old_rank")) + 1.0 / (F.lit(float(RRF_K)) + F.col("new_rank"))
        both = both.withColumn("_b", blended)
        both = both.withColumn("new_rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.col("_b").desc(), "old_rank"))).drop("_b")
    return both.filter(F.col("new_rank") <= k).select("qid", "id", F.col("pair_score").alias("score"), F.col("new_rank").alias("rank"))


def retrieve(chunks: DataFrame, questions: DataFrame, *, k: int = 5, signals: tuple[str, ...] = ("speech", "full", "bm25"), filtered: bool = False, rerank_mode: str | None = None) -> DataFrame:
    """``qid, id, score, rank`` for ``questions(qid, lecture_id, question)`` over ``chunks(id, lecture_id, seq, text, embed_text)``.

    One signal is searched plainly, several are fused; questions are encoded only for dense signals. ``filtered``
    restricts each question to its lecture; one without a lecture searches all. All questions go through one plan.
    """
    dense, keyword = plan_signals(list(signals))
    first = max(k, CANDIDATES) if rerank_mode else k
    many = max(first, CANDIDATES) if len(signals) > 1 else first
    vectors = None
    if dense:
        asked = questions if filtered else questions.withColumn("lecture_id", F.lit(None).cast("string"))
        vectors = hash_encode(asked, ["qid"], "question").join(asked.select("qid", "lecture_id"), "qid")
    lists = []
    for no, s in enumerate(signals):
        if s in dense:
            encoded = hash_encode(chunks.select("id", DENSE_SIGNALS[s]), ["id"], DENSE_SIGNALS[s])
            points = chunks.select("id", "lecture_id", "seq").join(encoded, "id")
            found, method = dense_topk(points, vectors, many), "dense"
        else:
            found, method = bm25_topk(cut_lineage(corpus_terms(chunks, KEYWORD_SIGNALS[s]), "index"), questions, many, filtered=filtered), "bm25"
        lists.append(found.select("qid", F.lit(no).alias("list_no"), F.lit(method).alias("method"), "id", "score", "rank"))
    ranked = lists[0]
    for x in lists[1:]:
        ranked = ranked.unionByName(x)
    ranked = cut_lineage(ranked, "ranked")
    result = ranked.select("qid", "id", "score", "rank") if len(signals) == 1 else fuse(ranked, first).select("qid", "id", "score", "rank")
    if not rerank_mode:
        return result
    paired = result.join(questions.select("qid", "question"), "qid").join(chunks.select("id", "embed_text"), "id")
    return rerank(paired.select("qid", "id", "rank", jaccard(F.col("question"), F.col("embed_text")).alias("pair_score")), k, rerank_mode)

"""Retrieval quality: hit ranks, strict coverage, hops, grouped metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aula.functions.text import overlap_seconds, ranges_overlap

K_VALUES = (1, 3, 5)
COVERED = 0.5


def locations(items: DataFrame) -> DataFrame:
    """``qid, place, hop, lecture_id, s, e``: one row per range of every place of an item; ``hop`` is NULL but for hops."""
    main = items.select("qid", F.lit("main").alias("place"), F.lit(None).cast("int").alias("hop"), "lecture_id", F.explode("answer_ranges").alias("r"))
    others = [
        items.select("qid", F.posexplode(c).alias("hop", "x")).select("qid", F.lit(c).alias("place"), F.when(F.lit(c == "hops"), F.col("hop")).alias("hop"), F.col("x.lecture_id").alias("lecture_id"), F.explode("x.ranges").alias("r"))
        for c in ("extra_locations", "hops")
    ]
    return main.unionByName(others[0]).unionByName(others[1]).select("qid", "place", "hop", "lecture_id", F.col("r.s").alias("s"), F.col("r.e").alias("e"))


def hit_rows(results: DataFrame, chunks: DataFrame, items: DataFrame) -> DataFrame:
    """``qid, rank, hop, hit, covered`` for each result and place range of its question in the same lecture."""
    shown = results.join(chunks.select("id", "lecture_id", F.col("start_timestamp").alias("cs"), F.col("end_timestamp").alias("ce")), "id")
    both = shown.join(locations(items), ["qid", "lecture_id"])
    shared = overlap_seconds(F.col("cs"), F.col("ce"), F.col("s"), F.col("e"))
    strict = (F.col("e") > F.col("s")) & (shared / (F.col("e") - F.col("s")) >= COVERED)
    return both.select("qid", "rank", "hop", F.coalesce(ranges_overlap(F.col("cs"), F.col("ce"), F.col("s"), F.col("e")), F.lit(False)).alias("hit"), F.coalesce(strict, F.lit(False)).alias("covered"))


def ranks(results: DataFrame, chunks: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """One row per item: first hit, first strict hit, score of the first result. Unanswerable items have no ranks."""
    hits = hit_rows(results.filter(F.col("rank") <= k), chunks, items).groupBy("qid").agg(F.min(F.when(F.col("hit"), F.col("rank"))).alias("hit_rank"), F.min(F.when(F.col("covered"), F.col("rank"))).alias("strict_rank"))
    top = results.filter("rank = 1").select("qid", F.col("score").alias("top_score"))
    joined = items.select("qid", "answerable", "answer_completeness", "item_type").join(hits, "qid", "left").join(top, "qid", "left")
    yes = F.coalesce("answerable", F.lit(False))
    return joined.withColumn("hit_rank", F.when(yes, F.col("hit_rank"))).withColumn("strict_rank", F.when(yes, F.col("strict_rank")))


def metrics(ranked: DataFrame, column: str = "hit_rank") -> DataFrame:
    """``grp, count, hits_at_k, mrr`` over answerable items: all, by completeness and by type, in one pass."""
    rows = ranked.filter(F.coalesce("answerable", F.lit(False))).select(
        F.col(column).alias("r"),
        F.explode(
            F.array_compact(
                F.array(
                    F.lit("all"), F.when(F.coalesce(F.col("answer_completeness") == "partial", F.lit(False)), "partial").otherwise("full"), F.when(F.col("item_type").isNotNull(), F.concat(F.lit("type:"), F.col("item_type")))
                )
            )
        ).alias("grp"),
    )
    return rows.groupBy("grp").agg(
        F.count("*").alias("count"), *[F.count_if(F.coalesce(F.col("r") <= k, F.lit(False))).alias(f"hits_at_{k}") for k in K_VALUES], F.round(F.avg(F.coalesce(1.0 / F.col("r"), F.lit(0.0))), 6).alias("mrr")
    )


def hop_metrics(results: DataFrame, chunks: DataFrame, items: DataFrame) -> DataFrame:
    """``k, n_questions, all_hops, hop_recall`` over items that need several places."""
    several = items.filter(F.coalesce(F.size("hops") > 0, F.lit(False))).select("qid", F.size("hops").alias("total"))
    first = hit_rows(results, chunks, items).filter("hop IS NOT NULL AND hit").groupBy("qid", "hop").agg(F.min("rank").alias("r"))
    counted = several.join(first, "qid", "left").withColumn("k", F.explode(F.array(*[F.lit(k) for k in K_VALUES])))
    per = counted.groupBy("k", "qid", "total").agg(F.count_if(F.coalesce(F.col("r") <= F.col("k"), F.lit(False))).alias("found"))
    return per.groupBy("k").agg(
        F.count("*").alias("n_questions"), F.round(F.avg(F.when(F.col("found") == F.col("total"), 1.0).otherwise(0.0)), 6).alias("all_hops"), F.round(F.sum("found") / F.sum("total"), 6).alias("hop_recall")
    )


def score_range(ranked: DataFrame) -> DataFrame:
    return ranked.groupBy("answerable").agg(F.round(F.min("top_score"), 6).alias("least"), F.round(F.max("top_score"), 6).alias("most"))


def mean_length(results: DataFrame, chunks: DataFrame) -> DataFrame:
    """Mean seconds of the best result."""
    best = results.filter("rank = 1").join(chunks.select("id", "start_timestamp", "end_timestamp"), "id")
    return best.agg(F.count("*").alias("n"), F.round(F.avg(F.col("end_timestamp") - F.col("start_timestamp")), 6).alias("seconds"))


def upper_median(values: Column) -> Column:
    """The middle of the sorted values, the upper one of two."""
    ordered = F.array_sort(F.collect_list(values))
    return F.element_at(ordered, F.floor(F.size(ordered) / 2).cast("int") + 1)

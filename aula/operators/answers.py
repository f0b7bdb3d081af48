"""Prompts, sources and checks of cited answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aula.functions.text import clean_citations, count_words, coverage_banner, invalid_citations, join_parts, round_half_even, shown_time, slide_url, strip, truncate_at_word, uncited_sentences, unique_in_order, valid_citations
from aula.operators.retrieval import retrieve
from aula.session import cut_lineage
from aula.sources.providers import Provider, apply

# The form of a prompt.
QUESTION, EXCERPTS, BETWEEN = "Question: ", "\n\nExcerpts:\n\n", "\n\n-----\n\n"
TITLES, SLIDE, PICTURE, SPEECH = "Slide titles: ", "Slide text:\n", "Diagram or code on the slides:\n", "Speech:\n"
# Characters of a source's excerpt, characters and number of sentences quoted in a warning.
EXCERPT_CHARACTERS, QUOTED_CHARACTERS, QUOTED_SENTENCES = 900, 70, 2
NOTHING_FOUND = "Nothing in the lecture material matches this question."
SOURCE = "struct<number:int,lecture_id:string,start_label:string,end_label:string,titles:array<string>,image_url:string,excerpt:string,score:double>"


def _blank(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def _titles() -> Column:
    return F.coalesce("slide_titles", F.array().cast("array<string>"))


def excerpt(number: Column) -> Column:
    """Header, titles and the whole slide text, description and speech of a chunk. The slide text is that of the vision
    model, or else the cleaned one; parts other than the speech are left out where they are blank."""
    head = F.concat(F.lit("["), number.cast("string"), F.lit("] "), F.col("lecture_id"), F.lit(", "), shown_time(F.col("start_timestamp")), F.lit(" - "), shown_time(F.col("end_timestamp")))
    slide = F.when(strip(_blank("clean_text")) != "", _blank("clean_text")).otherwise(_blank("cleaned_text"))
    part = lambda name, c: F.when(strip(c) != "", F.concat(F.lit(name), strip(c)))
    titles = F.when(F.size(_titles()) > 0, F.concat(F.lit(TITLES), F.array_join(_titles(), " | ", "")))
    return join_parts("\n", head, titles, part(SLIDE, slide), part(PICTURE, _blank("slide_description")), F.concat(F.lit(SPEECH), strip(_blank("text"))))


def describe(number: Column, score: Column) -> Column:
    """A chunk as a reader sees it: number, place, titles, first picture, the beginning of its speech, score."""
    fields = (number.cast("int"), F.col("lecture_id"), shown_time(F.col("start_timestamp")), shown_time(F.col("end_timestamp")), unique_in_order(_titles()),
              slide_url(F.col("lecture_id"), F.get("image_paths", F.lit(0))), truncate_at_word(strip(_blank("text")), EXCERPT_CHARACTERS), round_half_even(score, 3))
    names = ("number", "lecture_id", "start_label", "end_label", "titles", "image_url", "excerpt", "score")
    return F.struct(*[f.alias(n) for f, n in zip(fields, names)]).cast(SOURCE)


def prompts(results: DataFrame, chunks: DataFrame, questions: DataFrame) -> DataFrame:
    """``qid, prompt``: the question and its excerpts in rank order."""
    joined = results.join(chunks, "id").withColumn("x", excerpt(F.col("rank")))
    listed = joined.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "x"))).alias("l"))
    return questions.join(listed, "qid").select("qid", F.concat(F.lit(QUESTION), strip(F.col("question")), F.lit(EXCERPTS), F.array_join(F.transform("l", lambda v: v.x), BETWEEN)).alias("prompt"))


def check_answers(answers: DataFrame) -> DataFrame:
    """``answers(qid, answer, n_sources, coverage)`` with cleaned text, cited sources and warnings.

    Any coverage but ``none`` is an answer; a NULL coverage (no reply) is none. Of an answer that cites nothing that is
    all there is to say; sentences without a source are told only where others have one.
    """
    text, n = F.col("answer"), F.col("n_sources")
    checked = answers.withColumn("cleaned", clean_citations(text, n)).withColumn("cited", valid_citations(text, n)).withColumn("invalid", invalid_citations(text, n))
    answered, open_ = F.coalesce(F.col("coverage") != "none", F.lit(False)), uncited_sentences(F.col("cleaned"))
    quoted = F.array_join(F.transform(F.slice(open_, 1, QUOTED_SENTENCES), lambda s: truncate_at_word(s, QUOTED_CHARACTERS)), " / ")
    warnings = F.array_compact(
        F.array(
            F.when(F.size("invalid") > 0, F.concat(F.lit("cites sources that do not exist: "), F.array_join("invalid", ", "))),
            F.when(answered & (F.size("cited") == 0), F.lit("cites no source")),
            F.when(answered & (F.size("cited") > 0) & (F.size(open_) > 0), F.concat(F.size(open_).cast("string"), F.lit(" sentences without a source: "), quoted)),
        )
    )
    return checked.select("qid", "coverage", answered.alias("answerable"), "cleaned", "cited", "invalid", warnings.alias("warnings"), (count_words(F.col("cleaned")) > 0).alias("has_text"))


def ask(chunks: DataFrame, questions: DataFrame, provider: Provider | None, *, k: int = 5, closest: int = 3, **search) -> DataFrame:
    """``qid, mode, coverage, answerable, banner, text, cited, warnings, sources, closest, failed`` for
    ``questions(qid, lecture_id, question)``.

    Without a provider the mode is ``search``: ``closest`` describes all results, and nothing is answered. Otherwise the
    provider turns prompts into replies ``{"coverage": full | partial | none, "answer": text}``; questions that find nothing get a
    fixed text and never reach it. ``sources`` describes the results that are cited, by their number, in order of
    citation; ``closest`` the best ones where nothing is answered. A prompt whose reply fails has ``failed`` and no text.
    """
    results = cut_lineage(retrieve(chunks, questions, k=k, **search), "results")
    texts = chunks if "image_paths" in chunks.columns else chunks.withColumn("image_paths", F.array().cast("array<string>"))
    listed = results.join(texts, "id").withColumn("d", describe(F.col("rank"), F.col("score"))).groupBy("qid").agg(F.count("*").cast("int").alias("n_sources"), F.array_sort(F.collect_list(F.struct("rank", "d"))).alias("r"))
    asked = questions.select("qid").join(listed.select("qid", "n_sources", F.transform("r", lambda x: x.d).alias("r")), "qid", "left")
    described = asked.withColumn("n_sources", F.coalesce("n_sources", F.lit(0))).withColumn("r", F.coalesce("r", F.array().cast(f"array<{SOURCE}>")))
    none, nothing = F.array().cast(f"array<{SOURCE}>"), F.lit(None).cast("string")
    if provider is None:
        return described.select(
            "qid", F.lit("search").alias("mode"), nothing.alias("coverage"), F.lit(False).alias("answerable"), nothing.alias("banner"), nothing.alias("text"), F.array().cast("array<int>").alias("cited"),
            F.array().cast("array<string>").alias("warnings"), none.alias("sources"), F.col("r").alias("closest"), F.lit(False).alias("failed"),
        )
    prompted = apply(prompts(results, chunks, questions.select("qid", "question")), "prompt", "reply", provider, "reply", skip_errors=True)
    replies = cut_lineage(described.join(prompted.select("qid", "reply"), "qid", "left"), "replies")
    empty = F.col("n_sources") == 0
    ready = replies.select(
        "qid", "n_sources", F.when(empty, F.lit(NOTHING_FOUND)).otherwise(F.col("reply.answer")).alias("answer"), F.when(empty, F.lit("none")).otherwise(F.col("reply.coverage")).alias("coverage")
    )
    checked = check_answers(ready).join(replies.select("qid", "r", (~empty & (F.col("reply.answer").isNull() | F.col("reply.coverage").isNull())).alias("failed")), "qid")
    shown = F.when(F.col("failed") | F.col("answerable"), none).otherwise(F.slice("r", 1, closest))
    return checked.select(
        "qid", F.lit("answer").alias("mode"), "coverage", "answerable", coverage_banner(F.col("coverage")).alias("banner"), F.when(~F.col("failed"), F.col("cleaned")).alias("text"), F.coalesce("cited", F.array().cast("array<int>")).alias("cited"),
        "warnings", F.transform(F.coalesce("cited", F.array().cast("array<int>")), lambda i: F.get("r", i - 1)).alias("sources"), shown.alias("closest"), "failed",
    )


def answer_totals(runs: DataFrame) -> DataFrame:
    """Totals of ``runs(answerable, refused, cites_right, completeness, coverage, failed)``."""
    yes, no = F.coalesce("answerable", F.lit(False)), F.coalesce(~F.col("answerable"), F.lit(False))
    done = ~F.col("failed")
    c = lambda x, name: F.count_if(F.coalesce(x, F.lit(False))).alias(name)
    return runs.agg(
        c(no & done & F.col("refused"), "refused"), c(yes & done & F.col("refused"), "wrongly_refused"), c(yes & done & F.col("cites_right"), "cites_right_place"),
        c(done & (F.col("completeness") == "partial") & (F.col("coverage") == "partial"), "partial_marked_partial"),
        c(done & (F.col("completeness") == "full") & (F.col("coverage") == "partial"), "full_marked_partial"), c(F.col("failed"), "errors"),
    )

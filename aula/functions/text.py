"""Column functions on text. White space and word classes are spelled out so that every engine reads them alike."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, separators U+001C to U+001F included.
WS = r"[\t-\r\x1c-\x20\x85\xa0  -     　]"
#: The same for RE2, in which DuckDB's expressions are written.
WS_RE2 = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

# Words that a keyword search leaves out.
STOP_WORDS = """
a an the of to in on at for from by with and or but
is are was were be been being am do does did have has had
will would can could should may might this that these those
it its i you he she we they me my your our their
what which who whom when where why how not no yes as if
so than then there here about into over also
""".split()

POINT_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"  # fixed value: the URL namespace of name-based identifiers


def strip(c: Column) -> Column:
    """Without white space at either end (also the kinds that SQL's trim leaves)."""
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def words(c: Column) -> Column:
    """Longest runs of characters other than white space."""
    return F.filter(F.split(c, f"{WS}+"), lambda x: x != "")


def count_words(c: Column) -> Column:
    return F.size(words(c))


def normalize_word(c: Column) -> Column:
    """Lowercased, without leading and trailing characters other than letters, digits and underscore."""
    return F.regexp_replace(F.lower(c), r"^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$", "")


def has_letter_or_digit(c: Column) -> Column:
    return c.rlike(r"[\p{L}\p{N}_]")


def raw_words(c: Column) -> Column:
    """Recognised tokens, one per line; an empty text has none."""
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, "\n"))


def search_tokens(c: Column, stop: list[str] = STOP_WORDS) -> Column:
    """Lowercased runs of ASCII letters and digits without stop words; other letters part tokens."""
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: ~w.isin(stop))


def format_timestamp(seconds: Column) -> Column:
    """``m:ss``, or ``h:mm:ss`` from an hour on; fractions are cut off."""
    s = seconds.cast("bigint")
    h, m, r = F.floor(s / 3600), F.floor(s / 60) % 60, s % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, r)).otherwise(F.format_string("%d:%02d", m, r))


def shown_time(seconds: Column) -> Column:
    """``format_timestamp``, or ``-:--`` where there is no time."""
    return F.when(seconds.isNull(), "-:--").otherwise(format_timestamp(seconds))


def truncate_at_word(c: Column, most: int) -> Column:
    """Texts over ``most`` characters: cut back to the last space within them, with an ellipsis."""
    return F.when(F.length(c) > most, F.concat(F.regexp_replace(F.substring(c, 1, most), r" [^ ]*$", ""), F.lit(" ..."))).otherwise(c)


def preview(c: Column, most: int = 220) -> Column:
    return truncate_at_word(F.regexp_replace(c, "\n", " "), most)


def unique_in_order(c: Column) -> Column:
    """Distinct values in order of first appearance, blank ones left out."""
    return F.array_distinct(F.filter(c, lambda x: strip(x) != ""))


def round_half_even(c: Column, digits: int) -> Column:
    """Rounds the exact binary value to even, as decimal formatting of doubles does (0.125 to 0.12)."""
    return F.bround(c.cast("decimal(38,18)"), digits).cast("double")


def result_line(rank: Column, score: Column, lecture: Column, start: Column, end: Column, titles: Column) -> Column:
    named = unique_in_order(titles)
    shown = F.when(F.size(named) > 0, F.array_join(named, " | ")).otherwise(F.lit("(no slide titles)"))
    value = F.format_string("%.3f", round_half_even(score, 3))
    return F.concat(rank.cast("string"), F.lit(". score "), value, F.lit("  "), lecture, F.lit("  "), shown_time(start), F.lit(" - "), shown_time(end), F.lit("  "), shown)


def source_line(number: Column, lecture: Column, start: Column, end: Column, titles: Column) -> Column:
    named = unique_in_order(titles)
    parts = F.concat(F.lit("["), number.cast("string"), F.lit("] "), lecture, F.lit(" | "), shown_time(start), F.lit(" - "), shown_time(end))
    return F.when(F.size(named) > 0, F.concat(parts, F.lit(" | "), F.array_join(named, " | "))).otherwise(parts)


def coverage_banner(coverage: Column) -> Column:
    return (
        F.when(coverage == "none", "The lecture material does not cover this question.")
        .when(coverage == "partial", "The lecture material covers only part of this question.")
        .otherwise("")
    )


def slide_url(lecture: Column, path: Column) -> Column:
    """``/slides/<lecture>/<file>`` if both names are safe, else NULL."""
    file = F.element_at(F.split(path, r"[\\/]"), -1)
    safe = lecture.rlike(r"^[A-Za-z0-9_-]+$") & file.rlike(r"^[A-Za-z0-9_-]+(\.[A-Za-z0-9_-]+)*\.(jpg|jpeg|png)$")
    return F.when(safe, F.concat(F.lit("/slides/"), lecture, F.lit("/"), file))


def frame_timestamp(path: Column) -> Column:
    """Seconds in an image's file name ``frame_<seconds>.jpg``, else NULL."""
    found = F.regexp_extract(path, r"frame_([0-9]+(?:\.[0-9]+)?)\.jpg$", 1)
    return F.when(found != "", found).cast("double")


def model_slug(model: Column) -> Column:
    return F.lower(F.substring_index(model, "/", -1))


def point_id(name: Column) -> Column:
    """Name-based (version 5) identifier of a chunk in the URL namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(POINT_NAMESPACE)), F.encode(name, "utf-8")))
    variant = F.lower(F.hex((F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(0x3F)).bitwiseOR(0x80)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 19, 2)), F.substring(h, 21, 12))


def cache_key(model: str, limit: int, text: Column) -> Column:
    return F.sha2(F.concat_ws("\n", F.lit(model), F.lit(str(limit)), text), 256)


def join_parts(separator: str, *parts: Column) -> Column:
    """Non-empty parts joined; NULL counts as empty."""
    return F.concat_ws(separator, *[F.when(p != "", p) for p in parts])


def embed_text(slide: Column, description: Column, speech: Column, *, with_description: bool = True) -> Column:
    return F.concat_ws("\n\n", F.when(slide != "", slide), F.when(description != "", description) if with_description else F.lit(None).cast("string"), F.coalesce(speech, F.lit("")))


# ---- intervals and arrays -------------------------------------------------------------------------------------------


def ranges_overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Touching ranges do not overlap."""
    return (s1 < e2) & (e1 > s2)


def overlap_seconds(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(e1, e2) - F.greatest(s1, s2))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def unit_vector(v: Column) -> Column:
    norm = F.sqrt(dot(v, v))
    return F.transform(v.cast("array<double>"), lambda x: F.when(norm > 0, x / norm).otherwise(F.lit(0.0)))


def changed_share(a: Column, b: Column, threshold: float) -> Column:
    """Share of positions whose values differ by more than ``threshold``; 0 for empty arrays."""
    differs = F.size(F.filter(F.zip_with(a, b, lambda x, y: F.abs(x - y)), lambda d: d > threshold))
    return F.when(F.size(a) > 0, differs / F.size(a)).otherwise(0.0)


# ---- answers: citations and sentences -------------------------------------------------------------------------------

# The form of a citation, the abbreviations that end no sentence, what a sentence starts with, the words
# that speak about the material itself, and the number of words from which a sentence needs a citation.
CITATION = rf"\[[0-9]+(?:{WS}*,{WS}*[0-9]+)*\]"
ABBREVIATIONS = ("e.g.", "i.e.", "vs.", "cf.")
SENTENCE_START = "[A-Z0-9\"'(\\[`]"
ABOUT_MATERIAL = ("material", "excerpt")
LEAST_CITED_WORDS = 3


def _numbers(match: Column) -> Column:
    """Numbers as strings without leading zeros; they may have any length."""
    return F.transform(F.regexp_extract_all(match, F.lit("[0-9]+"), F.lit(0)), lambda x: F.regexp_replace(x, "^0+(?=[0-9])", ""))


def _exists(number: Column, n: Column) -> Column:
    return F.coalesce(number.try_cast("int").between(1, n), F.lit(False))


def cited_numbers(text: Column) -> Column:
    """All numbers in citation brackets, distinct, in order of first appearance."""
    return F.array_distinct(F.flatten(F.transform(F.regexp_extract_all(text, F.lit(CITATION), F.lit(0)), _numbers)))


def valid_citations(text: Column, n: Column) -> Column:
    return F.transform(F.filter(cited_numbers(text), lambda x: _exists(x, n)), lambda x: x.try_cast("int"))


def invalid_citations(text: Column, n: Column) -> Column:
    return F.filter(cited_numbers(text), lambda x: ~_exists(x, n))


def clean_citations(text: Column, n: Column) -> Column:
    """Citations reduced to valid numbers; a bracket without any goes, and so do the spaces it leaves."""

    def kept(match: Column) -> Column:
        good = F.filter(_numbers(match), lambda x: _exists(x, n))
        return F.when(F.size(good) > 0, F.concat(F.lit("["), F.array_join(good, ", "), F.lit("]"))).otherwise(F.lit(""))

    between = F.split(text, CITATION, -1)
    inside = F.transform(F.regexp_extract_all(text, F.lit(CITATION), F.lit(0)), kept)
    joined = F.array_join(F.zip_with(between, inside, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return strip(F.regexp_replace(F.regexp_replace(joined, " {2,}", " "), f"{WS}+([.,;:])", "$1"))


def sentences(text: Column) -> Column:
    """Sentences; a new line starts a new one. Citations that lead a piece, also one on a new line, go to the sentence
    before, and then a piece behind an abbreviation goes on with the sentence before.

    A sentence that took citations ends with them and thus not with an abbreviation, so both rules depend on a piece and
    the end of the piece before only. Pieces are written in a row with a line feed where a sentence starts (no piece holds
    one) and cut there, in time linear in the text.
    """
    pieces = F.flatten(F.transform(F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != ""), lambda x: F.split(x, rf"(?<=[.!?]){WS}+(?={SENTENCE_START})", -1)))
    leading = rf"^(?:{CITATION}{WS}*)+"

    def written(piece: Column, before: Column) -> Column:
        lead, rest = strip(F.regexp_extract(piece, leading, 0)), strip(F.regexp_replace(piece, leading, ""))
        goes_on = F.concat(F.lit(" "), lead, F.when(rest == "", F.lit("")).otherwise(F.concat(F.lit("\n"), rest)))
        cut_short = reduce(lambda a, b: a | b, [F.endswith(F.lower(before), F.lit(e)) for e in ABBREVIATIONS])
        plain = F.concat(F.when(cut_short, F.lit(" ")).otherwise(F.lit("\n")), piece)
        return F.when(before.isNull() | piece.isNull(), piece).when(lead != "", goes_on).otherwise(plain)

    shifted = F.concat(F.array(F.lit(None).cast("string")), pieces)  # one longer; what it has too much is NULL and goes
    row = F.array_join(F.zip_with(pieces, shifted, written), "")
    return F.when(row == "", F.array().cast("array<string>")).otherwise(F.split(row, "\n", -1))


def uncited_sentences(text: Column) -> Column:
    """Sentences of three words or more without a citation that do not speak about the material itself."""
    return F.filter(sentences(text), lambda s: ~s.rlike(CITATION) & (count_words(s) >= LEAST_CITED_WORDS) & ~F.lower(s).rlike("|".join(ABOUT_MATERIAL)))

"""Problem 9: visually identical text with different characters.

``consistent_text`` runs DuckDB inside Arrow partitions. Its SQL removes invisible characters, composes accents
(``nfc_normalize``), maps wide and narrow forms, kinds of single space, hyphens and look-alike letters (``translate``), accented
ones included, and composes once more, as a look-alike base may only now meet its accent. Words that hold a letter which
exists in Cyrillic, Greek or Armenian only are then written wholly in that script, so that Russian text stays Russian. The
decision rests on letters that no look-alike rule touches, hence texts that look the same still come out equal.

Tables of a few letters are written down; larger ones follow from Unicode's own decompositions.

Defined results: NULL text stays NULL, empty text stays empty, case, digits, visible accents and runs of spaces are
kept; every row comes out once, repeated rows too; other columns pass through, an existing output column is replaced.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Hyphens that look like U+002D.
HYPHENS = "‐‑⁃˗﹣"
# Letters that look like a Latin letter, and that letter, by script.
SCRIPTS = {
    "Cyrillic": ("АВЕЅІЈКМНОРСТХаеѕіјорсухһԁԛԝԚԜԌѴѵҮ", "ABESIJKMHOPCTXaesijopcyxhdqwQWGVvY"),
    "Greek": ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονϲϹϳͿ", "ABEZHIKMNOPTYXovcCjJ"),
    "Armenian": ("ՕօՍսհոցՏյԼ", "OoUuhngSjL"),
}
# Other letters of the Latin script that look like a basic one.
LATIN = ("ɑɡ", "ag")
#: Kinds of compatibility decompositions that change the width, not the look, or the style of a letter.
SAME_LOOK = ("<wide>", "<narrow>", "<noBreak>", "<font>")


def _invisible() -> str:
    """A character class of what takes no place on the line: format characters but for those that show (number signs and
    the like, which join the digits behind them), fillers, joiners and variation selectors."""
    shown = {*range(0x600, 0x606), 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD}
    kept = {i for i in range(0x20000) if unicodedata.category(chr(i)) == "Cf" and i not in shown}
    kept |= {0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10)}
    runs: list[list[int]] = []
    for i in sorted(kept):
        if runs and runs[-1][1] == i - 1:
            runs[-1][1] = i
        else:
            runs.append([i, i])
    return "".join(chr(i) if i == j else f"{chr(i)}-{chr(j)}" for i, j in [*runs, [0xE0000, 0xE0FFF]])


def _letters() -> dict[str, str]:
    """Every look-alike letter with what it looks like, accented ones after their base."""
    base = {a: b for letters, latin in (*SCRIPTS.values(), LATIN) for a, b in zip(letters, latin)}
    out = dict(base)
    for i in range(0x370, 0x2000):
        parts = unicodedata.normalize("NFD", chr(i))
        if len(parts) > 1 and parts[0] in base:
            out[chr(i)] = unicodedata.normalize("NFC", base[parts[0]] + parts[1:])
    return out


def _forms() -> tuple[dict[str, str], dict[str, str]]:
    """Wide and narrow forms and spaces, and apart from them the rare styles of letters."""
    common, rare = {}, {}
    for i in range(0x80, 0x20000):
        c = chr(i)
        if unicodedata.category(c) == "Zs":
            common[c] = " "
            continue
        kind = unicodedata.decomposition(c).split(" ", 1)[0]
        plain = unicodedata.normalize("NFKC", c)
        if kind in SAME_LOOK and len(plain) == 1 or 0x2160 <= i < 0x2180 and len(plain) == 1 and plain != c:
            (common if 0xFF00 <= i < 0xFF5F else rare)[c] = plain
    return common, rare


INVISIBLE = _invisible()
LETTERS = _letters()
COMMON, RARE = _forms()
#: Single characters that become one character; ``RARE`` ones and ``LONG`` ones are looked for only where they occur.
COMMON |= {h: "-" for h in HYPHENS} | {a: b for a, b in LETTERS.items() if len(b) == 1}
LONG = {a: b for a, b in LETTERS.items() if len(b) > 1}
#: What every character becomes.
ALIKE = {a: (COMMON | LONG).get(b, b) for a, b in RARE.items()} | COMMON | LONG


def _literal(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _native(t: str, script: str) -> str:
    """Words with a letter of ``script`` written wholly in it; look-alikes were made Latin before."""
    back: dict[str, str] = {}
    for a, b in LETTERS.items():
        if len(b) == 1 and unicodedata.name(a).startswith(script.upper()):
            back.setdefault(b, a)
    word = r"[\p{L}\p{M}]+|[^\p{L}\p{M}]+"
    return (
        f"CASE WHEN regexp_matches({t}, '\\p{{{script}}}') THEN nfc_normalize(array_to_string(list_transform(regexp_extract_all({t}, '{word}'), "
        f"lambda w: CASE WHEN regexp_matches(w, '\\p{{{script}}}') THEN translate(w, {_literal(''.join(back))}, {_literal(''.join(back.values()))}) ELSE w END), '')) ELSE {t} END"
    )


def _class(characters) -> str:
    return "[" + "".join(characters) + "]"


def skeleton_sql(column: str) -> str:
    """SQL of the form in which look-alikes are Latin: equal for texts that look the same."""
    seen = f"nfc_normalize(regexp_replace({column}, '[{INVISIBLE}]', '', 'g'))"
    rare = f"list_transform([{seen}], lambda x: CASE WHEN regexp_matches(x, '{_class(RARE)}') THEN nfc_normalize(translate(x, {_literal(''.join(RARE))}, {_literal(''.join(RARE.values()))})) ELSE x END)"
    long = "x"
    for a, b in LONG.items():
        long = f"replace({long}, '{a}', '{b}')"
    whole = f"list_transform({rare}, lambda x: CASE WHEN regexp_matches(x, '{_class(LONG)}') THEN {long} ELSE x END)"
    return f"CASE WHEN strlen({column}) = length({column}) THEN {column} ELSE nfc_normalize(translate({whole}[1], {_literal(''.join(COMMON))}, {_literal(''.join(COMMON.values()))})) END"


def consistent_sql(column: str, table: str, others: str) -> str:
    sql = f"SELECT {others}, {skeleton_sql(column)} AS t FROM {table}"
    for script in SCRIPTS:
        sql = f"SELECT * REPLACE ({_native('t', script)} AS t) FROM ({sql})"
    return sql


def _connection():
    import duckdb

    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute("SET preserve_insertion_order = true")
    return con


def consistent_text(df: DataFrame, text: str = "text", out: str = "text") -> DataFrame:
    """``df`` with ``out`` = ``text`` in its one consistent form."""
    kept = [c for c in df.columns if c != out]
    narrow = df.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(kept)], F.col(text).alias("_text"))
    schema = T.StructType([T.StructField(f"c{i}", df.schema[c].dataType) for i, c in enumerate(kept)] + [T.StructField("t", T.StringType())])
    query = consistent_sql("_text", "batch", "1 AS nothing")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _connection()
        for b in batches:
            table = pa.Table.from_batches([b])
            con.register("batch", table.select(["_text"]))
            done = con.sql(query).to_arrow_table()["t"]
            con.unregister("batch")
            yield from table.drop_columns(["_text"]).append_column("t", done.cast(pa.string())).to_batches()

    made = narrow.mapInArrow(run, schema)
    return made.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(kept)], F.col("t").alias(out))


def look_keys(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key, raw, look``: 128-bit digests (hex) of the text as it is and of its consistent form; NULL texts left out.

    Only digests leave the Python side; the texts themselves are never shuffled.
    """
    schema = T.StructType([T.StructField("k", df.schema[key].dataType), T.StructField("raw", T.StringType()), T.StructField("look", T.StringType())])
    query = f"SELECT md5(_text) AS raw, CASE WHEN strlen(_text) = length(_text) THEN md5(_text) ELSE md5({skeleton_sql('_text')}) END AS look FROM batch"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _connection()
        for b in batches:
            con.register("batch", pa.Table.from_batches([b.select(["_text"])]))
            done = con.sql(query).to_arrow_table()
            con.unregister("batch")
            keys = pa.chunked_array([b["k"]])
            yield from pa.Table.from_arrays([keys, done["raw"].cast(pa.string()), done["look"].cast(pa.string())], ["k", "raw", "look"]).to_batches()

    narrow = df.filter(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("_text"))
    return narrow.mapInArrow(run, schema).withColumnRenamed("k", key)


def look_alike_pairs(keys: DataFrame, key: str) -> DataFrame:
    """``{key}_a < {key}_b``: records that look the same but are not equal, from ``look_keys`` (read three times).

    Pairs are formed between classes of exact copies and only then expanded to their members, so that exact copies
    never meet each other, however many there are.
    """
    classes = keys.groupBy("look", "raw").agg(F.count("*").alias("n"))
    mixed = classes.groupBy("look").agg(F.count("*").alias("n")).filter("n > 1").select("look")
    # only classes that have a counterpart go on
    small = classes.select("look", "raw").join(mixed, "look", "left_semi")
    a = small.select("look", F.col("raw").alias("raw_a"))
    b = small.select("look", F.col("raw").alias("raw_b"))
    pairs = a.join(b, "look").filter("raw_a < raw_b").select("raw_a", "raw_b")
    left = keys.select(F.col("raw").alias("raw_a"), F.col(key).alias("x"))
    right = keys.select(F.col("raw").alias("raw_b"), F.col(key).alias("y"))
    found = pairs.join(left, "raw_a").join(right, "raw_b").filter("x <> y")
    return found.select(F.least("x", "y").alias(f"{key}_a"), F.greatest("x", "y").alias(f"{key}_b")).distinct()

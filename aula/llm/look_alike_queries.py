"""Queries of problem 9."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from aula.llm.look_alike import consistent_text, look_alike_pairs, look_keys
from aula.session import cut_lineage
from aula.sources.tables import read_records


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    keys = cut_lineage(look_keys(read_records(spark, d, "documents", "doc_id", "text"), "doc_id"), "looks")
    return look_alike_pairs(keys, "doc_id")


def p9_texts(spark: SparkSession, d: str) -> DataFrame:
    return consistent_text(read_records(spark, d, "documents", "doc_id", "text"))


# The SQL has its own list of what looks alike, by code point and apart from the operator's tables: what text in these
# tables' languages can hold. Marks that a letter brings along follow it. Wide forms are reckoned, not listed.
_ALIKE = """
1040 A 1042 B 1045 E 1029 S 1030 I 1032 J 1050 K 1052 M 1053 H 1054 O 1056 P 1057 C 1058 T 1061 X 1072 a 1077 e 1109 s 1110 i 1112 j
1086 o 1088 p 1089 c 1091 y 1093 x 1211 h 1281 d 1307 q 1309 w 1025 E776 1105 e776 1024 E768 1104 e768 1031 I776 1111 i776 1118 y774
1232 A774 1233 a774 1234 A776 1235 a776 1238 E774 1239 e774 1254 O776 1255 o776 1265 y776
913 A 914 B 917 E 918 Z 919 H 921 I 922 K 924 M 925 N 927 O 929 P 932 T 933 Y 935 X 959 o 957 v 972 o769 902 A769 904 E769 905 H769 906 I769 908 O769 910 Y769 938 I776 939 Y776
8208 - 8209 - 8259 - 727 - 65123 -
""".split()
_CASES = " ".join(f"WHEN {code} THEN '{to[0]}'" + (f" || chr({to[1:]})" if len(to) > 1 else "") for code, to in zip(_ALIKE[::2], _ALIKE[1::2]))
_NOTHING = "173, 847, 1564, 6158, " + ", ".join(str(i) for i in (*range(8203, 8208), *range(8234, 8239), *range(8288, 8304), 65279, *range(65024, 65040)))
_SPACE = "160, 5760, 8239, 8287, 12288, " + ", ".join(str(i) for i in range(8192, 8203))
_SKELETON = f"""
looks AS (
  SELECT doc_id, text, nfc_normalize(array_to_string(list_transform(string_split(text, ''), lambda c: CASE WHEN unicode(c) < 128 THEN c WHEN unicode(c) IN ({_NOTHING}) THEN '' WHEN unicode(c) IN ({_SPACE}) THEN ' '
    WHEN unicode(c) BETWEEN 65281 AND 65374 THEN chr(unicode(c) - 65248) ELSE CASE unicode(c) {_CASES} ELSE c END END), '')) AS look
  FROM documents WHERE text IS NOT NULL)"""
_CYRILLIC = ("ABEËSIJKMHOPCTXaeësijopcyxhdqw", "АВЕЁЅІЈКМНОРСТХаеёѕіјорсухһԁԛԝ")
_GREEK = ("ABEZHIKMNOPTYXov", "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧον")


def _script(t: str, name: str, latin: str, letters: str) -> str:
    return f"""(SELECT coalesce(string_agg(CASE WHEN regexp_matches(w, '\\p{{{name}}}') THEN nfc_normalize(translate(w, '{latin}', '{letters}')) ELSE w END, '' ORDER BY i), '')
      FROM (SELECT unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT regexp_extract_all({t}, '[\\p{{L}}\\p{{M}}]+|[^\\p{{L}}\\p{{M}}]+') AS ws)))"""


QUERIES = {"p9_found": p9_found, "p9_texts": p9_texts}
SQL = {
    "p9_found": f"""WITH {_SKELETON}
SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM looks a JOIN looks b ON a.look = b.look AND a.doc_id < b.doc_id AND a.text <> b.text""",
    "p9_texts": f"""WITH {_SKELETON},
cyr AS (SELECT doc_id, {_script('look', 'Cyrillic', *_CYRILLIC)} AS look FROM looks)
SELECT doc_id, {_script('look', 'Greek', *_GREEK)} AS text FROM cyr
UNION ALL SELECT doc_id, text FROM documents WHERE text IS NULL""",
}

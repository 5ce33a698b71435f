"""The registered queries of this subpackage, and the SQL of those that SQL can say."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from estrado.llm import canon, confusables, cooccur, leak, mix, names, noise, split
from estrado.queries import RULINGS_SQL
from estrado.sources.fallos import read_table


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p2_found": lambda spark, d: noise.found(read_table(spark, d, "fallos_json")),
        "p2_repaired": lambda spark, d: noise.repair(read_table(spark, d, "fallos_json")),
        "p3_found": lambda spark, d: canon.found(read_table(spark, d, "ruling_citations"), read_table(spark, d, "subsection_citations"), read_table(spark, d, "fuentes_ref")),
        "p5_found": lambda spark, d: split.found(read_table(spark, d, "fallos_json"), read_table(spark, d, "paragraphs")),
        "p5_pieces": lambda spark, d: split.all_pieces(read_table(spark, d, "fallos_json"), read_table(spark, d, "paragraphs")),
        "p6_found": lambda spark, d: cooccur.found(read_table(spark, d, "ruling_citations"), read_table(spark, d, "fuentes_ref")),
        "p7_found": lambda spark, d: names.found(read_table(spark, d, "votos")),
        "p7_people": lambda spark, d: names.link(read_table(spark, d, "votos"), "organo", "section"),
        "p8_found": lambda spark, d: leak.found(read_table(spark, d, "documents"), read_table(spark, d, "eval_items")),
        "p8_spans": lambda spark, d: leak.leaks(read_table(spark, d, "documents"), read_table(spark, d, "eval_items")),
        "p9_mix": lambda spark, d: mix.mix(read_table(spark, d, "documents"), read_table(spark, d, "mix_targets")),
        "p9_shares": lambda spark, d: mix.shares(read_table(spark, d, "documents"), read_table(spark, d, "mix_targets")),
        "p10_found": lambda spark, d: confusables.found(read_table(spark, d, "documents")),
        "p10_classes": lambda spark, d: confusables.alike(read_table(spark, d, "documents")),
        "p10_normalized": lambda spark, d: confusables.normalize(read_table(spark, d, "documents"), keep=("doc_id",)),
    }


def oracle_sql() -> dict[str, str]:
    return {"p5_found": _p5(), "p6_found": cooccur.FOUND_SQL, "p8_found": _p8(), "p8_spans": _p8_spans(), "p10_found": _p10(), "p10_classes": _p10_classes(), "p10_normalized": _p10_normalized()}


def _p5() -> str:
    short = "|".join(sorted(split.ABBREVIATIONS))
    masked = rf"regexp_replace(regexp_replace(text, '(^|[\s(])((?i:{short}))\.', '\1\2_', 'g'), '(^|[\s(])([A-ZÁÉÍÓÚÜÑ])\.', '\1\2_', 'g')"
    sentences = rf"regexp_replace({masked}, '([.?!])\s+([A-ZÁÉÍÓÚÜÑ])', '\1' || chr(10) || '\2', 'g')"
    longest = lambda parts: f"list_max(list_transform({parts}, lambda x: length(rtrim(x, ' ' || chr(10)))))"
    return rf"""
WITH {RULINGS_SQL},
p AS (SELECT file_id, obj_pos, k, CASE WHEN json_type(v) = 'ARRAY' THEN json_extract(v, '$[*]') ELSE [v] END AS l FROM v WHERE k LIKE '% DIJO'),
q AS (SELECT file_id, obj_pos, k, generate_subscripts(l, 1) - 1 AS para_pos, unnest(l) AS e FROM p),
t AS (SELECT 'fallos_json' AS tbl, file_id AS row_id, obj_pos::INT AS obj_pos, k AS section, para_pos::INT AS para_pos, CASE WHEN json_type(e) = 'OBJECT' THEN e ->> '$.texto' ELSE e ->> '$' END AS text FROM q
      UNION ALL SELECT 'paragraphs', para_uid, 0, section, paragraph_id, text FROM paragraphs)
SELECT DISTINCT tbl, row_id, obj_pos, section, para_pos, CASE
  WHEN {longest("string_split(text, chr(10))")} <= 1024 THEN 'linea'
  WHEN {longest(f"string_split({sentences}, chr(10))")} <= 1024 THEN 'oracion'
  WHEN {longest(r"regexp_split_to_array(text, '\s+')")} <= 1024 THEN 'palabra' ELSE 'nada' END AS level
FROM t WHERE length(text) > 1024
"""


_MARKS = "".join([*confusables.LOOKALIKE, confusables.FULL_WIDTH[0]])
_PLAIN = "".join([*confusables.LOOKALIKE.values(), confusables.FULL_WIDTH[1]]).replace("'", "''")
_WORDS = rf"regexp_extract_all(lower(strip_accents(regexp_replace(translate(text, '{_MARKS}', '{_PLAIN}'), '[{confusables.INVISIBLE}]', '', 'g'))), '[\p{{L}}\p{{N}}]+')"


def _p8() -> str:
    grams = lambda table, key: f"(SELECT {key}, unnest(list_transform(range(1, greatest(1, len(w) - 8)), lambda i: array_to_string(w[i:i + 9], ' '))) AS g FROM (SELECT {key}, {_WORDS} AS w FROM {table} WHERE text IS NOT NULL))"
    return f"SELECT DISTINCT doc_id, item_id FROM {grams('documents', 'doc_id')} JOIN {grams('eval_items', 'item_id')} USING (g)"


def _p8_spans() -> str:
    at = lambda table, key: f"(SELECT {key}, unnest(list_transform(range(0, greatest(0, len(w) - 9)), lambda i: {{'pos': i, 'g': array_to_string(w[i + 1:i + 10], ' ')}}), recursive := true) FROM (SELECT {key}, {_WORDS} AS w FROM {table} WHERE text IS NOT NULL))"
    return f"""
WITH h AS (SELECT DISTINCT doc_id, item_id, d.pos FROM {at('documents', 'doc_id')} d JOIN {at('eval_items', 'item_id')} e USING (g)),
b AS (SELECT *, CASE WHEN pos > lag(pos) OVER o + 10 THEN 1 ELSE 0 END AS new FROM h WINDOW o AS (PARTITION BY doc_id, item_id ORDER BY pos)),
s AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, item_id ORDER BY pos) AS span FROM b)
SELECT doc_id, item_id, min(pos)::INT AS word_from, max(pos + 10)::INT AS word_to FROM s GROUP BY doc_id, item_id, span
"""


def _forms() -> str:
    """Character by character: a table of forms for single characters, one of look-alikes for whole words."""
    values = lambda table: ", ".join(f"({confusables._quoted(c)}, {confusables._quoted(to)})" for c, to in table.items())
    plain = confusables.COMPATIBLE | {c: " " for c in confusables.SPACES} | dict(zip(*confusables.MARKS)) | {c: "" for c in confusables.INVISIBLE} | {c: confusables.LOOKALIKE[c] for c in confusables.LATIN}
    return f"""
WITH plain(c, p) AS (VALUES {values(plain)}), latin(f, l) AS (VALUES {values(confusables.LOOKALIKE | confusables.MARKED)}),
chars AS (SELECT doc_id, generate_subscripts(s, 1) AS pos, unnest(s) AS c FROM (SELECT doc_id, regexp_extract_all(text, '(?s).') AS s FROM documents WHERE text IS NOT NULL)),
forms AS (SELECT doc_id, pos, coalesce(p, c) AS f FROM chars LEFT JOIN plain USING (c)),
words AS (SELECT *, sum(CASE WHEN regexp_matches(f, '^\\s') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS w FROM forms),
looks AS (SELECT *, bool_and(l IS NOT NULL OR NOT regexp_matches(f, '[\\p{{Greek}}\\p{{Cyrillic}}]')) OVER (PARTITION BY doc_id, w) AS whole FROM words LEFT JOIN latin USING (f)),
n AS (SELECT doc_id, nfc_normalize(string_agg(CASE WHEN whole THEN coalesce(l, f) ELSE f END, '' ORDER BY pos)) AS form FROM looks GROUP BY doc_id),
t AS (SELECT doc_id, text, CASE WHEN text IS NOT NULL THEN coalesce(form, '') END AS form FROM documents LEFT JOIN n USING (doc_id))
"""


def _p10() -> str:
    return f"{_forms()} SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM t a JOIN t b ON a.form = b.form AND a.text <> b.text AND a.doc_id < b.doc_id"


def _p10_classes() -> str:
    return f"{_forms()} SELECT DISTINCT md5(form) AS class_id, doc_id, md5(text) AS raw_hash FROM t WHERE form IN (SELECT form FROM t GROUP BY form HAVING count(DISTINCT text) > 1)"


def _p10_normalized() -> str:
    return f"{_forms()} SELECT doc_id, form AS normal FROM t"

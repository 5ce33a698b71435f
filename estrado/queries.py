"""The registered queries of the core: name -> (spark, sf_dir) -> DataFrame, each with its SQL where SQL can say it.

Tables stand in for the originals' files as follows: documents are page texts whose lines are paragraphs, paragraphs and
ruling_citations are indexed rulings, eval_items whose id is divisible by 20 are the questions of a search, embeddings
are dense points (a document's where the ids agree), and events are the ordered log of matches and conversations.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from estrado.functions import chunks as K
from estrado.functions import citations as C
from estrado.functions import sets as S
from estrado.functions import text as T
from estrado.operators import answers, documents, drift, evaluate, nested, search
from estrado.plans.repeats import distinct_rows
from estrado.plans.scratch import materialize
from estrado.sources import files
from estrado.sources.fallos import read_table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        _QUERIES[run.__name__] = run
        if sql:
            _SQL[run.__name__] = sql
        return run

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# ---- nested rulings and drift -------------------------------------------------------------------------------------

RULINGS_SQL = """
f AS (SELECT file_id, any_value(payload) AS payload FROM fallos_json WHERE json_valid(payload) GROUP BY file_id),
r AS (SELECT file_id, generate_subscripts(l, 1) - 1 AS obj_pos, unnest(l) AS o
      FROM (SELECT file_id, CASE WHEN json_type(payload) = 'ARRAY' THEN json_extract(payload, '$[*]') ELSE [payload::JSON] END AS l FROM f)),
s AS (SELECT file_id, obj_pos, unnest(json_keys(o, '$.CONTENIDO')) AS k, generate_subscripts(json_keys(o, '$.CONTENIDO'), 1) - 1 AS i, o FROM r),
v AS (SELECT file_id, obj_pos, k, i, json_extract(o, '/CONTENIDO/' || replace(replace(k, '~', '~0'), '/', '~1')) AS v FROM s),
c AS (SELECT file_id, obj_pos, unnest(l) AS cit, generate_subscripts(l, 1) - 1 AS i
      FROM (SELECT file_id, obj_pos, json_extract(o, '$.METADATOS.ARTICULOS_CITADOS.citations[*]') AS l FROM r))
"""


@query(f"""
WITH {RULINGS_SQL},
p AS (SELECT file_id, obj_pos, 'parrafo' AS child, i, unnest(generate_series(0, CASE json_type(v) WHEN 'ARRAY' THEN json_array_length(v)::BIGINT - 1 WHEN 'NULL' THEN -1 ELSE 0 END)) AS j, k AS val FROM v),
a AS (SELECT file_id, obj_pos, 'articulo' AS child, i, generate_subscripts(l, 1) - 1 AS j, unnest(l) ->> '$' AS val
      FROM (SELECT *, json_extract(cit, '$.cited_articles[*]') AS l FROM c))
SELECT file_id, obj_pos::INT AS obj_pos, child, i::INT AS i, j::INT AS j, val FROM p
UNION ALL SELECT file_id, obj_pos::INT, child, i::INT, j::INT, val FROM a
""")
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.found(read_table(spark, d, "fallos_json"))


# States of a list: the set of its elements' types, nulls aside; an object with a textual texto is a paragraph.
_STATES_SQL = """
CASE WHEN v IS NULL OR json_type(v) = 'NULL' THEN 'nulo' WHEN json_type(v) = 'VARCHAR' THEN 'texto' WHEN json_type(v) = 'BOOLEAN' THEN 'logico'
  WHEN json_type(v) = 'OBJECT' THEN CASE WHEN json_type(v, '$.texto') = 'VARCHAR' THEN 'parrafo' ELSE 'objeto' END
  WHEN json_type(v) <> 'ARRAY' THEN 'numero' WHEN json_array_length(v) = 0 THEN 'lista_vacia' WHEN len(e) = 0 THEN 'lista_nula'
  WHEN len(e) > 1 THEN CASE WHEN len(list_filter(e, lambda x: x NOT IN ('texto', 'parrafo'))) = 0 THEN 'lista_mixta' ELSE 'lista_otro' END
  WHEN e[1] = 'texto' THEN 'lista_texto' WHEN e[1] = 'numero' THEN 'lista_numero' WHEN e[1] = 'parrafo' THEN 'lista_objeto' ELSE 'lista_otro' END
"""
_ELEMENTS_SQL = """
list_distinct(list_filter(list_transform(json_extract(v, '$[*]'), lambda x: CASE json_type(x) WHEN 'VARCHAR' THEN 'texto' WHEN 'NULL' THEN NULL WHEN 'ARRAY' THEN 'lista' WHEN 'BOOLEAN' THEN 'logico'
  WHEN 'OBJECT' THEN CASE WHEN json_type(x, '$.texto') = 'VARCHAR' THEN 'parrafo' ELSE 'objeto' END ELSE 'numero' END), lambda x: x IS NOT NULL)) AS e
"""


@query(f"""
WITH {RULINGS_SQL}
SELECT file_id, obj_pos::INT AS obj_pos, i::INT AS section_pos, k AS section, {_STATES_SQL} AS variant FROM (SELECT *, {_ELEMENTS_SQL} FROM v)
""")
def p1_sections(spark: SparkSession, d: str) -> DataFrame:
    return nested.flat_tables(read_table(spark, d, "fallos_json"), "sections")["sections"].select("file_id", "obj_pos", "section_pos", "section", "variant")


@query(f"""
WITH {RULINGS_SQL}
SELECT file_id, obj_pos::INT AS obj_pos, i::INT AS citation_pos, cit ->> '$.main_source' AS main_source FROM c
""")
def p1_citations(spark: SparkSession, d: str) -> DataFrame:
    return nested.flat_tables(read_table(spark, d, "fallos_json"), "citations")["citations"].select("file_id", "obj_pos", "citation_pos", "main_source")


@query(f"""
WITH {RULINGS_SQL}
SELECT file_id, obj_pos::INT AS obj_pos, i::INT AS citation_pos, (generate_subscripts(l, 1) - 1)::INT AS article_pos, main_source, unnest(l) ->> '$' AS article
FROM (SELECT *, cit ->> '$.main_source' AS main_source, json_extract(cit, '$.cited_articles[*]') AS l FROM c)
""")
def p1_articles(spark: SparkSession, d: str) -> DataFrame:
    return nested.flat_tables(read_table(spark, d, "fallos_json"), "articles")["articles"].drop("article_no")


@query(f"""
WITH {RULINGS_SQL},
t AS (SELECT *, {_STATES_SQL} AS variant FROM (SELECT *, {_ELEMENTS_SQL} FROM v)),
p AS (SELECT CASE WHEN variant = 'texto' THEN 'paragraphs_texto' WHEN variant = 'lista_texto' THEN 'paragraphs_lista' WHEN variant IN ('lista_objeto', 'lista_mixta', 'parrafo') THEN 'paragraphs_objeto' ELSE 'paragraphs_otro' END AS subtype,
        CASE WHEN json_type(v) = 'ARRAY' THEN len(list_filter(json_extract(v, '$[*]'), lambda x: json_type(x) <> 'NULL')) ELSE 1 END AS n FROM t WHERE variant <> 'nulo'),
q AS (SELECT CASE WHEN len(list_filter(json_extract(cit, '$.cited_articles[*]'), lambda x: json_type(x) <> 'NULL')) > 0 THEN 'citations_articulos' ELSE 'citations_sin_articulos' END AS subtype FROM c WHERE json_type(cit) = 'OBJECT')
SELECT subtype, sum(n)::BIGINT AS n FROM p GROUP BY subtype HAVING sum(n) > 0 UNION ALL SELECT subtype, count(*) FROM q GROUP BY subtype
""")
def p1_variants(spark: SparkSession, d: str) -> DataFrame:
    names = (*nested.SUBTYPES["paragraphs"], *nested.SUBTYPES["citations"])
    tables = nested.flat_tables(read_table(spark, d, "fallos_json"), *names)
    parts = [tables[n].select(F.lit(n).alias("subtype")) for n in names]
    return functools.reduce(DataFrame.unionByName, parts).groupBy("subtype").agg(F.count("*").alias("n"))


@query(f"""
WITH {RULINGS_SQL}
SELECT file_id, obj_pos::INT AS obj_pos, i::INT AS section_pos, k AS section, j::INT AS para_pos, CASE WHEN json_type(x, '$.texto') = 'VARCHAR' THEN x ->> '$.texto' ELSE x ->> '$' END AS text
FROM (SELECT *, generate_subscripts(l, 1) - 1 AS j, unnest(l) AS x FROM (SELECT *, CASE WHEN json_type(v) = 'ARRAY' THEN json_extract(v, '$[*]') ELSE [v] END AS l FROM v))
WHERE json_type(x) <> 'NULL'
""")
def p1_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return nested.flat_tables(read_table(spark, d, "fallos_json"), "paragraphs")["paragraphs"].drop("variant")


@query("SELECT DISTINCT file_id, 'ilegible' AS reason, payload FROM fallos_json WHERE payload <> '' AND NOT json_valid(payload)")
def p1_rejects(spark: SparkSession, d: str) -> DataFrame:
    return nested.flat_tables(read_table(spark, d, "fallos_json"), "rejects")["rejects"]


@query()
def p1_members(spark: SparkSession, d: str) -> DataFrame:
    return nested.flat_tables(read_table(spark, d, "fallos_json"), "members")["members"]


@query()
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.changes(read_table(spark, d, "fallos_json"))


@query()
def p4_unified(spark: SparkSession, d: str) -> DataFrame:
    return drift.unified(read_table(spark, d, "fallos_json"))


# ---- paragraphs of page texts -------------------------------------------------------------------------------------

_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_LINES = f"(SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents WHERE text IS NOT NULL)"


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").select("doc_id", "source", F.posexplode(T.lines(F.col("text"))).alias("pos", "line"))


@query(f"SELECT doc_id, pos::INT AS pos, line AS text FROM {_LINES} WHERE length({_STRIP.format('line')}) >= 10")
def paragraph_explode(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).where(F.length(T.strip(F.col("line"))) >= 10).select("doc_id", "pos", F.col("line").alias("text"))


@query(f"""
SELECT reason, count(*) AS n FROM (
  SELECT 'no text' AS reason FROM documents WHERE text IS NULL
  UNION ALL SELECT 'no id' FROM documents WHERE expediente IS NULL OR trim(expediente) = ''
  UNION ALL SELECT 'short' FROM {_LINES} WHERE length({_STRIP.format('line')}) < 10) GROUP BY reason
""")
def paragraph_rejects(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents")
    none = docs.where("text is null").select(F.lit("no text").alias("reason"))
    no_id = docs.where("expediente is null or trim(expediente) = ''").select(F.lit("no id").alias("reason"))
    short = _lines(spark, d).where(F.length(T.strip(F.col("line"))) < 10).select(F.lit("short").alias("reason"))
    return none.unionByName(no_id).unionByName(short).groupBy("reason").agg(F.count("*").alias("n"))


@query("""
SELECT count(*) AS documents, sum(len(string_split(text, chr(10))))::BIGINT AS paragraphs, count(DISTINCT expediente) AS rulings,
  count(*) FILTER (WHERE text IS NULL) AS errors, round(count(*) FILTER (WHERE text IS NULL) / greatest(1, count(*)), 6) AS error_rate FROM documents
""")
def processing_stats(spark: SparkSession, d: str) -> DataFrame:
    errors = F.count_if(F.col("text").isNull())
    rate = F.round(F.try_divide(errors.cast("double"), F.greatest(F.lit(1), F.count("*"))), 6)
    return read_table(spark, d, "documents").agg(F.count("*").alias("documents"), F.sum(F.size(T.lines(F.col("text"))).cast("long")).alias("paragraphs"), F.countDistinct("expediente").alias("rulings"), errors.alias("errors"), rate.alias("error_rate"))


_NOISE = "(?i)^(?:" + "|".join(T.NOISE_LINES) + ")"
_PAGES_SQL = f"SELECT file_id, obj_pos, k AS section, generate_subscripts(l, 1) - 1 AS para_pos, unnest(l) ->> '$' AS text FROM (SELECT *, json_extract(v, '$[*]') AS l FROM v WHERE json_type(v) = 'ARRAY') WHERE len(l) > 0"


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """The paragraphs of list sections as pages of lines."""
    rows = nested.flat_tables(read_table(spark, d, "fallos_json"), "paragraphs")["paragraphs"]
    return rows.where("variant = 'lista_texto'").select("file_id", "obj_pos", "section", "para_pos", "text")


@query(f"""
WITH {RULINGS_SQL}, pages AS ({_PAGES_SQL})
SELECT file_id, obj_pos::INT AS obj_pos, section, para_pos::INT AS para_pos,
  {_STRIP.format("array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '" + _NOISE + "')), chr(10))")} AS text
FROM pages WHERE text IS NOT NULL AND text NOT LIKE '{{%'
""")
def noise_line_filter(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).where("text not like '{%'").withColumn("text", T.drop_noise_lines(F.col("text")))


_ELEMENTS_SQL = """
SELECT file_id, obj_pos, i AS section_pos, k AS section, j AS para_pos, CASE WHEN json_type(e, '$.texto') = 'VARCHAR' THEN e ->> '$.texto' ELSE e ->> '$' END AS text
FROM (SELECT file_id, obj_pos, i, k, generate_subscripts(l, 1) - 1 AS j, unnest(l) AS e
      FROM (SELECT *, CASE WHEN json_type(v) = 'ARRAY' THEN json_extract(v, '$[*]') ELSE [v] END AS l FROM v)) WHERE json_type(e) <> 'NULL'
"""


@query(f"""
WITH {RULINGS_SQL}, pages AS ({_ELEMENTS_SQL})
SELECT file_id, obj_pos::INT AS obj_pos, section_pos::INT AS section_pos, section, para_pos::INT AS para_pos,
  {_STRIP.format("array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '" + _NOISE + "')), chr(10))")} AS text
FROM pages
""")
def noise_line_filter_all(spark: SparkSession, d: str) -> DataFrame:
    """The filter over every paragraph, bare strings, objects and mixed lists included; ``noise_line_filter`` has text lists only, as its SQL."""
    rows = nested.flat_tables(read_table(spark, d, "fallos_json"), "paragraphs")["paragraphs"].where("text is not null")
    return rows.select("file_id", "obj_pos", "section_pos", "section", "para_pos", T.drop_noise_lines(F.col("text")).alias("text"))


_STARTS = f"""
l AS (SELECT doc_id, pos, {_STRIP.format('line')} AS s FROM {_LINES}),
b AS (SELECT *, lag(s) OVER (PARTITION BY doc_id ORDER BY pos) AS p FROM l),
g AS (SELECT *, sum(CASE WHEN s <> '' AND (p IS NULL OR p = '' OR regexp_matches(p, '[.:?!;]$') OR (upper(s) = s AND lower(s) <> s AND s LIKE '%:' AND length(s) < 50)) THEN 1 ELSE 0 END)
      OVER (PARTITION BY doc_id ORDER BY pos) AS para FROM b)
"""


@query(f"""
WITH {_STARTS}
SELECT doc_id, (para - 1)::INT AS para_pos, string_agg(s, ' ' ORDER BY pos) AS text FROM g WHERE s <> '' GROUP BY doc_id, para
""")
def line_to_paragraph(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").select("doc_id", F.posexplode(T.join_lines(F.col("text"))).alias("para_pos", "text"))


@query(f"""
WITH l AS (SELECT doc_id, pos, {_STRIP.format('line')} AS s FROM {_LINES}),
k AS (SELECT *, (upper(s) = s AND lower(s) <> s AND s LIKE '%:' AND length(s) < 50) AS is_key FROM l),
g AS (SELECT *, max(CASE WHEN is_key THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos) AS at FROM k),
n AS (SELECT g.doc_id, g.pos, g.is_key, coalesce(rtrim(t.s, ':'), 'INICIO') AS section, g.s FROM g LEFT JOIN l t ON g.doc_id = t.doc_id AND g.at = t.pos)
SELECT doc_id, section, count(*) AS paragraphs, sum(length(s))::BIGINT AS chars FROM n WHERE NOT is_key GROUP BY doc_id, section
""")
def section_split(spark: SparkSession, d: str) -> DataFrame:
    rows = _lines(spark, d).withColumn("s", T.strip(F.col("line"))).withColumn("key", T.is_key_line(F.col("s")))
    title = F.last(F.when(F.col("key"), F.rtrim(F.col("s"), F.lit(":"))), True).over(Window.partitionBy("doc_id").orderBy("pos"))
    named = rows.withColumn("section", F.coalesce(title, F.lit("INICIO"))).where(~F.col("key"))
    return named.groupBy("doc_id", "section").agg(F.count("*").alias("paragraphs"), F.sum(F.length("s").cast("long")).alias("chars"))


@query(r"""
SELECT DISTINCT para_uid, upper(regexp_replace(regexp_extract(list_filter(regexp_extract_all('En autos "' || expediente || ' S/ ' || materia_preliminar || ' - legajo", y "otro"', '"([^"]+)"', 1),
  lambda q: regexp_matches(q, '(?i)S/\s*[^\-,]'))[1], '(?i)S/\s*([^\-,]+)', 1), '^\s+|\s+$', '', 'g')) AS subject
FROM paragraphs WHERE materia_preliminar IS NOT NULL AND expediente IS NOT NULL
""")
def subject_extract(spark: SparkSession, d: str) -> DataFrame:
    caption = F.concat(F.lit('En autos "'), "expediente", F.lit(" S/ "), "materia_preliminar", F.lit(' - legajo", y "otro"'))
    return read_table(spark, d, "paragraphs").where("materia_preliminar is not null and expediente is not null").select("para_uid", T.subject(caption).alias("subject")).distinct()


_PARAS = "(SELECT DISTINCT para_uid, expediente, section, paragraph_id, text, path, idea_central, materia_preliminar FROM paragraphs)"


def _paragraphs(spark: SparkSession, d: str, *more: str) -> DataFrame:
    """The paragraphs, exact repeats once."""
    rows = read_table(spark, d, "paragraphs").select("para_uid", "expediente", "section", "paragraph_id", "text", "path", "idea_central", "materia_preliminar", *more)
    return distinct_rows(rows, "para_uid")


@query(f"""
SELECT path, max(idea_central) || chr(10) || string_agg(text, chr(10) ORDER BY section, paragraph_id, para_uid) AS full_text
FROM {_PARAS} WHERE path IS NOT NULL AND text IS NOT NULL GROUP BY path
""")
def full_text_concat(spark: SparkSession, d: str) -> DataFrame:
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("section", F.lit("￿")).alias("s"), "paragraph_id", "para_uid", "text"))), lambda x: x["text"]), "\n")
    return _paragraphs(spark, d).where("path is not null and text is not null").groupBy("path").agg(F.concat(F.max("idea_central"), F.lit("\n"), texts).alias("full_text"))


@query(f"""
SELECT path, sum(length(text))::BIGINT AS original_chars, coalesce(max(length(idea_central)), 0)::BIGINT AS summary_chars,
  round((1 - coalesce(max(length(idea_central)), 0) / nullif(sum(length(text)), 0)) * 100, 2) AS reduction, count(DISTINCT section) AS sections
FROM {_PARAS} WHERE path IS NOT NULL GROUP BY path HAVING sum(length(trim(text))) >= 100
""")
def summary_metadata(spark: SparkSession, d: str) -> DataFrame:
    chars, short = F.sum(F.length("text").cast("long")), F.coalesce(F.max(F.length("idea_central").cast("long")), F.lit(0).cast("long"))
    rows = _paragraphs(spark, d).where("path is not null").groupBy("path").agg(chars.alias("original_chars"), short.alias("summary_chars"), F.countDistinct("section").alias("sections"), F.sum(F.length(F.trim("text"))).alias("t"))
    return rows.where("t >= 100").select("path", "original_chars", "summary_chars", F.round((1 - F.try_divide(F.col("summary_chars").cast("double"), F.col("original_chars").cast("double"))) * 100, 2).alias("reduction"), "sections")


@query("""
SELECT doc_id, k::INT AS pos, substr(text, k * 896 + 1, 1024) AS chunk
FROM (SELECT doc_id, text, unnest(generate_series(0, greatest(0, ceil((length(text) - 128) / 896.0)::INT - 1))) AS k FROM documents WHERE length(text) > 0)
""")
def chunk_fixed_window(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").select("doc_id", F.posexplode(T.windows(F.col("text"), 1024, 128)).alias("pos", "chunk"))


@query()
def chunk_recursive(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").select("doc_id", F.posexplode(K.recursive_chunks(F.col("text"))).alias("pos", "chunk"))


@query(r"""
SELECT doc_id, text AS cleaned, text <> raw AS modified FROM (SELECT doc_id, raw, """ + "".join(["regexp_replace("] * len(T.HEADINGS)) + "raw" + "".join(f", '(?m){p}', '', 'g')" for p in T.HEADINGS) + r""" AS text
FROM (SELECT doc_id, (CASE doc_id % 4 WHEN 0 THEN '**IDEA CENTRAL DEL FALLO**' || chr(10) || chr(10) WHEN 1 THEN '  **Decisión Judicial Principal:**' WHEN 2 THEN '### IDEA CENTRAL:' || chr(10) || chr(10) ELSE '' END) || text AS raw FROM documents WHERE text IS NOT NULL))
""")
def heading_cleanup(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("doc_id") % 4
    head = F.when(kind == 0, "**IDEA CENTRAL DEL FALLO**\n\n").when(kind == 1, "  **Decisión Judicial Principal:**").when(kind == 2, "### IDEA CENTRAL:\n\n").otherwise("")
    rows = read_table(spark, d, "documents").where("text is not null").select("doc_id", F.concat(head, "text").alias("raw")).withColumn("cleaned", T.clean_headings(F.col("raw")))
    return rows.select("doc_id", "cleaned", (F.col("cleaned") != F.col("raw")).alias("modified"))


@query("SELECT doc_id, CASE WHEN length(text) > 1000 THEN left(text, 1000) || '...' ELSE text END AS text FROM documents")
def truncate_gate(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").select("doc_id", T.cut(F.col("text"), 1000).alias("text"))


@query(f"SELECT para_uid, section, paragraph_id FROM {_PARAS} WHERE section IN ('ACUERDO', 'CONSIDERANDO', 'RESUELVE') AND paragraph_id % 2 = 0 AND length({_STRIP.format('text')}) > 20")
def alternate_gate(spark: SparkSession, d: str) -> DataFrame:
    keep = F.col("section").isin("ACUERDO", "CONSIDERANDO", "RESUELVE") & (F.col("paragraph_id") % 2 == 0) & (F.length(T.strip(F.col("text"))) > 20)
    return _paragraphs(spark, d).where(keep).select("para_uid", "section", "paragraph_id")


_REWRITE = "replace(text, 'art.', 'artículo')"


@query(f"""
SELECT para_uid, CASE WHEN length({_STRIP.format('new')}) > 10 THEN new ELSE text END AS text, coalesce(length({_STRIP.format('new')}) > 10, false) AS accepted
FROM (SELECT para_uid, text, CASE WHEN paragraph_id % 3 = 0 THEN '' ELSE {_REWRITE} END AS new FROM {_PARAS} WHERE text IS NOT NULL)
""")
def rewrite_accept(spark: SparkSession, d: str) -> DataFrame:
    new = F.when(F.col("paragraph_id") % 3 == 0, "").otherwise(F.replace("text", F.lit("art."), F.lit("artículo")))
    ok = F.length(T.strip(F.col("new"))) > 10
    return _paragraphs(spark, d).where("text is not null").withColumn("new", new).select("para_uid", F.when(ok, F.col("new")).otherwise(F.col("text")).alias("text"), F.coalesce(ok, F.lit(False)).alias("accepted"))


@query(f"""
SELECT para_uid, round(coalesce(length(new) / nullif(length(text), 0), 0), 6) AS length_change_ratio, text = new AS same_text,
  length(new) > 0 AND new <> text AND new NOT LIKE 'ERROR:%' AS success,
  CASE WHEN kind = 'formato_citas' THEN coalesce(length(new) / nullif(length(text), 0), 0) BETWEEN 0.8 AND 1.2 END AS expected_similar_length,
  CASE WHEN kind = 'redaccion_superficial' THEN coalesce(length(new) / nullif(length(text), 0), 0) > 0.7 END AS significant_rewrite,
  CASE WHEN kind = 'cambio_contenido' THEN text <> new END AS content_changed
FROM (SELECT para_uid, text, {_REWRITE} AS new, CASE paragraph_id % 3 WHEN 0 THEN 'formato_citas' WHEN 1 THEN 'redaccion_superficial' ELSE 'cambio_contenido' END AS kind FROM {_PARAS} WHERE text IS NOT NULL)
""")
def rewrite_validation(spark: SparkSession, d: str) -> DataFrame:
    which = F.col("paragraph_id") % 3
    kind = F.when(which == 0, "formato_citas").when(which == 1, "redaccion_superficial").otherwise("cambio_contenido")
    new = F.replace("text", F.lit("art."), F.lit("artículo"))
    checks = T.rewrite_checks(F.col("text"), F.col("new"), F.col("kind"))
    checks["length_change_ratio"] = F.round(checks["length_change_ratio"], 6)
    return _paragraphs(spark, d).where("text is not null").withColumn("new", new).withColumn("kind", kind).select("para_uid", *[c.alias(n) for n, c in checks.items()])


# ---- profiles -----------------------------------------------------------------------------------------------------

_SECTIONS = f"(SELECT path, count(DISTINCT section) AS n FROM {_PARAS} WHERE path IS NOT NULL GROUP BY path)"


@query(f"""
SELECT section, count(DISTINCT path) AS rulings, round(100.0 * count(DISTINCT path) / (SELECT count(*) FROM {_SECTIONS}), 2) AS pct,
  (SELECT min(n) FROM {_SECTIONS}) AS min_sections, (SELECT max(n) FROM {_SECTIONS}) AS max_sections, (SELECT round(avg(n), 6) FROM {_SECTIONS}) AS avg_sections
FROM {_PARAS} WHERE path IS NOT NULL AND section IS NOT NULL GROUP BY section
""")
def structure_profile(spark: SparkSession, d: str) -> DataFrame:
    rows = _paragraphs(spark, d).where("path is not null").select("path", "section").distinct()
    sizes = rows.groupBy("path").agg(F.count("section").alias("n")).agg(F.count("*").alias("all"), F.min("n").alias("min_sections"), F.max("n").alias("max_sections"), F.round(F.avg("n"), 6).alias("avg_sections"))
    counts = rows.where("section is not null").groupBy("section").agg(F.count("*").alias("rulings"))
    return counts.crossJoin(F.broadcast(sizes)).select("section", "rulings", F.round(100.0 * F.col("rulings") / F.col("all"), 2).alias("pct"), "min_sections", "max_sections", "avg_sections")  # sizes: one row


@query(f"SELECT expediente, count(*) AS chunks, count(DISTINCT section) AS sections FROM {_PARAS} GROUP BY expediente")
def chunks_per_source(spark: SparkSession, d: str) -> DataFrame:
    return _paragraphs(spark, d).groupBy("expediente").agg(F.count("*").alias("chunks"), F.countDistinct("section").alias("sections"))


@query(f"SELECT section, count(*) AS chunks FROM {_PARAS} GROUP BY section")
def chunks_per_section(spark: SparkSession, d: str) -> DataFrame:
    return _paragraphs(spark, d).groupBy("section").agg(F.count("*").alias("chunks"))


@query(f"SELECT count(DISTINCT expediente) AS rulings, count(*) AS chunks, count(DISTINCT section) AS sections FROM {_PARAS}")
def store_profile(spark: SparkSession, d: str) -> DataFrame:
    return _paragraphs(spark, d).agg(F.countDistinct("expediente").alias("rulings"), F.count("*").alias("chunks"), F.countDistinct("section").alias("sections"))


@query("SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, count(DISTINCT path) AS files FROM fallos_json GROUP BY 1")
def folder_counts(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "fallos_json").groupBy(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder")).agg(F.countDistinct("path").alias("files"))


@query("SELECT status, count(*) AS n FROM (SELECT CASE WHEN text IS NULL THEN 'error' WHEN length(trim(text)) < 100 THEN 'skipped' ELSE 'processed' END AS status FROM documents) GROUP BY status")
def job_status_counts(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("text").isNull(), "error").when(F.length(F.trim("text")) < 100, "skipped").otherwise("processed")
    return read_table(spark, d, "documents").groupBy(status.alias("status")).agg(F.count("*").alias("n"))


# ---- citations ----------------------------------------------------------------------------------------------------


def _mentions_sql(text: str) -> str:
    groups = ", ".join(f"regexp_extract_all({text}, '(?i){p}', {g})" for p, n in C.MENTIONS for g in range(1, n + 1))
    numbers = f"flatten(list_transform(flatten([{groups}]), lambda x: regexp_extract_all(x, '{C.NUMBER}')))"
    return f"list_sort(list_distinct({numbers}))"


@query(f"SELECT para_uid, array_to_string({_mentions_sql('text')}, ',') AS mentioned FROM {_PARAS} WHERE text IS NOT NULL")
def citation_extract(spark: SparkSession, d: str) -> DataFrame:
    return _paragraphs(spark, d).where("text is not null").select("para_uid", F.array_join(C.mentioned(F.col("text")), ",").alias("mentioned"))


@query(f"""
SELECT path, section, count(DISTINCT m) AS n, string_agg(DISTINCT m, ',' ORDER BY m) AS mentioned
FROM (SELECT path, section, unnest({_mentions_sql('text')}) AS m FROM {_PARAS} WHERE text IS NOT NULL) GROUP BY path, section
""")
def citations_per_section(spark: SparkSession, d: str) -> DataFrame:
    rows = _paragraphs(spark, d).where("text is not null").select("path", "section", F.explode(C.mentioned(F.col("text"))).alias("m"))
    return rows.groupBy("path", "section").agg(F.countDistinct("m").alias("n"), F.array_join(F.array_sort(F.collect_set("m")), ",").alias("mentioned"))


@query("""
SELECT id_fallo, count(*) AS verbatim, count(DISTINCT v) AS different, sum(length(v))::BIGINT AS chars
FROM (SELECT id_fallo, unnest(verbatim_citations) AS v FROM subsection_citations) WHERE v IS NOT NULL AND trim(v) <> '' GROUP BY id_fallo
""")
def verbatim_per_ruling(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "subsection_citations").select("id_fallo", F.explode("verbatim_citations").alias("v")).where("v is not null and trim(v) <> ''")
    return rows.groupBy("id_fallo").agg(F.count("*").alias("verbatim"), F.countDistinct("v").alias("different"), F.sum(F.length("v").cast("long")).alias("chars"))


_CITED = "(SELECT DISTINCT cit_id, id_fallo, main_source, cited_articles, extra FROM ruling_citations)"
_FREQ = f"""
l AS (SELECT main_source AS source, unnest(CASE WHEN len(cited_articles) = 0 THEN [NULL::INT] ELSE cited_articles END) AS article FROM {_CITED} WHERE main_source IS NOT NULL AND cited_articles IS NOT NULL),
n AS (SELECT source, article, count(article) AS n FROM l GROUP BY source, article)
"""


def _citations(spark: SparkSession, d: str) -> DataFrame:
    """The citations, exact repeats once."""
    return read_table(spark, d, "ruling_citations").select("cit_id", "id_fallo", "main_source", "cited_articles", "extra").distinct()


@query(f"WITH {_FREQ} SELECT source, coalesce(article::VARCHAR, '') AS article, n FROM (SELECT *, sum(n) OVER (PARTITION BY source) AS t FROM n) WHERE article IS NOT NULL OR t = 0")
def citation_frequency(spark: SparkSession, d: str) -> DataFrame:
    return C.frequency(_citations(spark, d)).withColumn("article", F.coalesce(F.col("article").cast("string"), F.lit("")))


@query(f"WITH {_FREQ} SELECT source, sum(n)::BIGINT AS total FROM n GROUP BY source")
def source_totals(spark: SparkSession, d: str) -> DataFrame:
    return C.frequency(_citations(spark, d)).groupBy("source").agg(F.sum("n").alias("total"))


@query(f"SELECT main_source, count(*) AS n FROM {_CITED} WHERE main_source IS NOT NULL GROUP BY main_source ORDER BY n DESC, main_source LIMIT 10")
def source_top10(spark: SparkSession, d: str) -> DataFrame:
    return _citations(spark, d).where("main_source is not null").groupBy("main_source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "main_source").limit(10)


@query(f"SELECT count(DISTINCT main_source) AS sources, count(*) AS citations FROM {_CITED} WHERE trim(main_source) <> ''")
def source_profile(spark: SparkSession, d: str) -> DataFrame:
    return _citations(spark, d).where("trim(main_source) <> ''").agg(F.countDistinct("main_source").alias("sources"), F.count("*").alias("citations"))


_STRUCTURED = r"""
q AS (SELECT id_fallo, unnest(verbatim_citations) AS v FROM subsection_citations WHERE id_fallo IS NOT NULL),
n AS (SELECT lower(canonical_name) AS name, canonical_name AS listed FROM fuentes_ref UNION SELECT lower(short_name), canonical_name FROM fuentes_ref WHERE short_name <> ''),
d AS (SELECT DISTINCT v FROM q WHERE v IS NOT NULL),
m AS (SELECT v, max({'size': length(name), 'name': name, 'listed': listed})['listed'] AS main_source FROM d JOIN n ON contains(lower(v), name) GROUP BY v),
a AS (SELECT v, list_distinct(regexp_extract_all(regexp_extract(lower(v), '\bart[a-zí]*\.?\s*((?:\d+\s*[°º]?\s*(?:,|;|y|e|/|-)?\s*)+)', 1), '\d{1,9}')::INT[]) AS articles FROM d),
r AS (SELECT id_fallo, v, main_source, articles FROM q JOIN a USING (v) LEFT JOIN m USING (v))
"""


@query(rf"""
WITH {_STRUCTURED}
SELECT id_fallo, main_source, array_to_string(list_sort(list_distinct(flatten(list(articles)))), ',') AS articles, count(*) AS n_verbatim FROM r WHERE main_source IS NOT NULL GROUP BY id_fallo, main_source
""")
def citation_structuring(spark: SparkSession, d: str) -> DataFrame:
    known, _ = documents.structured_citations(_quotations(spark, d), "id_fallo", "v", read_table(spark, d, "fuentes_ref"))
    return known.select("id_fallo", "main_source", F.array_join(F.col("cited_articles").cast("array<string>"), ",").alias("articles"), "n_verbatim")


@query(rf"WITH {_STRUCTURED} SELECT id_fallo, v FROM r WHERE main_source IS NULL")
def citation_orphans(spark: SparkSession, d: str) -> DataFrame:
    return documents.structured_citations(_quotations(spark, d), "id_fallo", "v", read_table(spark, d, "fuentes_ref"))[1]


def _quotations(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "subsection_citations").select("id_fallo", F.explode("verbatim_citations").alias("v"))


@query(f"""
WITH e AS (SELECT id_fallo, main_source AS s, unnest(CASE WHEN len(coalesce(cited_articles, [])) = 0 THEN [NULL::INT] ELSE cited_articles END) AS a, extra AS e FROM {_CITED} WHERE main_source IS NOT NULL),
m AS (SELECT id_fallo, CASE WHEN s = 'Otro' AND a IN (28, 29, 114) THEN 'Ley 7046' WHEN s = 'Otro' AND a = 33 THEN 'Ley 10.704' ELSE s END AS t, s, a, e FROM e),
k AS (SELECT id_fallo, t AS main_source, a, CASE WHEN t = s THEN e END AS e FROM m UNION ALL SELECT id_fallo, s, NULL, e FROM e WHERE s = 'Otro')
SELECT id_fallo, main_source, coalesce(array_to_string(list_sort(list_distinct(list(a) FILTER (WHERE a IS NOT NULL))), ','), '') AS articles,
  coalesce(array_to_string(list_sort(list_distinct(list(e) FILTER (WHERE e IS NOT NULL))), '|'), '') AS extras
FROM k GROUP BY id_fallo, main_source HAVING main_source <> 'Otro' OR count(a) > 0
""")
def citation_normalize(spark: SparkSession, d: str) -> DataFrame:
    rows = C.normalize(_citations(spark, d), "id_fallo")
    return rows.select("id_fallo", "main_source", F.array_join(F.col("articles").cast("array<string>"), ",").alias("articles"), F.array_join("extras", "|").alias("extras"))


@query(f"""
SELECT cit_id, CASE WHEN len(cited_articles) > 0 THEN '**"' || nullif(trim(main_source), '') || '"** ' || (CASE WHEN len(cited_articles) = 1 THEN 'artículo' ELSE 'artículos' END) || ' ' || array_to_string(cited_articles, ', ') || '.'
  ELSE '**"' || nullif(trim(main_source), '') || '"**.' END AS line FROM {_CITED}
""")
def citation_format(spark: SparkSession, d: str) -> DataFrame:
    return _citations(spark, d).select("cit_id", C.bullet(F.col("main_source"), F.col("cited_articles")).alias("line"))


# ---- joins --------------------------------------------------------------------------------------------------------

_IDEAS = "(SELECT metadatos.id_fallo AS id_fallo, max(idea_central) AS idea, max(materia_preliminar) AS materia FROM paragraphs WHERE metadatos.id_fallo IS NOT NULL GROUP BY 1)"


def _ideas(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "paragraphs").where("metadatos.id_fallo is not null")
    return rows.groupBy(F.col("metadatos.id_fallo").alias("id_fallo")).agg(F.max("idea_central").alias("idea"), F.max("materia_preliminar").alias("materia"))


@query(f"""
SELECT r.id_fallo, coalesce(i.idea, '') AS idea, coalesce(i.materia, '') AS materia, coalesce(v.n, 0) AS verbatim, r.n AS citations
FROM (SELECT id_fallo, count(*) AS n FROM {_CITED} WHERE id_fallo IS NOT NULL GROUP BY 1) r
LEFT JOIN {_IDEAS} i USING (id_fallo) LEFT JOIN (SELECT id_fallo, count(*) AS n FROM subsection_citations WHERE id_fallo IS NOT NULL GROUP BY 1) v USING (id_fallo)
""")
def unify_left_join(spark: SparkSession, d: str) -> DataFrame:
    rulings = _citations(spark, d).where("id_fallo is not null").groupBy("id_fallo").agg(F.count("*").alias("citations"))
    verbatim = read_table(spark, d, "subsection_citations").where("id_fallo is not null").groupBy("id_fallo").agg(F.count("*").alias("verbatim"))
    out = rulings.join(_ideas(spark, d), "id_fallo", "left").join(verbatim, "id_fallo", "left")
    return out.select("id_fallo", F.coalesce("idea", F.lit("")).alias("idea"), F.coalesce("materia", F.lit("")).alias("materia"), F.coalesce("verbatim", F.lit(0).cast("long")).alias("verbatim"), "citations")


@query(f"""
SELECT id_fallo, i.idea IS NOT NULL AS original, v.n IS NOT NULL AS modified, coalesce(v.n, 0) AS n
FROM {_IDEAS} i FULL JOIN (SELECT id_fallo, count(*) AS n FROM subsection_citations WHERE id_fallo IS NOT NULL GROUP BY 1) v USING (id_fallo)
""")
def paired_report(spark: SparkSession, d: str) -> DataFrame:
    verbatim = read_table(spark, d, "subsection_citations").where("id_fallo is not null").groupBy("id_fallo").agg(F.count("*").alias("n"))
    return _ideas(spark, d).join(verbatim, "id_fallo", "full").select("id_fallo", F.col("idea").isNotNull().alias("original"), F.col("n").isNotNull().alias("modified"), F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@query(f"SELECT id_fallo, idea FROM {_IDEAS} WHERE id_fallo IN (SELECT id_fallo FROM subsection_citations WHERE id_fallo IS NOT NULL)")
def originals_semi(spark: SparkSession, d: str) -> DataFrame:
    return _ideas(spark, d).join(read_table(spark, d, "subsection_citations").where("id_fallo is not null"), "id_fallo", "left_semi").select("id_fallo", "idea")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings WHERE vec_id IS NOT NULL)")
def resume_anti(spark: SparkSession, d: str) -> DataFrame:
    done = read_table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return files.missing(read_table(spark, d, "documents").select("doc_id", "source"), done, "doc_id")


@query("""
SELECT 'both' AS side, count(*) AS n FROM (SELECT id_fallo FROM ruling_citations WHERE id_fallo IS NOT NULL INTERSECT SELECT id_fallo FROM votos WHERE id_fallo IS NOT NULL)
UNION ALL SELECT 'citations', count(*) FROM (SELECT id_fallo FROM ruling_citations WHERE id_fallo IS NOT NULL EXCEPT SELECT id_fallo FROM votos)
UNION ALL SELECT 'votes', count(*) FROM (SELECT id_fallo FROM votos WHERE id_fallo IS NOT NULL EXCEPT SELECT id_fallo FROM ruling_citations WHERE id_fallo IS NOT NULL)
""")
def table_set_operations(spark: SparkSession, d: str) -> DataFrame:
    a = read_table(spark, d, "ruling_citations").where("id_fallo is not null").select("id_fallo")
    b = read_table(spark, d, "votos").where("id_fallo is not null").select("id_fallo")
    count = lambda df, side: df.agg(F.count("*").alias("n")).select(F.lit(side).alias("side"), "n")
    return count(a.intersect(b), "both").unionByName(count(a.subtract(b), "citations")).unionByName(count(b.subtract(a), "votes"))


# ---- search -------------------------------------------------------------------------------------------------------


def _tokens_sql(text: str, mode: str = "raw") -> str:
    keep = "x <> ''" if mode == "raw" else "length(x) > 2 AND length(x) < 20"
    return rf"list_filter(regexp_split_to_array({text if mode == 'raw' else f'lower({text})'}, '\s+'), lambda x: {keep})"


_QUESTIONS = "(SELECT item_id AS qid, text AS question, question_type FROM eval_items WHERE item_id % 20 = 0)"


def _questions(spark: SparkSession, d: str) -> DataFrame:
    """The question set of a search."""
    return read_table(spark, d, "eval_items").where("item_id % 20 = 0").select(F.col("item_id").alias("qid"), F.col("text").alias("question"), "question_type")


def _bm25_sql(documents: str, mode: str = "raw") -> str:
    return f"""
docs AS (SELECT key, {_tokens_sql('text', mode)} AS words FROM {documents} WHERE text IS NOT NULL),
corpus AS (SELECT count(*) AS n, avg(len(words)) AS avgdl FROM docs),
tf AS (SELECT key, term, count(*) AS tf FROM (SELECT key, unnest(words) AS term FROM docs) GROUP BY key, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
raw AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM df, corpus),
terms AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
asked AS (SELECT qid, term, count(*) AS times FROM (SELECT qid, unnest({_tokens_sql('lower(question)', mode)}) AS term FROM {_QUESTIONS}) GROUP BY qid, term),
bm AS (SELECT qid, key, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(words) / avgdl))), 6) AS score
       FROM tf JOIN terms USING (term) JOIN asked USING (term) JOIN docs USING (key), corpus GROUP BY qid, key),
lex AS (SELECT * FROM (SELECT qid, key, coalesce(score, 0) AS score, row_number() OVER (PARTITION BY qid ORDER BY coalesce(score, 0) DESC, key) AS rank
        FROM (SELECT qid, key FROM (SELECT DISTINCT qid FROM asked), docs) LEFT JOIN bm USING (qid, key)) WHERE rank <= 30)
"""


_DOCS = "(SELECT doc_id AS key, text FROM documents)"
_PARA_DOCS = "(SELECT DISTINCT para_uid AS key, text FROM paragraphs)"


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").select(F.col("doc_id").alias("key"), "text")


def _lexical(spark: SparkSession, d: str, mode: str = "raw") -> DataFrame:
    index = search.lexical_index(_documents(spark, d), "key", "text", mode)
    return search.lexical_top(index, search.question_terms(_questions(spark, d), "question", mode))


@query(f"WITH {_bm25_sql(_DOCS)} SELECT n, round(avgdl, 6) AS avgdl, (SELECT count(*) FROM terms) AS terms, (SELECT count(*) FROM tf) AS postings FROM corpus")
def token_stats(spark: SparkSession, d: str) -> DataFrame:
    index = search.lexical_index(_documents(spark, d), "key", "text")
    terms, postings = index["terms"].agg(F.count("*").alias("terms")), index["postings"].agg(F.count("*").alias("postings"))
    return index["corpus"].crossJoin(terms).crossJoin(postings).select("n", F.round("avgdl", 6).alias("avgdl"), "terms", "postings")  # three single rows


@query(f"WITH {_bm25_sql(_DOCS)} SELECT term, df, round(idf, 6) AS idf FROM terms")
def bm25_term_stats(spark: SparkSession, d: str) -> DataFrame:
    return search.lexical_index(_documents(spark, d), "key", "text")["terms"].select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {_bm25_sql(_DOCS)} SELECT qid, key, score, rank::INT AS rank FROM lex")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return _lexical(spark, d).select("qid", "key", "score", "rank")


@query(f"WITH {_bm25_sql(_DOCS, 'normalized')} SELECT qid, key, score, rank::INT AS rank FROM lex")
def bm25_tokenizer_filtered(spark: SparkSession, d: str) -> DataFrame:
    return _lexical(spark, d, "normalized").select("qid", "key", "score", "rank")


_POINTS = "(SELECT vec_id AS key, embedding::DOUBLE[] AS p FROM embeddings WHERE embedding IS NOT NULL)"
_VECTOR_QUESTIONS = "(SELECT vec_id AS qid, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 20 = 0)"


def _points(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "embeddings").where("embedding is not null").select(F.col("vec_id").alias("key"), "embedding", "label")


def _vector_questions(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "embedding")


def _dense_sql(measure: str, k: int, order: str) -> str:
    return f"""
sim AS (SELECT qid, key, round({measure}, 6) AS score FROM {_POINTS}, {_VECTOR_QUESTIONS}),
den AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score {order}, key) AS rank FROM sim) WHERE rank <= {k})"""


_COSINE_SQL = _dense_sql("list_cosine_similarity(p, q)", 30, "DESC")


@query(f"WITH {_COSINE_SQL} SELECT qid, key, score, rank::INT AS rank FROM den")
def dense_topk_batch(spark: SparkSession, d: str) -> DataFrame:
    return search.dense_top(_vector_questions(spark, d), _points(spark, d)).select("qid", "key", "score", "rank")


@query(f"""
WITH {_COSINE_SQL} SELECT qid, key, score, expediente AS expte, source AS section, text AS paragraph
FROM den JOIN documents ON key = doc_id WHERE rank <= 8
""")
def dense_only_hits(spark: SparkSession, d: str) -> DataFrame:
    top = search.dense_top(_vector_questions(spark, d), _points(spark, d), 8)
    docs = read_table(spark, d, "documents").select(F.col("doc_id").alias("key"), F.col("expediente").alias("expte"), F.col("source").alias("section"), F.col("text").alias("paragraph"))
    return top.join(docs, "key").select("qid", "key", "score", "expte", "section", "paragraph")


@query(f"WITH {_dense_sql('list_distance(p, q)', 5, 'ASC')} SELECT qid, key, score, rank::INT AS rank FROM den")
def l2_topk(spark: SparkSession, d: str) -> DataFrame:
    return search.nearest(_vector_questions(spark, d), _points(spark, d)).select("qid", "key", "score", "rank")


# An item's dense side is the vector of the document with its id.
_HYBRID_SQL = f"""
{_bm25_sql(_DOCS)},
sim AS (SELECT q.vec_id AS qid, p.vec_id AS key, round(list_cosine_similarity(p.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score
        FROM embeddings p, embeddings q WHERE q.vec_id IN (SELECT qid FROM {_QUESTIONS}) AND p.vec_id IN (SELECT key FROM docs)),
den AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, key) AS rank FROM sim) WHERE rank <= 30),
fused AS (SELECT qid, key, coalesce(d.score, x.score) + coalesce(x.score * 0.5, 0) AS score, d.score IS NOT NULL AS in_dense, x.score IS NOT NULL AS in_lexical
          FROM den d FULL JOIN lex x USING (qid, key))
"""


def _asked(spark: SparkSession, d: str) -> DataFrame:
    vectors = read_table(spark, d, "embeddings").select(F.col("vec_id").alias("qid"), "embedding")
    return _questions(spark, d).join(vectors, "qid", "left")


def _fused(spark: SparkSession, d: str) -> DataFrame:
    docs = _documents(spark, d).where("text is not null")
    points = _points(spark, d).join(docs.select("key"), "key", "left_semi")
    asked = _asked(spark, d)
    return search.fuse(search.dense_top(asked.where("embedding is not null"), points), _lexical(spark, d))


@query(f"WITH {_HYBRID_SQL} SELECT qid, key, score, in_dense, in_lexical, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, key) AS rank FROM fused) WHERE rank <= 8")
def hybrid_fusion(spark: SparkSession, d: str) -> DataFrame:
    return search.best(_fused(spark, d), 8).select("qid", "key", "score", "in_dense", "in_lexical", "rank")


_OVERLAP_SQL = f"round(coalesce(len(list_intersect(list_distinct({_tokens_sql('lower(question)')}), {_tokens_sql('lower(left(text, 500))')})) / nullif(len(list_distinct({_tokens_sql('lower(question)')})), 0), 0), 6)"


@query(f"""
WITH {_HYBRID_SQL},
re AS (SELECT qid, key, {_OVERLAP_SQL} AS score FROM fused JOIN documents ON key = doc_id JOIN {_QUESTIONS} USING (qid))
SELECT qid, key, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, key) AS rank FROM re) WHERE rank <= 8
""")
def hybrid_rerank_overlap(spark: SparkSession, d: str) -> DataFrame:
    rows = _fused(spark, d).join(_documents(spark, d), "key").join(_questions(spark, d), "qid")
    rescored = rows.select("qid", "key", search.overlap_rerank(F.col("question"), F.col("text")).alias("score"))
    return search.best(rescored, 8).select("qid", "key", "score", "rank")


@query(f"WITH {_HYBRID_SQL} SELECT qid, key, source, lang, text FROM fused JOIN documents ON key = doc_id")
def payload_lookup(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents").select(F.col("doc_id").alias("key"), "source", "lang", "text")
    return _fused(spark, d).join(docs, "key").select("qid", "key", "source", "lang", "text")


# ---- hits on paragraphs, groups and contexts ----------------------------------------------------------------------

_HITS = f"""
{_bm25_sql(_PARA_DOCS)},
meta AS (SELECT para_uid AS key, any_value(expediente) AS expediente, any_value(section) AS section, any_value(text) AS paragraph, any_value(path) AS path, any_value(idea_central) AS idea_central,
         any_value(materia_preliminar) AS materia_preliminar, any_value(articulos_citados) AS articulos_citados FROM paragraphs GROUP BY 1),
hits AS (SELECT qid, rank, score, meta.* FROM lex JOIN meta USING (key) WHERE rank <= 8)
"""


def _hits(spark: SparkSession, d: str) -> DataFrame:
    """The eight best paragraphs of each question with their metadata; text is joined after ranking."""
    rows = _paragraphs(spark, d, "articulos_citados")
    index = search.lexical_index(rows.select(F.col("para_uid").alias("key"), "text"), "key", "text")
    top = search.bm25_top(index, search.question_terms(_questions(spark, d)), 8)
    return top.join(rows.withColumnsRenamed({"para_uid": "key", "text": "paragraph"}), "key")


@query(f"""
WITH {_HITS}
SELECT qid, coalesce(expediente, 'N/A') AS expte, min(rank)::INT AS first_rank, arg_min(coalesce(idea_central, '-'), rank) AS idea_central, arg_min(coalesce(materia_preliminar, '-'), rank) AS materia_preliminar,
  count(*) AS n_hits, string_agg(coalesce(section, ''), '|' ORDER BY rank) AS sections,
  len(list_distinct(flatten(list(coalesce(articulos_citados, []) ORDER BY rank)))) AS n_cited
FROM hits GROUP BY 1, 2
""")
def group_hits(spark: SparkSession, d: str) -> DataFrame:
    grouped = answers.group_hits(_hits(spark, d))
    sections = F.array_join(F.transform("hits", lambda h: F.coalesce(h["section"], F.lit(""))), "|")
    return grouped.select("qid", "expte", "first_rank", "idea_central", "materia_preliminar", F.size("hits").cast("long").alias("n_hits"), sections.alias("sections"), F.size("articulos_citados").cast("long").alias("n_cited"))


@query(f"""
WITH {_HITS}, g AS (SELECT qid, coalesce(expediente, 'N/A') AS expte, count(*) AS n_hits, count(DISTINCT section) AS n_sections, count(DISTINCT path) AS n_paths, round(avg(score), 6) AS mean_score FROM hits GROUP BY 1, 2)
SELECT *, row_number() OVER (PARTITION BY qid ORDER BY mean_score DESC, expte)::INT AS place FROM g
""")
def ui_group_mean_score(spark: SparkSession, d: str) -> DataFrame:
    return answers.by_mean_score(_hits(spark, d))


@query(f"""
WITH {_HITS}
SELECT qid, coalesce(expediente, 'N/A') AS expte, (row_number() OVER (PARTITION BY qid, coalesce(expediente, 'N/A') ORDER BY rank) - 1)::INT AS pos,
  coalesce(section, '') AS section, coalesce(paragraph, '') AS paragraph, coalesce(path, '') AS path, score FROM hits
""")
def flatten_hits(spark: SparkSession, d: str) -> DataFrame:
    return answers.flatten_hits(answers.group_hits(_hits(spark, d)))


@query(f"""
WITH {_HITS}
SELECT qid, rank::INT AS n, coalesce(expediente, 'N/A') AS expte, CASE WHEN length(coalesce(section, 'N/A')) > 50 THEN left(section, 50) || '...' ELSE coalesce(section, 'N/A') END AS seccion,
  CASE WHEN length(paragraph) > 100 THEN left(paragraph, 100) || '...' ELSE coalesce(paragraph, 'N/A') END AS extracto, round(score, 2) AS score FROM hits
""")
def display_projection(spark: SparkSession, d: str) -> DataFrame:
    return answers.display(_hits(spark, d))


_SNIP = "CASE WHEN length(paragraph) > 300 THEN left(paragraph, 300) || '...' ELSE paragraph END"


@query(f"WITH {_HITS} SELECT qid, string_agg('[' || coalesce(expediente, 'N/A') || ' §' || coalesce(section, 'N/A') || ']: ' || {_SNIP}, chr(10) ORDER BY rank) AS context FROM hits GROUP BY qid")
def context_flat(spark: SparkSession, d: str) -> DataFrame:
    return answers.context_flat(_hits(spark, d))


_LINE = f"replace({_STRIP.format('paragraph')}, chr(10), ' ')"


@query(f"""
WITH {_HITS},
h AS (SELECT *, coalesce(expediente, 'N/A') AS expte, 'DETALLE §' || coalesce(section, 'N/A') || ': ' || (CASE WHEN length({_LINE}) > 300 THEN left({_LINE}, 300) || '…' ELSE {_LINE} END) AS detail FROM hits),
a AS (SELECT qid, expte, c, min(rank * 1000 + nth) AS o FROM (SELECT qid, expte, rank, unnest(articulos_citados) AS c, generate_subscripts(articulos_citados, 1) AS nth FROM h) GROUP BY qid, expte, c),
t AS (SELECT qid, expte, string_agg(coalesce(c.main_source, '') || ' ' || array_to_string(coalesce(c.cited_articles, []), ', '), ', ' ORDER BY o) AS cited FROM a GROUP BY qid, expte),
g AS (SELECT qid, expte, min(rank) AS o, '===== FALLO ' || expte || ' =====' || chr(10) || 'GENERAL: Materia: ' || arg_min(coalesce(materia_preliminar, '-'), rank) || '; Artículos: ' || coalesce(any_value(cited), '-')
      || '; Idea: ' || arg_min(coalesce(idea_central, '-'), rank) || chr(10) || string_agg(detail, chr(10) ORDER BY rank) || chr(10) AS block FROM h LEFT JOIN t USING (qid, expte) GROUP BY qid, expte)
SELECT qid, string_agg(block, chr(10) ORDER BY o, expte) AS context FROM g GROUP BY qid
""")
def context_grouped(spark: SparkSession, d: str) -> DataFrame:
    return answers.context_grouped(answers.group_hits(_hits(spark, d)))


@query(f"WITH {_HITS} SELECT qid, string_agg('[' || coalesce(expediente, 'N/A') || ']: ' || left(paragraph, 200) || '...', chr(10) ORDER BY rank) AS context FROM hits GROUP BY qid")
def context_chat(spark: SparkSession, d: str) -> DataFrame:
    return answers.context_chat(_hits(spark, d))


@query(f"""
WITH {_HITS} SELECT qid, string_agg(chr(10) || 'Documento ' || rank || ':' || chr(10) || 'Fuente: ' || coalesce(path, 'N/A') || chr(10) || 'Sección: ' || coalesce(section, 'N/A') || chr(10) || 'Contenido: ' || {_STRIP.format('paragraph')} || chr(10), chr(10) ORDER BY rank) AS context
FROM hits GROUP BY qid
""")
def context_documents(spark: SparkSession, d: str) -> DataFrame:
    return answers.context_documents(_hits(spark, d))


_BOOST_SQL = f"""
WITH {_HITS},
q AS (SELECT qid, lower(question) AS q FROM {_QUESTIONS}),
c AS (SELECT qid, key, count(*) AS n FROM (SELECT qid, key, c, unnest(c.cited_articles) AS a FROM (SELECT qid, key, unnest(articulos_citados) AS c FROM hits)) JOIN q USING (qid)
      WHERE contains(q, a::VARCHAR) OR contains(q, lower(coalesce(c.main_source, ''))) GROUP BY qid, key)
SELECT qid, key, round(score + coalesce(c.n, 0) * 0.3 + (CASE WHEN materia_preliminar <> '' AND contains(q, lower(materia_preliminar)) THEN 0.1 ELSE 0 END)
  + (CASE WHEN idea_central <> '' AND len(list_filter({_tokens_sql('q')}, lambda w: contains(lower(idea_central), w))) > 0 THEN 0.2 ELSE 0 END), 6) AS score
FROM hits JOIN q USING (qid) LEFT JOIN c USING (qid, key)
"""


@query(_BOOST_SQL)
def hybrid_enriched_boost(spark: SparkSession, d: str) -> DataFrame:
    rows = _hits(spark, d).join(_questions(spark, d), "qid")
    gain = search.boost(F.col("question"), F.col("articulos_citados"), F.col("materia_preliminar"), F.col("idea_central"))
    return rows.select("qid", "key", F.round(F.col("score") + gain, 6).alias("score"))


_MARKDOWN_SQL = "'Ver [' || doc_id || '] «' || left(coalesce(text, ''), 40) || '» y [' || doc_id % 7 || ']  «breve» y [' || doc_id || '] « otra »'"


@query(rf"""
WITH m AS (SELECT doc_id, {_MARKDOWN_SQL} AS markdown FROM documents),
x AS (SELECT doc_id, unnest(regexp_extract_all(markdown, '\[(\d+)\]\s+«([^»]+)»', 1)) AS expte, unnest(regexp_extract_all(markdown, '\[(\d+)\]\s+«([^»]+)»', 2)) AS s,
      generate_subscripts(regexp_extract_all(markdown, '\[(\d+)\]\s+«([^»]+)»', 1), 1) AS p FROM m)
SELECT doc_id, expte, {_STRIP.format('arg_max(s, p)')} AS summary FROM x GROUP BY doc_id, expte
""")
def summary_regex(spark: SparkSession, d: str) -> DataFrame:
    no = F.col("doc_id").cast("string")
    markdown = F.concat(F.lit("Ver ["), no, F.lit("] «"), F.left(F.coalesce("text", F.lit("")), F.lit(40)), F.lit("» y ["), (F.col("doc_id") % 7).cast("string"), F.lit("]  «breve» y ["), no, F.lit("] « otra »"))
    return answers.summaries(read_table(spark, d, "documents").select("doc_id", markdown.alias("markdown")), "doc_id", "markdown")


# A model's answer that sums up the first four hits; rulings are called by the digits of their file.
_DIGITS = r"regexp_replace(coalesce(expediente, ''), '\D', '', 'g')"


@query(rf"""
WITH {_HITS},
g AS (SELECT qid, {_DIGITS} AS expte, min(rank)::INT AS first_rank, count(*) AS n_hits FROM hits GROUP BY 1, 2),
s AS (SELECT qid, {_DIGITS} AS expte, arg_max(section, rank) AS summary FROM hits WHERE rank <= 4 AND section <> '' AND {_DIGITS} <> '' GROUP BY 1, 2)
SELECT qid, expte, first_rank, n_hits, coalesce(summary, '') AS llm_summary FROM g LEFT JOIN s USING (qid, expte)
""")
def grouped_with_summaries(spark: SparkSession, d: str) -> DataFrame:
    hits = materialize(_hits(spark, d).withColumn("expediente", F.regexp_replace(F.coalesce("expediente", F.lit("")), r"\D", "")))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rank", F.concat(F.lit("["), "expediente", F.lit("] «"), "section", F.lit("»")).alias("l")))), lambda x: x["l"])
    markdown = hits.where("rank <= 4").groupBy("qid").agg(F.array_join(lines, "\n").alias("markdown"))
    grouped = answers.group_hits(hits).select("qid", "expte", "first_rank", F.size("hits").cast("long").alias("n_hits"))
    return answers.with_summaries(grouped, answers.summaries(markdown, "qid", "markdown"))


# Dense and lexical candidates among the paragraphs, all of them raised by their metadata before the cut.
_ENRICHED = f"""
{_bm25_sql(_PARA_DOCS)},
sim AS (SELECT q.vec_id AS qid, p.vec_id AS key, round(list_cosine_similarity(p.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score
        FROM embeddings p, embeddings q WHERE q.vec_id IN (SELECT qid FROM {_QUESTIONS}) AND p.vec_id IN (SELECT key FROM docs)),
den AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, key) AS rank FROM sim) WHERE rank <= 30),
meta AS (SELECT para_uid AS key, any_value(text) AS text, any_value(idea_central) AS idea_central, any_value(materia_preliminar) AS materia_preliminar, any_value(articulos_citados) AS articulos_citados FROM paragraphs GROUP BY 1),
f AS (SELECT qid, key, coalesce(d.score, x.score) + coalesce(x.score * 0.5, 0) AS score FROM den d FULL JOIN lex x USING (qid, key)),
h AS (SELECT f.*, meta.* EXCLUDE (key), question, lower(question) AS q FROM f JOIN meta USING (key) JOIN {_QUESTIONS} USING (qid)),
c AS (SELECT qid, key, count(*) AS n FROM (SELECT qid, key, q, c, unnest(c.cited_articles) AS a FROM (SELECT qid, key, q, unnest(articulos_citados) AS c FROM h))
      WHERE contains(q, a::VARCHAR) OR contains(q, lower(coalesce(c.main_source, ''))) GROUP BY qid, key),
boosted AS (SELECT qid, key, round(score + coalesce(c.n, 0) * 0.3 + (CASE WHEN materia_preliminar <> '' AND contains(q, lower(materia_preliminar)) THEN 0.1 ELSE 0 END)
  + (CASE WHEN idea_central <> '' AND len(list_filter({_tokens_sql('q')}, lambda w: contains(lower(idea_central), w))) > 0 THEN 0.2 ELSE 0 END), 6) AS score, text, question FROM h LEFT JOIN c USING (qid, key))
"""


def _enriched(spark: SparkSession, d: str) -> DataFrame:
    rows = _paragraphs(spark, d, "articulos_citados").withColumnRenamed("para_uid", "key")
    texts = rows.select("key", "text").where("text is not null")
    points = _points(spark, d).join(texts.select("key"), "key", "left_semi")
    index = search.lexical_index(texts, "key", "text")
    fused = search.fuse(search.dense_top(_asked(spark, d).where("embedding is not null"), points), search.lexical_top(index, search.question_terms(_questions(spark, d))))
    held = fused.join(rows, "key").join(_questions(spark, d), "qid")
    gain = search.boost(F.col("question"), F.col("articulos_citados"), F.col("materia_preliminar"), F.col("idea_central"))
    return held.withColumn("score", F.round(F.col("score") + gain, 6))


@query(f"WITH {_ENRICHED} SELECT qid, key, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, key) AS rank FROM boosted) WHERE rank <= 8")
def hybrid_enriched(spark: SparkSession, d: str) -> DataFrame:
    return search.best(_enriched(spark, d).select("qid", "key", "score"), 8)


@query(f"WITH {_ENRICHED}, re AS (SELECT qid, key, {_OVERLAP_SQL} AS score FROM boosted) SELECT qid, key, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, key) AS rank FROM re) WHERE rank <= 8")
def hybrid_enriched_reranked(spark: SparkSession, d: str) -> DataFrame:
    return search.best(_enriched(spark, d).select("qid", "key", search.overlap_rerank(F.col("question"), F.col("text")).alias("score")), 8)


@query(r"""
SELECT doc_id, kind AS question_type, (n + 1)::INT AS question_no, '¿' || ['Qué se resolvió sobre', 'Con qué fundamento', 'Qué normas rigen'][n + 1] || ' casos como este?' AS question
FROM documents, (VALUES ('generic')) k(kind), range(3) r(n) WHERE regexp_replace(text, '^\s+|\s+$', '', 'g') <> ''
""")
def question_generation(spark: SparkSession, d: str) -> DataFrame:
    return documents.question_sets(read_table(spark, d, "documents").select("doc_id", "text"), "doc_id", specificities=("generic",))


# ---- requests and conversations -----------------------------------------------------------------------------------

_REQUESTS = f"(SELECT item_id AS id, text AS question, item_id % 25 AS top_n FROM eval_items UNION ALL SELECT -doc_id, text, doc_id % 25 FROM documents)"


@query(f"""
SELECT id, CASE WHEN question IS NULL OR length({_STRIP.format('question')}) < 3 THEN 'too short' WHEN length({_STRIP.format('question')}) > 500 THEN 'too long' WHEN top_n NOT BETWEEN 1 AND 20 THEN 'top_n' END AS reason FROM {_REQUESTS}
""")
def request_validation(spark: SparkSession, d: str) -> DataFrame:
    a = read_table(spark, d, "eval_items").select(F.col("item_id").alias("id"), F.col("text").alias("question"), (F.col("item_id") % 25).alias("top_n"))
    b = read_table(spark, d, "documents").select((-F.col("doc_id")).alias("id"), F.col("text").alias("question"), (F.col("doc_id") % 25).alias("top_n"))
    return answers.valid_requests(a.unionByName(b)).select("id", "reason")


_TURNS = "(SELECT user_id AS conv_id, ts, event_id, event_type AS question, props AS answer FROM events)"


def _turns(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "events")
    return rows.select(F.col("user_id").alias("conv_id"), F.struct("ts", "event_id").alias("at"), "event_id", F.col("event_type").alias("question"), F.col("props").alias("answer"))


_LAST_SQL = f"""
b AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY ts DESC, event_id DESC) AS back FROM {_TURNS}),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY back DESC) AS turn_no FROM b WHERE back <= 5)
"""


@query(f"WITH {_LAST_SQL} SELECT conv_id, turn_no::INT AS turn_no, event_id FROM t")
def conversation_last_n(spark: SparkSession, d: str) -> DataFrame:
    return answers.last_turns(_turns(spark, d), "conv_id", "at").select("conv_id", "turn_no", "event_id")


@query(f"""
WITH {_LAST_SQL} SELECT conv_id, string_agg('Pregunta ' || turn_no || ': ' || question || chr(10) || 'Respuesta ' || turn_no || ': ' || left(answer, 100) || '...', chr(10) ORDER BY turn_no) AS context FROM t GROUP BY conv_id
""")
def conversation_context(spark: SparkSession, d: str) -> DataFrame:
    return answers.history(_turns(spark, d), "conv_id", "at", "question", "answer")


# ---- sets and likeness --------------------------------------------------------------------------------------------

_PAIR = f"(SELECT a.doc_id, {_tokens_sql('lower(a.text)')} AS x, {_tokens_sql('lower(b.text)')} AS y, a.text AS s, b.text AS t FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1 WHERE a.text IS NOT NULL AND b.text IS NOT NULL)"


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every document beside the one with the next id."""
    docs = read_table(spark, d, "documents").where("text is not null").select("doc_id", "text")
    other = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("t"))
    return docs.join(other, "doc_id").select("doc_id", F.col("text").alias("s"), "t", T.tokens(F.lower("text")).alias("x"), T.tokens(F.lower("t")).alias("y"))


_COMMON, _NX, _NY = "len(list_intersect(list_distinct(x), list_distinct(y)))", "len(list_distinct(x))", "len(list_distinct(y))"


@query(f"""
SELECT doc_id, ({_NX} - c)::INT AS n_missing, ({_NY} - c)::INT AS n_extra, c::INT AS n_common, round(coalesce(c / nullif({_NY}, 0), 0), 6) AS precision, round(coalesce(c / nullif({_NX}, 0), 0), 6) AS recall,
  round(coalesce(2 * coalesce(c / nullif({_NY}, 0), 0) * coalesce(c / nullif({_NX}, 0), 0) / nullif(coalesce(c / nullif({_NY}, 0), 0) + coalesce(c / nullif({_NX}, 0), 0), 0), 0), 6) AS f1,
  CASE WHEN c = {_NX} AND c = {_NY} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS accuracy
FROM (SELECT *, {_COMMON} AS c FROM {_PAIR})
""")
def set_compare(spark: SparkSession, d: str) -> DataFrame:
    parts = S.compare(F.col("x"), F.col("y"))
    return _pairs(spark, d).select("doc_id", *[(F.round(c, 6) if n in ("precision", "recall", "f1") else c).alias(n) for n, c in parts.items()])


@query(f"SELECT doc_id, round(coalesce(c / nullif({_NX} + {_NY} - c, 0), 0), 6) AS jaccard, round(coalesce(2 * c / nullif({_NX} + {_NY}, 0), 0), 6) AS dice FROM (SELECT *, {_COMMON} AS c FROM {_PAIR})")
def jaccard_dice(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("doc_id", F.round(S.jaccard(F.col("x"), F.col("y")), 6).alias("jaccard"), F.round(S.dice(F.col("x"), F.col("y")), 6).alias("dice"))


@query(f"SELECT doc_id, o AS overlap, o > 0.8 AS consistent FROM (SELECT doc_id, round(coalesce({_COMMON} / nullif(least({_NX}, {_NY}), 0), 0), 6) AS o FROM {_PAIR})")
def overlap_coefficient(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("doc_id", F.round(S.overlap(F.col("x"), F.col("y")), 6).alias("overlap")).withColumn("consistent", F.col("overlap") > evaluate.CONSISTENT)


@query("""
WITH r AS (SELECT DISTINCT organo, lote AS run, k AS item FROM (SELECT organo, lote, unnest(json_keys(payload)) AS k FROM fallos_json WHERE json_valid(payload) AND json_type(payload) = 'OBJECT')),
s AS (SELECT organo, count(*) AS runs, round(var_pop(n), 6) AS variance, round(avg(n), 6) AS mean_count FROM (SELECT organo, run, count(DISTINCT item) AS n FROM r GROUP BY 1, 2) GROUP BY 1),
h AS (SELECT organo, item, count(DISTINCT run) AS in_runs FROM r GROUP BY 1, 2)
SELECT organo, runs, count(*) FILTER (WHERE in_runs = runs) AS common, count(in_runs) AS total,
  round(CASE WHEN runs < 2 THEN 1.0 ELSE count(*) FILTER (WHERE in_runs = runs) / count(in_runs) END, 6) AS consistency, CASE WHEN runs < 2 THEN 0.0 ELSE variance END AS variance, mean_count
FROM s JOIN h USING (organo) GROUP BY organo, runs, variance, mean_count
""")
def nary_consistency(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "fallos_json").withColumn("v", F.try_parse_json("payload")).where("v is not null and schema_of_variant(v) like 'OBJECT%'")
    items = rows.select("organo", F.col("lote").alias("run"), F.explode(F.json_object_keys("payload")).alias("item")).distinct()
    return evaluate.consistency(items, "organo", "run", "item")


@query("SELECT id_fallo, count(DISTINCT organo) AS courts, string_agg(DISTINCT organo, ',' ORDER BY organo) AS organos FROM votos WHERE id_fallo IS NOT NULL GROUP BY id_fallo")
def distinct_ids(spark: SparkSession, d: str) -> DataFrame:
    organos = F.array_sort(F.collect_set("organo"))
    return read_table(spark, d, "votos").where("id_fallo is not null").groupBy("id_fallo").agg(organos.alias("o")).select("id_fallo", F.size("o").cast("long").alias("courts"), F.array_join("o", ",").alias("organos"))


_STOP_SQL = ", ".join(f"'{w}'" for w in evaluate.STOPWORDS)


@query(rf"""
WITH w AS (SELECT doc_id, unnest(list_filter(regexp_extract_all(lower(s), '[\p{{L}}\p{{N}}_]{{2,}}'), lambda w: w NOT IN ({_STOP_SQL}))) AS w, 0 AS side FROM {_PAIR}
  UNION ALL SELECT doc_id, unnest(list_filter(regexp_extract_all(lower(t), '[\p{{L}}\p{{N}}_]{{2,}}'), lambda w: w NOT IN ({_STOP_SQL}))), 1 FROM {_PAIR}),
c AS (SELECT doc_id, w, count(*) FILTER (WHERE side = 0) AS x, count(*) FILTER (WHERE side = 1) AS y FROM w GROUP BY doc_id, w),
v AS (SELECT doc_id, x * (ln(3.0 / (1 + (x > 0)::INT + (y > 0)::INT)) + 1) AS x, y * (ln(3.0 / (1 + (x > 0)::INT + (y > 0)::INT)) + 1) AS y FROM c)
SELECT p.doc_id, round(coalesce(c.cosine, 0), 6) AS similarity FROM {_PAIR} p
LEFT JOIN (SELECT doc_id, sum(x * y) / nullif(sqrt(sum(x * x)) * sqrt(sum(y * y)), 0) AS cosine FROM v GROUP BY doc_id) c USING (doc_id)
""")
def tfidf_cosine(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.tfidf_cosine(_pairs(spark, d), "doc_id", "s", "t")


@query(f"SELECT doc_id, round(coalesce({_COMMON} / nullif({_NX} + {_NY} - {_COMMON}, 0), 0), 6) AS similarity FROM {_PAIR}")
def word_jaccard(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("doc_id", evaluate.word_jaccard(F.col("s"), F.col("t")).alias("similarity"))


# ---- evaluation ---------------------------------------------------------------------------------------------------


@query("""
SELECT source, round(CASE WHEN tn > 0 THEN (tp + tn) / (tp + fp + fn + tn) ELSE coalesce(tp / nullif(tp + fp + fn, 0), 0) END, 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision,
  round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1
FROM (SELECT source, count(*) FILTER (WHERE g AND p) AS tp, count(*) FILTER (WHERE NOT g AND p) AS fp, count(*) FILTER (WHERE g AND NOT p) AS fn, count(*) FILTER (WHERE NOT g AND NOT p) AS tn
  FROM (SELECT source, coalesce(lang, '') = 'es' AS g, length(coalesce(text, '')) > 900 AS p FROM documents) GROUP BY source)
""")
def classification_metrics(spark: SparkSession, d: str) -> DataFrame:
    g, p = F.coalesce("lang", F.lit("")) == "es", F.length(F.coalesce("text", F.lit(""))) > 900
    counts = read_table(spark, d, "documents").groupBy("source").agg(F.count_if(g & p).alias("tp"), F.count_if(~g & p).alias("fp"), F.count_if(g & ~p).alias("fn"), F.count_if(~g & ~p).alias("tn"))
    return counts.select("source", *[F.round(c, 6).alias(n) for n, c in S.classification(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn")).items()])


_VERSIONS = f"(SELECT para_uid, text AS s, replace(replace(text, 'art. 1', 'inciso '), 'art.', 'artículo') AS t FROM {_PARAS} WHERE text IS NOT NULL)"


def _versions(spark: SparkSession, d: str) -> DataFrame:
    """Every paragraph beside a version of other citation format."""
    other = F.replace(F.replace("text", F.lit("art. 1"), F.lit("inciso ")), F.lit("art."), F.lit("artículo"))
    return _paragraphs(spark, d).where("text is not null").select("para_uid", F.col("text").alias("s"), other.alias("t"))


@query(f"""
WITH m AS (SELECT {_mentions_sql('s')} AS x, {_mentions_sql('t')} AS y FROM {_VERSIONS}),
k AS (SELECT len(list_intersect(x, y)) AS c, len(x) AS nx, len(y) AS ny FROM m),
r AS (SELECT coalesce(c / nullif(ny, 0), 0) AS p, coalesce(c / nullif(nx, 0), 0) AS r, CASE WHEN c = nx AND c = ny THEN 1.0 ELSE 0.0 END AS a FROM k)
SELECT count(*) AS files, round(avg(p), 6) AS mean_precision, round(avg(r), 6) AS mean_recall, round(avg(coalesce(2 * p * r / nullif(p + r, 0), 0)), 6) AS mean_f1, round(avg(a), 6) AS accuracy FROM r
""")
def citation_robustness(spark: SparkSession, d: str) -> DataFrame:
    rows = _versions(spark, d).select(C.mentioned(F.col("s")).alias("x"), C.mentioned(F.col("t")).alias("y"))
    return evaluate.mean_metrics(rows.select(*[c.alias(n) for n, c in S.compare(F.col("x"), F.col("y")).items()]))


_WORD_SIM = f"(SELECT doc_id, round(coalesce({_COMMON} / nullif({_NX} + {_NY} - {_COMMON}, 0), 0), 6) AS similarity FROM {_PAIR})"


@query(f"SELECT count(*) AS pairs, round(avg(similarity), 6) AS mean_similarity, count(*) FILTER (WHERE similarity >= 0.7) AS robust, round(count(*) FILTER (WHERE similarity >= 0.7) / count(*), 6) AS robust_rate FROM {_WORD_SIM}")
def wording_robustness(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.robustness(word_jaccard(spark, d))


@query(f"SELECT count(*) AS pairs, round(avg(1 - similarity), 6) AS mean_dissimilarity, count(*) FILTER (WHERE 1 - similarity >= 0.3) AS sensitive, round(count(*) FILTER (WHERE 1 - similarity >= 0.3) / count(*), 6) AS sensitive_rate FROM {_WORD_SIM}")
def content_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.sensitivity(word_jaccard(spark, d))


@query(f"""
SELECT para_uid, length(s) <> length(t) AND s <> t AND len(list_intersect(x, y)) / greatest(len(x), 1) > 0.7 AS changed FROM (SELECT *, {_mentions_sql('s')} AS x, {_mentions_sql('t')} AS y FROM {_VERSIONS})
""")
def content_change_heuristic(spark: SparkSession, d: str) -> DataFrame:
    rows = _versions(spark, d).withColumns({"x": C.mentioned(F.col("s")), "y": C.mentioned(F.col("t"))})
    kept = F.size(F.array_intersect("x", "y")) / F.greatest(F.size("x"), F.lit(1))
    return rows.select("para_uid", evaluate.content_changed(F.col("s"), F.col("t"), kept).alias("changed"))


# Items name no document: the expected one is the first of its hits whose id agrees with the question's number modulo 3, and for
# every fifth question also one that is not there.
_RANKED_SQL = f"""
{_bm25_sql(_DOCS)},
e AS (SELECT qid, question_type, min(key) AS expected FROM (SELECT qid, question_type, key FROM {_QUESTIONS} JOIN lex USING (qid) WHERE key % 3 = floor(qid / 20) % 3) GROUP BY qid, question_type
      UNION ALL SELECT qid, question_type, -1 FROM {_QUESTIONS} WHERE qid % 100 = 0),
ranked AS (SELECT e.qid, question_type, expected, coalesce(min(rank), 0)::INT AS rank FROM e LEFT JOIN lex ON e.qid = lex.qid AND expected = key GROUP BY e.qid, question_type, expected)
"""


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    hits = _lexical(spark, d)
    asked = _questions(spark, d)
    inside = asked.join(hits, "qid").where("key % 3 = floor(qid / 20) % 3").groupBy("qid", "question_type").agg(F.min("key").alias("expected"))
    outside = asked.where("qid % 100 = 0").select("qid", "question_type", F.lit(-1).cast("long").alias("expected"))
    return evaluate.ranks(inside.unionByName(outside), hits.select("qid", F.col("key").alias("doc"), "rank")).select("qid", "question_type", "expected", "rank")


@query(f"WITH {_RANKED_SQL} SELECT qid, question_type, expected, rank FROM ranked")
def retrieval_rank(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(spark, d)


def _tops() -> str:
    return ", ".join(f"round(avg((rank BETWEEN 1 AND {k})::INT), 6) AS top{k}" for k in (1, 3, 5))


@query(f"WITH {_RANKED_SQL} SELECT count(*) AS questions, {_tops()}, round(coalesce(avg(rank) FILTER (WHERE rank > 0), 0), 6) AS mean_rank FROM ranked")
def retrieval_topk_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.top_accuracy(_ranked(spark, d))


@query(f"""
WITH {_RANKED_SQL}, b AS (SELECT expected, coalesce(min(rank) FILTER (WHERE rank > 0), 0) AS rank FROM ranked GROUP BY expected)
SELECT count(*) AS documents, {_tops()}, count(*) FILTER (WHERE rank > 0) AS documents_with_hits, round(sum(rank) / greatest(count(*) FILTER (WHERE rank > 0), 1), 6) AS mean_best_rank FROM b
""")
def best_question_per_doc(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.best_by_document(_ranked(spark, d))


@query(f"""
WITH {_RANKED_SQL} SELECT CASE WHEN grouping(question_type) = 1 THEN '(all)' ELSE question_type END AS kind, count(*) AS questions, {_tops()}, round(coalesce(avg(rank) FILTER (WHERE rank > 0), 0), 6) AS mean_rank
FROM ranked GROUP BY GROUPING SETS ((question_type), ())
""")
def retrieval_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.summary_by_type(_ranked(spark, d), "question_type")


# ---- pairwise ratings ---------------------------------------------------------------------------------------------

_MATCHES = """(SELECT user_id % 50 AS league, ts, event_id, 'p' || user_id % 5 AS player_a, 'p' || (user_id % 5 + 1 + event_id % 4) % 5 AS player_b,
  CASE event_id % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS result FROM events)"""


def _matches(spark: SparkSession, d: str) -> DataFrame:
    """The events as matches of fifty leagues of five players, in the order of their time."""
    a, b = F.col("user_id") % 5, (F.col("user_id") % 5 + 1 + F.col("event_id") % 4) % 5
    result = F.when(F.col("event_id") % 3 == 0, 1.0).when(F.col("event_id") % 3 == 1, 0.5).otherwise(0.0)
    return read_table(spark, d, "events").select((F.col("user_id") % 50).alias("league"), "ts", "event_id", F.concat(F.lit("p"), a.cast("string")).alias("player_a"), F.concat(F.lit("p"), b.cast("string")).alias("player_b"), result.alias("result"))


_ELO_SQL = f"""
m AS (SELECT *, row_number() OVER (PARTITION BY league ORDER BY ts, event_id) AS n FROM {_MATCHES}),
x AS (SELECT league, n, player_a, player_b, result, [0.0, 0.0, 0.0, 0.0, 0.0]::DOUBLE[] AS z, substr(player_a, 2)::INT + 1 AS ia, substr(player_b, 2)::INT + 1 AS ib FROM m),
e AS (SELECT league, 0::BIGINT AS n, [1500.0, 1500.0, 1500.0, 1500.0, 1500.0]::DOUBLE[] AS r, 0 AS ia, 0 AS ib, 0.0::DOUBLE AS ra, 0.0::DOUBLE AS rb, 0.0::DOUBLE AS na, 0.0::DOUBLE AS nb FROM (SELECT DISTINCT league FROM m)
  UNION ALL SELECT league, n, list_transform(r, lambda v, i: CASE WHEN i = ia THEN na WHEN i = ib THEN nb ELSE v END), ia, ib, ra, rb, na, nb FROM (
    SELECT e.league, x.n, e.r, x.ia, x.ib, e.r[x.ia] AS ra, e.r[x.ib] AS rb,
      e.r[x.ia] + 32 * (x.result - 1 / (1 + pow(10, (e.r[x.ib] - e.r[x.ia]) / 400))) AS na, e.r[x.ib] + 32 * (1 - x.result - 1 / (1 + pow(10, (e.r[x.ia] - e.r[x.ib]) / 400))) AS nb
    FROM e JOIN x ON x.league = e.league AND x.n = e.n + 1))
"""


@query(f"WITH RECURSIVE {_ELO_SQL} SELECT league, n::INT AS match_no, 'p' || (ia - 1) AS player_a, 'p' || (ib - 1) AS player_b, round(ra, 4) AS a_before, round(rb, 4) AS b_before, round(na, 4) AS a_after, round(nb, 4) AS b_after FROM e WHERE n > 0")
def elo_history(spark: SparkSession, d: str) -> DataFrame:
    rows = evaluate.elo(_matches(spark, d), ["ts", "event_id"], ["league"])
    return rows.select("league", "match_no", "player_a", "player_b", *[F.round(c, 4).alias(c) for c in ("a_before", "b_before", "a_after", "b_after")])


@query(f"""
WITH RECURSIVE {_ELO_SQL},
s AS (SELECT league, n, 'p' || (ia - 1) AS player, na AS rating FROM e WHERE n > 0 UNION ALL SELECT league, n, 'p' || (ib - 1), nb FROM e WHERE n > 0),
l AS (SELECT league, player, round(arg_max(rating, n), 4) AS rating FROM s GROUP BY league, player)
SELECT league, player, rating FROM l
""")
def elo_ratings(spark: SparkSession, d: str) -> DataFrame:
    board = evaluate.leaderboard(evaluate.elo(_matches(spark, d), ["ts", "event_id"], ["league"]), "league")
    return board.select("league", "player", F.round("rating", 4).alias("rating"))


@query(f"""
SELECT player, count(*) AS matches, count(*) FILTER (WHERE r = 1) AS wins, count(*) FILTER (WHERE r = 0) AS losses, count(*) FILTER (WHERE r = 0.5) AS ties, round(count(*) FILTER (WHERE r = 1) / count(*), 6) AS win_rate
FROM (SELECT player_a AS player, result AS r FROM {_MATCHES} UNION ALL SELECT player_b, 1 - result FROM {_MATCHES}) GROUP BY player
""")
def win_loss_tie(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.tallies(_matches(spark, d))


@query(r"""
SELECT event_id, CASE WHEN u IN ('A', 'B', 'EMPATE') THEN u ELSE 'EMPATE' END AS verdict
FROM (SELECT event_id, upper(regexp_replace(CASE event_id % 5 WHEN 0 THEN ' a ' WHEN 1 THEN 'B' || chr(10) WHEN 2 THEN 'empate' WHEN 3 THEN 'A y B' ELSE event_type END, '^\s+|\s+$', '', 'g')) AS u FROM events)
""")
def judge_normalize(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 5
    reply = F.when(k == 0, " a ").when(k == 1, "B\n").when(k == 2, "empate").when(k == 3, "A y B").otherwise(F.col("event_type"))
    return read_table(spark, d, "events").select("event_id", evaluate.judged(reply).alias("verdict"))


@query(f"SELECT a.p AS player_a, b.p AS player_b, qid FROM (SELECT DISTINCT question_type AS p FROM eval_items) a JOIN (SELECT DISTINCT question_type AS p FROM eval_items) b ON a.p < b.p, {_QUESTIONS}")
def config_pairs(spark: SparkSession, d: str) -> DataFrame:
    players = read_table(spark, d, "eval_items").select(F.col("question_type").alias("player")).where("player is not null").distinct()
    return evaluate.pairings(players, _questions(spark, d))


_RUN = "(SELECT organo AS test, avg((sentido = '{}')::INT) AS accuracy FROM votos WHERE sentido IS NOT NULL GROUP BY 1)"


@query(f"""
SELECT test, round(d, 6) AS diff, CASE WHEN d > 0.05 THEN 'improved' WHEN d < -0.05 THEN 'degraded' ELSE 'stable' END AS verdict
FROM (SELECT test, b.accuracy - a.accuracy AS d FROM {_RUN.format('adhiere')} a JOIN {_RUN.format('primer voto')} b USING (test))
""")
def run_comparison(spark: SparkSession, d: str) -> DataFrame:
    votes = read_table(spark, d, "votos").where("sentido is not null")
    run = lambda s: votes.groupBy(F.col("organo").alias("test")).agg(F.avg((F.col("sentido") == s).cast("double")).alias("accuracy"))
    return evaluate.compare_runs(run("adhiere"), run("primer voto"), "test")


# ---- parsing, ordering, sampling ----------------------------------------------------------------------------------


@query("SELECT event_id, (props ->> '$.k')::BIGINT AS k, json_valid(props) AS valid FROM events")
def json_props_parse(spark: SparkSession, d: str) -> DataFrame:
    v = F.try_parse_json("props")
    return read_table(spark, d, "events").select("event_id", F.try_variant_get(v, "$.k", "long").alias("k"), v.isNotNull().alias("valid"))


@query("SELECT id_fallo, row_number() OVER (ORDER BY try_cast(id_fallo AS BIGINT) NULLS FIRST, id_fallo)::INT AS place FROM (SELECT DISTINCT id_fallo FROM votos WHERE id_fallo IS NOT NULL)")
def numeric_id_sort(spark: SparkSession, d: str) -> DataFrame:
    ids = read_table(spark, d, "votos").where("id_fallo is not null").select("id_fallo").distinct()
    placed = documents.ordinals(ids.withColumn("n", F.expr("try_cast(id_fallo as bigint)")), "n", "id_fallo", name="place")
    return placed.select("id_fallo", (F.col("place") + 1).cast("int").alias("place"))


@query("SELECT path, organo FROM (SELECT DISTINCT path, organo FROM fallos_json) ORDER BY path, organo LIMIT 5")
def head_sample(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "fallos_json").select("path", "organo").distinct().orderBy("path", "organo").limit(5)

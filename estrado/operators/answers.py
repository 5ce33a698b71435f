"""From hits to grouped results, contexts, conversations and displays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from estrado.functions import citations as C
from estrado.functions import text as T

SNIPPET, MAX_RESULTS, HISTORY = 300, 8, 5


def group_hits(hits: DataFrame) -> DataFrame:
    """(qid, expte, first_rank, idea_central, materia_preliminar, articulos_citados, hits): one row a ruling.

    ``hits`` has (qid, rank, expediente, section, paragraph, path, score, idea_central, materia_preliminar,
    articulos_citados). Scalars are those of the ruling's first hit, citation structs come once each in first-seen order.
    """
    expte = F.coalesce("expediente", F.lit("N/A"))
    hit = F.struct("rank", "section", F.col("paragraph").alias("extracto"), "path", "score")
    cited = F.struct("rank", F.coalesce("articulos_citados", F.array()).alias("c"))
    grouped = hits.withColumn("expte", expte).groupBy("qid", "expte").agg(
        F.min("rank").alias("first_rank"),
        F.min_by(F.coalesce("idea_central", F.lit("-")), "rank").alias("idea_central"),
        F.min_by(F.coalesce("materia_preliminar", F.lit("-")), "rank").alias("materia_preliminar"),
        F.array_sort(F.collect_list(hit)).alias("hits"),
        F.sort_array(F.collect_list(cited)).alias("cited"),
    )
    return grouped.withColumn("articulos_citados", F.array_distinct(F.flatten(F.transform("cited", lambda x: x["c"])))).drop("cited")


def by_mean_score(hits: DataFrame) -> DataFrame:
    """(qid, expte, n_hits, n_sections, n_paths, mean_score, place): groups by mean score from the best down."""
    grouped = hits.groupBy("qid", F.coalesce("expediente", F.lit("N/A")).alias("expte")).agg(F.count("*").alias("n_hits"), F.countDistinct("section").alias("n_sections"), F.countDistinct("path").alias("n_paths"), F.round(F.avg("score"), 6).alias("mean_score"))
    return grouped.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy(F.col("mean_score").desc(), "expte")))


def flatten_hits(grouped: DataFrame) -> DataFrame:
    """(qid, expte, pos, section, paragraph, path, score): grouped hits as rows again, with defaults for missing parts."""
    rows = grouped.select("qid", "expte", F.posexplode("hits").alias("pos", "h"))
    return rows.select("qid", "expte", "pos", F.coalesce("h.section", F.lit("")).alias("section"), F.coalesce("h.extracto", F.lit("")).alias("paragraph"), F.coalesce("h.path", F.lit("")).alias("path"), F.coalesce("h.score", F.lit(0.0)).alias("score"))


def snippet(text: Column, size: int = SNIPPET) -> Column:
    """Stripped, in one line, cut with an ellipsis."""
    return T.cut(F.replace(T.strip(text), F.lit("\n"), F.lit(" ")), size, "…")


def _joined(rows: DataFrame, line: Column, order: Column, by: str = "qid") -> DataFrame:
    return rows.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), line.alias("l")))), lambda x: x["l"]), "\n").alias("context"))


def context_flat(hits: DataFrame, size: int = SNIPPET) -> DataFrame:
    """(qid, context): a line ``[ruling §section]: text`` for each hit."""
    line = F.concat(F.lit("["), F.coalesce("expediente", F.lit("N/A")), F.lit(" §"), F.coalesce("section", F.lit("N/A")), F.lit("]: "), T.cut(F.col("paragraph"), size))
    return _joined(hits, line, F.col("rank"))


def context_grouped(grouped: DataFrame, size: int = SNIPPET) -> DataFrame:
    """(qid, context): blocks of heading, general line and detail lines, one for each ruling."""
    details = F.transform("hits", lambda h: F.concat(F.lit("DETALLE §"), F.coalesce(h["section"], F.lit("N/A")), F.lit(": "), snippet(F.coalesce(h["extracto"], F.lit("Sin contenido")), size)))
    head = F.array(
        F.concat(F.lit("===== FALLO "), "expte", F.lit(" =====")),
        F.concat(F.lit("GENERAL: Materia: "), "materia_preliminar", F.lit("; Artículos: "), C.inline(F.col("articulos_citados")), F.lit("; Idea: "), "idea_central"),
    )
    block = F.array_join(F.concat(head, details, F.array(F.lit(""))), "\n")
    return _joined(grouped, block, F.struct("first_rank", "expte"))


def context_chat(hits: DataFrame) -> DataFrame:
    """(qid, context): a line ``[ruling]: text`` of 200 characters and an ellipsis for each hit."""
    line = F.concat(F.lit("["), F.coalesce("expediente", F.lit("N/A")), F.lit("]: "), F.left("paragraph", F.lit(200)), F.lit("..."))
    return _joined(hits, line, F.col("rank"))


def context_documents(hits: DataFrame) -> DataFrame:
    """(qid, context): numbered blocks of source, section and content."""
    block = F.concat(F.lit("\nDocumento "), F.col("rank").cast("string"), F.lit(":\nFuente: "), F.coalesce("path", F.lit("N/A")), F.lit("\nSección: "), F.coalesce("section", F.lit("N/A")), F.lit("\nContenido: "), T.strip(F.col("paragraph")), F.lit("\n"))
    return _joined(hits, block, F.col("rank"))


def display(hits: DataFrame) -> DataFrame:
    """(qid, n, expte, seccion, extracto, score): short columns for a table, numbered from 1."""
    n = F.row_number().over(Window.partitionBy("qid").orderBy("rank"))
    return hits.select("qid", n.alias("n"), F.coalesce("expediente", F.lit("N/A")).alias("expte"), T.cut(F.coalesce("section", F.lit("N/A")), 50).alias("seccion"), T.cut(F.coalesce("paragraph", F.lit("N/A")), 100).alias("extracto"), F.round("score", 2).alias("score"))


def summaries(answers: DataFrame, key: str, markdown: str) -> DataFrame:
    """(key, expte, summary) of every ``[number] «text»`` in an answer; of several for one ruling the last."""
    pattern = r"\[(\d+)\]\s+«([^»]+)»"
    parts = F.arrays_zip(F.regexp_extract_all(markdown, F.lit(pattern), F.lit(1)).alias("e"), F.regexp_extract_all(markdown, F.lit(pattern), F.lit(2)).alias("s"))
    rows = answers.select(key, F.posexplode(parts).alias("p", "x"))
    return rows.groupBy(key, F.col("x.e").alias("expte")).agg(T.strip(F.max_by("x.s", "p")).alias("summary"))


def with_summaries(grouped: DataFrame, summaries: DataFrame) -> DataFrame:
    """``grouped`` (qid, expte, ...) with ``llm_summary`` of ``summaries`` (qid, expte, summary), empty where there is none."""
    return grouped.join(summaries.withColumnRenamed("summary", "llm_summary"), ["qid", "expte"], "left").fillna("", ["llm_summary"])


def valid_requests(requests: DataFrame, question: str = "question", top_n: str = "top_n") -> DataFrame:
    """``requests`` with ``reason``, null for a valid one: 3 to 500 characters asked, 1 to 20 results."""
    size = F.length(T.strip(F.col(question)))
    reason = F.when(size.isNull() | (size < 3), "too short").when(size > 500, "too long").when(F.col(top_n).isNull() | ~F.col(top_n).between(1, 20), "top_n")
    return requests.withColumn("reason", reason)


def last_turns(turns: DataFrame, conversation: str, order: str, n: int = HISTORY) -> DataFrame:
    """The last ``n`` turns of every conversation, numbered 1..n from the oldest as ``turn_no``."""
    back = F.row_number().over(Window.partitionBy(conversation).orderBy(F.col(order).desc()))
    kept = turns.withColumn("_back", back).where(F.col("_back") <= n)
    return kept.withColumn("turn_no", F.row_number().over(Window.partitionBy(conversation).orderBy(F.col("_back").desc()))).drop("_back")


def history(turns: DataFrame, conversation: str, order: str, question: str, answer: str, n: int = HISTORY) -> DataFrame:
    """(conversation, context): question and first 100 characters of the answer of the last turns."""
    last = last_turns(turns, conversation, order, n)
    no = F.col("turn_no").cast("string")
    line = F.concat(F.lit("Pregunta "), no, F.lit(": "), F.col(question), F.lit("\nRespuesta "), no, F.lit(": "), F.left(answer, F.lit(100)), F.lit("..."))
    return _joined(last, line, F.col("turn_no"), conversation)

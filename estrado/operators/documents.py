"""Page texts to sectioned documents and back, ordinals, and rewritten data sets."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from estrado.functions import generate as G
from estrado.functions import text as T
from estrado.functions.citations import mentioned
from estrado.plans.scratch import materialize
from estrado.sources import files

OPENING = "INICIO"
#: Least length of a text to be rewritten and of a rewritten one to be taken.
LEAST, LEAST_NEW = 20, 10


def page_paragraphs(pages: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, pos, paragraph): noise lines dropped, lines joined to paragraphs. Null texts have none."""
    return pages.select(key, F.posexplode(T.join_lines(T.drop_noise_lines(F.col(text)))).alias("pos", "paragraph"))


def sections(paragraphs: DataFrame, key: str) -> DataFrame:
    """(key, section, section_pos, paragraph_id, text): a title paragraph begins a section, repeated titles go on their first.

    What comes before the first title belongs to ``INICIO``.
    """
    order = Window.partitionBy(key).orderBy("pos")
    is_key = T.is_key_line(T.strip(F.col("paragraph")))
    title = F.last(F.when(is_key, F.regexp_replace(T.strip(F.col("paragraph")), ":$", "")), True).over(order)
    rows = paragraphs.withColumn("section", F.coalesce(title, F.lit(OPENING))).where(~is_key)
    place = Window.partitionBy(key, "section")
    rows = rows.withColumn("section_pos", F.min("pos").over(place))
    return rows.select(key, "section", "section_pos", (F.row_number().over(place.orderBy("pos")) - 1).alias("paragraph_id"), T.strip(F.col("paragraph")).alias("text"))


def sectioned(pages: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, informacion, contenido): the document of a page text, its subject taken from the opening's captions.

    ``contenido`` maps sections in their order to their paragraphs.
    """
    rows = sections(page_paragraphs(pages, key, text), key)
    lists = rows.groupBy(key, "section", "section_pos").agg(F.transform(F.array_sort(F.collect_list(F.struct("paragraph_id", "text"))), lambda x: x["text"]).alias("texts"))
    entries = F.transform(F.array_sort(F.collect_list(F.struct("section_pos", "section", "texts"))), lambda x: F.struct(x["section"].alias("key"), x["texts"].alias("value")))
    docs = lists.groupBy(key).agg(F.map_from_entries(entries).alias("contenido"))
    opening = F.coalesce(F.try_element_at("contenido", F.lit(OPENING)), F.array().cast("array<string>"))
    subjects = F.filter(F.transform(opening, T.subject), lambda s: s.isNotNull())
    return docs.select(key, F.struct(F.get(subjects, F.lit(0)).alias("materia_preliminar"), F.lit("").alias("resumen")).alias("informacion"), "contenido")


def full_text(paragraphs: DataFrame, key: str, idea: str | None = None, titles: bool = False) -> DataFrame:
    """(key, full_text): a document's paragraphs in order, on request with its summary first and section titles."""
    rows = paragraphs.where(F.col("text").isNotNull())
    part = F.when((F.col("paragraph_id") == 0) & F.lit(titles), F.concat("section", F.lit(":\n"), "text")).otherwise(F.col("text"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section_pos", "section", "paragraph_id", part.alias("t")))), lambda x: x["t"]), "\n")
    head = F.max(idea) if idea else F.lit(None).cast("string")
    return rows.groupBy(key).agg(F.concat_ws("\n", F.nullif(head, F.lit("")), body).alias("full_text"))


def resplit(rewritten: DataFrame, shape: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, section, texts): a rewritten flat text cut back into sections by their numbers of lines.

    ``shape`` has (key, section, section_pos, n_lines); lines beyond the shape are left out, missing ones leave lists short.
    """
    before = F.coalesce(F.sum("n_lines").over(Window.partitionBy(key).orderBy("section_pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    rows = shape.withColumn("_from", before).join(rewritten.select(key, T.lines(F.col(text)).alias("_lines")), key)
    return rows.select(key, "section", F.slice("_lines", F.col("_from") + 1, F.col("n_lines").cast("int")).alias("texts"))


def ordinals(rows: DataFrame, *order: str, name: str = "para_id") -> DataFrame:
    """``rows`` numbered from 0 in the order of ``order``, by range partitions: their sizes give each its offset.

    Equal keys keep an arbitrary order among themselves.
    """
    part = F.spark_partition_id()
    placed = materialize(rows.orderBy(*order).withColumn("_part", part).withColumn("_at", F.monotonically_increasing_id() - F.shiftleft(part.cast("long"), 33)))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("n"))
    offsets = sizes.select("_part", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))  # a row for each partition
    return placed.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_at") + F.col("_off")).drop("_part", "_at", "_off")


def citations_of_files(files: DataFrame) -> DataFrame:
    """(path, mentioned) of (path, text); a file without text raises."""
    text = F.when(F.col("text").isNull(), F.raise_error(F.concat(F.lit("unreadable file "), "path"))).otherwise(F.col("text"))
    return files.select("path", mentioned(text).alias("mentioned"))


def rewritten(paragraphs: DataFrame, kind: str, rewrite: Callable[[Column], Column] | str, only: tuple[str, ...] = (), text: str = "text") -> DataFrame:
    """``paragraphs`` with ``rewritten`` and ``accepted``: long enough texts of the stated sections go through the generator.

    For ``cambio_contenido`` only every other paragraph does. A reply of ten characters or fewer leaves the original.
    """
    call = (lambda c: G.generate(c, rewrite)) if isinstance(rewrite, str) else rewrite
    gate = F.length(T.strip(F.col(text))) > LEAST
    if only:
        gate &= F.col("section").isin(*only)
    if kind == "cambio_contenido":
        gate &= F.col("paragraph_id") % 2 == 0
    new = F.when(F.coalesce(gate, F.lit(False)), call(F.col(text)))
    ok = F.coalesce(F.length(T.strip(F.col("_new"))) > LEAST_NEW, F.lit(False))
    return paragraphs.withColumn("_new", new).withColumn("rewritten", F.when(ok, F.col("_new")).otherwise(F.col(text))).withColumn("accepted", ok).drop("_new")


#: Most names of a closed list of sources.
LISTED = 2_000


def structured_citations(quotations: DataFrame, key: str, quotation: str, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((key, main_source, cited_articles, n_verbatim), orphans (key, quotation)) of quotations.

    ``sources`` (canonical_name, short_name) is the closed list that sources are mapped to, a parameter of bounded size;
    articles are sorted and distinct; quotations without a listed source are orphans. Null keys and quotations are left out.
    """
    listed = sources.select("canonical_name", "short_name").where("canonical_name is not null").distinct().limit(LISTED + 1).collect()
    if len(listed) > LISTED:
        raise ValueError(f"a closed list has at most {LISTED} sources")
    names = [(n, r["canonical_name"]) for r in listed for n in (r["canonical_name"], r["short_name"]) if n]
    rows = quotations.where(F.col(key).isNotNull() & F.col(quotation).isNotNull()).select(key, quotation, G.structured_citations(F.col(quotation), names).alias("_c"))
    known = rows.where("_c.main_source is not null").groupBy(key, F.col("_c.main_source").alias("main_source"))
    articles = F.array_sort(F.array_distinct(F.flatten(F.collect_set("_c.cited_articles"))))
    return known.agg(articles.alias("cited_articles"), F.count("*").alias("n_verbatim")), rows.where("_c.main_source is null").select(key, quotation)


def question_sets(texts: DataFrame, key: str, text: str = "text", specificities: tuple[str, ...] = tuple(G.SPECIFICITIES)) -> DataFrame:
    """(key, question_type, question_no, question): three questions of each specificity about every text; null and blank texts have none."""
    rows = texts.where(F.col(text).isNotNull() & (T.strip(F.col(text)) != ""))
    parts = [rows.select(key, F.lit(kind).alias("question_type"), F.posexplode(G.parse_questions(G.generate(F.col(text), f"questions_{kind}"))).alias("p", "question")) for kind in specificities]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select(key, "question_type", (F.col("p") + 1).alias("question_no"), "question")


def create_dataset(spark: SparkSession, source: str, target: str, kind: str, only: tuple[str, ...] = (), resume: bool = True) -> dict[str, int]:
    """Writes rewritten copies of the rulings of a folder and tells what became of them.

    ``kind`` is one of ``REWRITES``. Each readable file gives one row (path, ruling) of JSON in ``target``, in folders by
    month; paragraphs are rewritten as in ``rewritten``. With ``resume``, files already there are skipped, else replaced.
    The counts are total_files, processed, errors (no JSON object or list of them) and skipped.
    """
    if kind not in G.REWRITES:
        raise ValueError(f"no kind {kind!r}; there are {', '.join(G.REWRITES)}")
    all_files = files.raw_files(spark, source).select("path", "text")
    total = all_files.count()
    done = None
    if resume:
        try:
            done = materialize(spark.read.json(target).select("path"))
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
    todo = files.missing(all_files, done, "path") if done is not None else all_files
    new = materialize(todo.select("path", files.month(F.col("path")).alias("mes"), _rewritten_json(F.col("text"), kind, only).alias("ruling")))
    left, bad = new.count(), new.where("ruling is null").count()
    new.where("ruling is not null").write.mode("append" if resume else "overwrite").partitionBy("mes").json(target)
    return {"total_files": total, "processed": left - bad, "errors": bad, "skipped": total - left}


def _rewritten_json(text: Column, kind: str, only: tuple[str, ...]) -> Column:
    call = G.generator(G.REWRITES[kind])

    def paragraph(section: str, place: int, old: object) -> object:
        if not isinstance(old, str) or len(old.strip()) <= LEAST or only and section not in only or kind == "cambio_contenido" and place % 2:
            return old
        new = G.answer(call, old)
        return new if len(new.strip()) > LEAST_NEW else old

    def one(payload: str | None) -> str | None:
        try:
            root = json.loads(payload)
        except (ValueError, TypeError, RecursionError):
            return None
        rulings = root if isinstance(root, list) else [root]
        if not rulings or not all(isinstance(r, dict) for r in rulings):
            return None
        for ruling in rulings:
            body = ruling.get("CONTENIDO")
            for section, value in body.items() if isinstance(body, dict) else ():
                if isinstance(value, list):
                    body[section] = [paragraph(section, k, v) for k, v in enumerate(value)]
        return json.dumps(root, ensure_ascii=False)

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(one)

    return run(text)

"""Files of rulings, pages, questions and results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CITATIONS = "array<struct<main_source:string,cited_articles:array<int>,extra:array<string>>>"


def raw_files(spark: SparkSession, folder: str, glob: str = "*.json") -> DataFrame:
    """(path, modified, text) of all files below a folder; text is UTF-8, of other files Latin-1."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    text = F.coalesce(F.try_validate_utf8(F.col("content").cast("string")), F.decode("content", "ISO-8859-1"))
    return files.select(relative(F.col("path"), folder).alias("path"), F.col("modificationTime").alias("modified"), text.alias("text"))


def relative(path: Column, folder: str) -> Column:
    return F.regexp_replace(path, r"^.*?" + quoted(folder.rstrip("/").removeprefix("file:")) + "/", "")


def quoted(text: str) -> str:
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1)


def month(path: Column) -> Column:
    """The name of the folder that holds the file."""
    return F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)


def rulings(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(rulings, rejects): rulings (path, mes, stem, obj_pos, ruling variant) and the files that can't be read.

    A file holds one object or a list of them.
    """
    files = raw_files(spark, folder).withColumn("v", F.try_parse_json("text"))
    rejects = files.where("v is null").select("path", "text")
    objects = F.coalesce(F.try_variant_get("v", "$", "array<variant>"), F.array("v"))
    rows = files.where("v is not null").select("path", month(F.col("path")).alias("mes"), stem(F.col("path")).alias("stem"), F.posexplode(objects).alias("obj_pos", "ruling"))
    return rows, rejects


def paragraphs(rulings: DataFrame, strip: bool = True, least: int = 10) -> tuple[DataFrame, DataFrame]:
    """(paragraphs, rejects) of rulings: (path, obj_pos, expediente, section, paragraph_id, text, idea_central, materia_preliminar).

    Sections that are no lists of strings have no paragraphs; texts shorter than ``least`` are left out and the others
    keep their place; a ruling without an id is rejected.
    """
    one = rulings.select("path", "obj_pos", F.try_variant_get("ruling", "$.METADATOS.ID_FALLO", "string").alias("expediente"), F.try_variant_get("ruling", "$.IDEA_CENTRAL", "string").alias("idea_central"), F.try_variant_get("ruling", "$.MATERIA_PRELIMINAR", "string").alias("materia_preliminar"), F.try_variant_get("ruling", "$.CONTENIDO", "map<string,variant>").alias("contenido"))
    empty = F.col("expediente").isNull() | (F.trim("expediente") == "")
    sections = one.where(~empty).select("path", "obj_pos", "expediente", "idea_central", "materia_preliminar", F.explode("contenido").alias("section", "v"))
    rows = sections.select("path", "obj_pos", "expediente", "section", F.posexplode(F.try_variant_get("v", "$", "array<string>")).alias("paragraph_id", "text"), "idea_central", "materia_preliminar")
    stripped = F.regexp_replace("text", r"^\s+|\s+$", "")
    kept = rows.where(F.length(stripped) >= least)
    return (kept.withColumn("text", stripped) if strip else kept), one.where(empty).select("path", "obj_pos")


def enriched_paragraphs(rulings: DataFrame, least: int = 10) -> tuple[DataFrame, DataFrame]:
    """(paragraphs, rejects) as in ``paragraphs``, unstripped, each with its ruling's citations and metadata.

    articulos_citados is empty where a ruling has none, or none of that shape (an ``extra`` that is a lone text counts as a
    list of it); metadatos is the object as delivered.
    """
    rows, rejects = paragraphs(rulings, strip=False, least=least)
    v = lambda path, kind: F.try_variant_get("ruling", path, kind)
    text = lambda c, name: F.try_variant_get(c, f"$.{name}", "string")
    many = lambda c, name, kind: F.try_variant_get(c, f"$.{name}", f"array<{kind}>")
    lone = lambda c: F.when(text(c, "extra").isNotNull() & many(c, "extra", "string").isNull(), F.array(text(c, "extra")))
    one = lambda c: F.struct(text(c, "main_source").alias("main_source"), many(c, "cited_articles", "int").alias("cited_articles"), F.coalesce(many(c, "extra", "string"), lone(c)).alias("extra"))
    cited = F.transform(v("$.METADATOS.ARTICULOS_CITADOS.citations", "array<variant>"), one).cast(CITATIONS)
    meta = rulings.select("path", "obj_pos", F.coalesce(cited, F.array().cast(CITATIONS)).alias("articulos_citados"), v("$.METADATOS", "variant").alias("metadatos"))
    return rows.join(meta, ["path", "obj_pos"]), rejects


def run_id(at: Column | None = None) -> Column:
    """The name of a run: its time as yyyyMMdd_HHmmss."""
    return F.date_format(F.current_timestamp() if at is None else at, "yyyyMMdd_HHmmss")


def write_json(rows: DataFrame, folder: str, *by: str) -> None:
    rows.write.mode("overwrite").partitionBy(*by).json(folder)


def write_text(rows: DataFrame, folder: str, text: str, *by: str) -> None:
    rows.select(text, *by).write.mode("overwrite").partitionBy(*by).text(folder)


def write_results(metrics: DataFrame, folder: str, run: str | None = None) -> str:
    """Results of a run, in folders by run and test; without a name the run is called by its time. Returns the name."""
    run = run or metrics.sparkSession.range(1).select(run_id()).first()[0]
    metrics.withColumn("run", F.lit(run)).write.mode("append").partitionBy("run", "test").json(folder)
    return run


def read_results(spark: SparkSession, folder: str, run: str) -> DataFrame:
    return spark.read.option("basePath", folder).json(f"{folder}/run={run}")


def query_list(spark: SparkSession, path: str) -> DataFrame:
    """(qid, question) of a JSON array of strings, numbered from 0; anything else raises when read."""
    text = spark.read.option("wholetext", "true").text(path)
    parsed = F.from_json("value", "array<string>")
    checked = F.when(parsed.isNull(), F.raise_error(F.lit("not a JSON array of strings"))).otherwise(parsed)
    return text.select(F.posexplode(checked).alias("qid", "question"))


def question_files(spark: SparkSession, folder: str) -> DataFrame:
    """(expected, question_type, question_no, question): questions numbered from 1; the id falls back on the file's name."""
    files = raw_files(spark, folder).withColumn("j", F.from_json("text", "struct<json_id:string,question_type:string,questions:array<string>>"))
    rows = files.select(F.coalesce(F.nullif(F.col("j.json_id"), F.lit("")), stem(F.col("path"))).alias("expected"), F.col("j.question_type").alias("question_type"), F.posexplode("j.questions").alias("p", "question"))
    return rows.select("expected", "question_type", (F.col("p") + 1).alias("question_no"), "question")


def require_rows(rows: DataFrame, name: str) -> DataFrame:
    if rows.isEmpty():
        raise ValueError(f"{name} is empty")
    return rows


def missing(inputs: DataFrame, outputs: DataFrame, key: str) -> DataFrame:
    """The inputs without an output: what a resumed job has yet to do."""
    return inputs.join(outputs.select(key), key, "left_anti")


def staleness(spark: SparkSession, folder: str, index: str) -> str:
    """NO_JSON_FILES, NO_INDEXES, NEEDS_UPDATE or UP_TO_DATE by the newest modification times."""

    def newest(path: str, glob: str):  # noqa: ANN202
        try:
            files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
            return files.agg(F.max("modificationTime")).first()[0]
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise

    source, built = newest(folder, "*.json"), newest(index, "*.parquet")
    if source is None:
        return "NO_JSON_FILES"
    return "NO_INDEXES" if built is None else "NEEDS_UPDATE" if source > built else "UP_TO_DATE"

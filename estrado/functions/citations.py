"""Legal citations in text and in citation structs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Patterns of article and law mentions, with the number of their groups; fixed values.
MENTIONS = (
    (r"-?arts?\.\s*(\d+(?:º|°)?)(?:\s*[,y]\s*(\d+(?:º|°)?))*", 2),
    (r"Art(?:ículo)?s?\.\s*(\d+(?:º|°)?)(?:\s*[,y]\s*(\d+(?:º|°)?))*", 2),
    (r"del\s+art\.?\s*(\d+(?:º|°)?)", 1),
    (r"artículos?\s+(\d+(?:º|°)?)(?:\s*[,y]\s*(\d+(?:º|°)?))*", 2),
    (r"ley\s+n?º?\s*(\d+(?:/\d+)?)", 1),
    (r"leyes?\s+n?º?\s*(\d+(?:/\d+)?)(?:\s*[,y]\s*(\d+(?:/\d+)?))*", 2),
    (r"(?:arts?\.|artículos?|Art\.)\s*[^\d]*(\d+(?:º|°)?(?:\s*[,y]\s*\d+(?:º|°)?)*(?:\s*y\s*\d+(?:º|°)?)?)", 1),
    (r"(?:-?arts?\.|artículos?|Art\.)\s*([0-9º°,\s\-y]+?)(?:\s+de\s+la\s+ley|\s+Ac\.|\.|\s|$)", 1),
)
NUMBER = r"\d+(?:º|°)?"
#: Articles cited under no source that belong to a known law; fixed values.
MOVED = {28: "Ley 7046", 29: "Ley 7046", 114: "Ley 7046", 33: "Ley 10.704"}
OTHER = "Otro"


def mentioned(text: Column) -> Column:
    """The numbers of all articles and laws mentioned, distinct and in order."""
    groups = F.concat(*[F.regexp_extract_all(text, F.lit(f"(?iu){p}"), F.lit(g)) for p, n in MENTIONS for g in range(1, n + 1)])
    return F.array_sort(F.array_distinct(F.flatten(F.transform(groups, lambda x: F.regexp_extract_all(x, F.lit(NUMBER), F.lit(0))))))


def extraction_holds(text: Column, expected: Column) -> Column:
    """Whether the numbers found in ``text`` are exactly the expected ones."""
    return mentioned(text) == F.array_sort(F.array_distinct(expected))


def articles_of(citations: Column) -> Column:
    """Of null citations an empty list."""
    return F.coalesce(citations, F.array().cast("array<int>"))


def frequency(citations: DataFrame, source: str = "main_source", articles: str = "cited_articles") -> DataFrame:
    """(source, article, n): how often each article of a source is cited.

    A source of empty lists only stays with a null article and 0; one of null lists only is left out, as are null sources.
    """
    rows = citations.where(F.col(source).isNotNull() & F.col(articles).isNotNull())
    long = rows.select(F.col(source).alias("source"), F.explode_outer(articles).alias("article"))
    counted = long.groupBy("source", "article").agg(F.count("article").alias("n"))
    total = F.sum("n").over(_of("source"))
    return counted.withColumn("_t", total).where(F.col("article").isNotNull() | (F.col("_t") == 0)).drop("_t")


def _of(column: str):  # noqa: ANN202
    from pyspark.sql import Window

    return Window.partitionBy(column)


def normalize(citations: DataFrame, key: str, source: str = "main_source", articles: str = "cited_articles", extra: str = "extra") -> DataFrame:
    """(key, main_source, articles, extras): the citations of a ruling, one row a source.

    Articles and notes of a source are united and sorted; articles known to belong to a law move there from the source
    without a name, which goes if no article is left to it. Null sources are dropped; null lists count as empty.
    """
    rows = citations.where(F.col(source).isNotNull()).select(key, F.col(source).alias("s"), F.explode_outer(articles_of(F.col(articles))).alias("a"), F.col(extra).alias("e"))
    law = F.try_element_at(F.create_map(*[F.lit(x) for kv in MOVED.items() for x in kv]), F.col("a"))
    target = F.when(F.col("s") == OTHER, F.coalesce(law, F.col("s"))).otherwise(F.col("s"))
    moved = rows.select(key, target.alias("main_source"), F.col("a"), F.when(target == F.col("s"), F.col("e")).alias("e"))
    kept = rows.where((F.col("s") == OTHER)).select(key, F.col("s").alias("main_source"), F.lit(None).cast("int").alias("a"), F.col("e"))
    grouped = moved.unionByName(kept).groupBy(key, "main_source").agg(F.array_sort(F.collect_set("a")).alias("articles"), F.array_sort(F.collect_set("e")).alias("extras"))
    return grouped.where((F.col("main_source") != OTHER) | (F.size("articles") > 0))


def bullet(source: Column, articles: Column) -> Column:
    """A citation as a sentence for a reader, null without a source."""
    name = F.nullif(F.trim(source), F.lit(""))
    label = F.when(F.size(articles) == 1, F.lit("artículo")).otherwise(F.lit("artículos"))
    with_articles = F.concat(F.lit('**"'), name, F.lit('"** '), label, F.lit(" "), F.array_join(articles.cast("array<string>"), ", "), F.lit("."))
    return F.when(F.size(articles) > 0, with_articles).otherwise(F.concat(F.lit('**"'), name, F.lit('"**.')))


def inline(citations: Column) -> Column:
    """All citations of a ruling in one line; a dash without any."""
    one = lambda c: F.concat(F.coalesce(c["main_source"], F.lit("")), F.lit(" "), F.array_join(articles_of(c["cited_articles"]).cast("array<string>"), ", "))
    return F.when(F.size(citations) > 0, F.array_join(F.transform(citations, one), ", ")).otherwise("-")

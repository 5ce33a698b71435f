"""Problem 6: items that appear together, and how far that exceeds chance.

Items are deduplicated per basket, items too rare to reach the asked support are left out (no pair with them can reach
it), ordered pairs are emitted block by block, their counts combine on the map side, and lift and pointwise mutual
information follow from the marginals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estrado.plans.scratch import materialize

#: Items of a basket that are paired at once; larger baskets are cut into blocks first and go out as pairs of blocks.
BLOCK = 512


def cooccurrences(items: DataFrame, basket: str, item: str, group: str | None = None, least: int = 1) -> DataFrame:
    """(item_a, item_b, n, n_a, n_b, n_baskets, lift, pmi) of the pairs of items in at least ``least`` baskets together.

    ``item`` is any orderable column, the smaller item of a pair comes first; ``group``: only pairs whose values of that
    column (one per item) differ. Null baskets and null items don't count, repeated rows count once, and baskets of one
    item count for the marginals; empty input gives no rows. A basket of any size is paired whole.
    """
    rows = items.where(F.col(basket).isNotNull() & F.col(item).isNotNull())
    rows = materialize(rows.select(F.col(basket).alias("_b"), F.col(item).alias("_i"), (F.col(group) if group else F.lit(0)).alias("_g")).distinct())
    baskets = rows.agg(F.countDistinct("_b").alias("n_baskets"))
    support = materialize(rows.groupBy("_i").agg(F.count("*").alias("_n")).where(F.col("_n") >= least))
    frequent = materialize(rows.join(support, "_i").drop("_n"))
    # Blocks by the items' hash, so that no row ever holds more of a basket than about a block.
    sizes = frequent.groupBy("_b").agg(F.count("*").alias("_n")).where("_n > 1").select("_b", F.ceil(F.col("_n") / BLOCK).alias("_blocks"))
    placed = frequent.join(sizes, "_b").withColumn("_k", F.pmod(F.xxhash64("_i"), F.col("_blocks")))
    blocks = materialize(placed.groupBy("_b", "_blocks", "_k").agg(F.array_sort(F.collect_list(F.struct("_i", "_g"))).alias("_s")))
    apart = lambda y: F.lit(True) if group is None else ~F.col("a._g").eqNullSafe(y["_g"])
    own = blocks.select(F.posexplode("_s").alias("_p", "a"), "_s").select("a", F.explode(F.filter(F.slice("_s", F.col("_p") + 2, F.size("_s")), apart)).alias("b"))
    large = blocks.where("_blocks > 1")
    left = large.where("_k < _blocks - 1").select("_b", F.col("_k").alias("_x"), F.explode(F.sequence(F.col("_k") + 1, F.col("_blocks") - 1)).alias("_y"), "_s")
    right = large.where("_k > 0").select("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_k") - 1)).alias("_x"), F.col("_k").alias("_y"), F.col("_s").alias("_t"))
    across = left.join(right, ["_b", "_x", "_y"]).select(F.explode("_s").alias("a"), "_t").select("a", F.explode(F.filter("_t", apart)).alias("b"))
    pairs = own.unionByName(across).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    counts = pairs.groupBy(F.col("a._i").alias("item_a"), F.col("b._i").alias("item_b")).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    of = lambda side: support.select(F.col("_i").alias(f"item_{side}"), F.col("_n").alias(f"n_{side}"))
    out = counts.join(of("a"), "item_a").join(of("b"), "item_b").crossJoin(F.broadcast(baskets))  # baskets: one row
    lift = F.col("n") * F.col("n_baskets") / (F.col("n_a").cast("double") * F.col("n_b"))
    return out.select("item_a", "item_b", "n", "n_a", "n_b", "n_baskets", lift.alias("lift"), F.log2(lift).alias("pmi"))


def cited_items(citations: DataFrame, reference: DataFrame) -> DataFrame:
    """(id_fallo, source_id, article) of the citations whose source is exactly a canonical name."""
    rows = citations.where("id_fallo is not null and cited_articles is not null")
    rows = rows.join(reference.select("source_id", F.col("canonical_name").alias("main_source")), "main_source")
    return rows.select("id_fallo", "source_id", F.explode("cited_articles").alias("article")).where("article is not null")


def found(citations: DataFrame, reference: DataFrame, least: int = 6, times: int = 4) -> DataFrame:
    """p6_found: articles of different sources cited together in at least six rulings and four times as often as by chance.

    Null rulings, sources, lists and articles, and sources that are no canonical name, don't count; repeats count once.
    """
    items = cited_items(citations, reference).withColumn("item", F.struct("source_id", "article"))
    pairs = cooccurrences(items, "id_fallo", "item", "source_id", least)
    often = pairs.where(F.col("n") * F.col("n_baskets") >= times * F.col("n_a") * F.col("n_b"))
    return often.select(F.col("item_a.source_id").alias("source_a"), F.col("item_a.article").alias("article_a"), F.col("item_b.source_id").alias("source_b"), F.col("item_b.article").alias("article_b"))


FOUND_SQL = """
WITH items AS (
  SELECT DISTINCT id_fallo, source_id, article
  FROM (SELECT c.id_fallo, r.source_id, unnest(c.cited_articles) AS article
        FROM ruling_citations c JOIN fuentes_ref r ON c.main_source = r.canonical_name
        WHERE c.id_fallo IS NOT NULL) WHERE article IS NOT NULL),
total AS (SELECT count(DISTINCT id_fallo) AS n_baskets FROM items),
support AS (SELECT source_id, article, count(*) AS n FROM items GROUP BY ALL),
pairs AS (
  SELECT a.source_id AS source_a, a.article AS article_a, b.source_id AS source_b, b.article AS article_b, count(*) AS n
  FROM items a JOIN items b ON a.id_fallo = b.id_fallo AND a.source_id < b.source_id GROUP BY ALL HAVING count(*) >= 6)
SELECT source_a, article_a, source_b, article_b
FROM pairs p JOIN support x ON p.source_a = x.source_id AND p.article_a = x.article
JOIN support y ON p.source_b = y.source_id AND p.article_b = y.article CROSS JOIN total
WHERE p.n * n_baskets >= 4 * x.n * y.n
"""

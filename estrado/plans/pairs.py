"""Pairs within classes of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Members of a class that meet in one group of a join.
BLOCK = 1000


def pairs_within(rows: DataFrame, by: list[str], key: str, block: int = BLOCK) -> DataFrame:
    """(by..., a, b): every two different values a < b of ``key`` in a class, once each.

    ``rows`` holds each (by, key) once, without nulls. Classes are cut into blocks by the hash of ``key``, and every two
    blocks meet under a join key of their own, so a class that holds most rows is spread over many tasks.
    """
    sizes = rows.groupBy(*by).agg(F.count("*").alias("_n")).where("_n > 1").select(*by, F.ceil(F.col("_n") / block).alias("_blocks"))
    placed = rows.join(sizes, by).withColumn("_p", F.pmod(F.xxhash64(key), F.col("_blocks")))
    left = placed.select(*by, F.col("_p"), F.explode(F.sequence("_p", F.col("_blocks") - 1)).alias("_q"), F.col(key).alias("_x"))
    right = placed.select(*by, F.explode(F.sequence(F.lit(0).cast("long"), "_p")).alias("_p"), F.col("_p").alias("_q"), F.col(key).alias("_y"))
    met = left.join(right, [*by, "_p", "_q"]).where("_p < _q or _x < _y")
    return met.select(*by, F.least("_x", "_y").alias("a"), F.greatest("_x", "_y").alias("b"))

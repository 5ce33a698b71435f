"""Rows whose key comes once, told from the others without moving them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estrado.plans.scratch import materialize

#: Most repeated keys that are broadcast; beyond it every row counts as repeated.
REPEATED = 1_000_000


def split_repeats(rows: DataFrame, key: str, most: int = REPEATED) -> tuple[DataFrame | None, DataFrame | None]:
    """(rows whose ``key`` comes once, all others and those without a key), None where there are none or too many to tell.

    The keys are counted from their column alone; only the rows of the second frame need a shuffle afterwards.
    """
    again = materialize(rows.groupBy(F.col(key).alias("_again")).agg(F.count("*").alias("n")).where("n > 1 or _again is null").select("_again"))
    count = again.count()
    if not count:
        return rows, None
    if count > most:
        return None, rows
    same = F.col(key).eqNullSafe(F.col("_again"))
    return rows.join(F.broadcast(again), same, "left_anti"), rows.join(F.broadcast(again), same, "left_semi")  # at most ``most`` keys


def distinct_rows(rows: DataFrame, key: str, most: int = REPEATED) -> DataFrame:
    """``rows.distinct()`` for rows of which few share their ``key``: the others stay where they are."""
    once, more = split_repeats(rows, key, most)
    parts = [p for p in (once, more.distinct() if more is not None else None) if p is not None]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

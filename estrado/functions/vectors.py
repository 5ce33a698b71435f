"""Vectors held as arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector is all zeros."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))


def hashed(tokens: Column, size: int = 64) -> Column:
    """Term counts of ``tokens`` in ``size`` hashed places, with a sign each: the local stand-in for a text encoder."""
    at = lambda t: F.pmod(F.xxhash64(t), F.lit(size))
    sign = lambda t: F.when(F.pmod(F.xxhash64(F.lit("sign"), t), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    held = F.transform(tokens, lambda t: F.struct(at(t).alias("p"), sign(t).alias("s")))
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.aggregate(F.filter(held, lambda h: h["p"] == k), F.lit(0.0), lambda s, h: s + h["s"]))

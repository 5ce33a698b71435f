"""Comparison of sets held as arrays, and classification metrics. Every ratio without a denominator is 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def f1(precision: Column, recall: Column) -> Column:
    return ratio(2 * precision * recall, precision + recall)


def compare(original: Column, modified: Column) -> dict[str, Column]:
    """Missing, extra and common elements, precision, recall, F1 and exact equality (1.0 of two empty sets)."""
    x, y = F.array_distinct(original), F.array_distinct(modified)
    common = F.array_intersect(x, y)
    p, r = ratio(F.size(common), F.size(y)), ratio(F.size(common), F.size(x))
    return {"n_missing": F.size(F.array_except(x, y)), "n_extra": F.size(F.array_except(y, x)), "n_common": F.size(common), "precision": p, "recall": r, "f1": f1(p, r), "accuracy": (F.array_sort(x) == F.array_sort(y)).cast("double")}


def jaccard(a: Column, b: Column) -> Column:
    return ratio(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def dice(a: Column, b: Column) -> Column:
    return ratio(2 * F.size(F.array_intersect(a, b)), F.size(F.array_distinct(a)) + F.size(F.array_distinct(b)))


def overlap(a: Column, b: Column) -> Column:
    """Common elements by those of the smaller set."""
    return ratio(F.size(F.array_intersect(a, b)), F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b))))


def classification(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    """Accuracy is TP / (TP + FP + FN) where nothing is truly negative."""
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    accuracy = F.when(tn > 0, ratio(tp + tn, tp + fp + fn + tn)).otherwise(ratio(tp, tp + fp + fn))
    return {"accuracy": accuracy, "precision": p, "recall": r, "f1": f1(p, r)}

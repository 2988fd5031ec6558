"""Metric expressions. A zero denominator gives 0.0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the normal quantile of a two-sided 95 % interval.
Z95 = 1.959963984540054


def ratio(n: Column, d: Column) -> Column:
    return F.when(d == 0, F.lit(0.0)).otherwise(n.cast("double") / d)


def precision_recall_f1(tp: Column, fp: Column, fn: Column, beta: float = 1.0) -> dict[str, Column]:
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    b = beta * beta
    return {"precision": p, "recall": r, "f1" if beta == 1 else "fbeta": ratio((1 + b) * p * r, b * p + r)}


def wilson_lower(k: Column, n: Column, z: float = Z95) -> Column:
    """Lower end of the score interval of k in n, at least 0."""
    p, z2 = k / n, z * z
    low = (p + z2 / (2 * n) - z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n)
    return F.greatest(F.lit(0.0), low)


def laplace(k: Column, n: Column) -> Column:
    return (k + 1) / (n + 2)


def jaccard(a: Column, b: Column) -> Column:
    """1.0 for two empty sets."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def blank_as(value: Column, default: str) -> Column:
    """Null and empty strings stand for a default."""
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(default))


def natural_key(column: str) -> list[Column]:
    """Numbers first by value, then other strings."""
    number = F.col(column).rlike("^[0-9]+$")
    return [F.when(number, 0).otherwise(1), F.when(number, F.col(column).cast("decimal(38,0)")), F.col(column)]

"""Vector and score functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / n)


def min_max(c: Column, over=None) -> Column:
    """Scaled to 0..1 over the window; 0 where all values are equal."""
    w = W.partitionBy() if over is None else over
    low, high = F.min(c).over(w), F.max(c).over(w)
    return F.when(high == low, 0.0).otherwise((c - low) / (high - low))


def share(c: Column, over=None) -> Column:
    """Divided by the window's sum."""
    total = F.sum(c).over(W.partitionBy() if over is None else over)
    return F.when(total == 0, 0.0).otherwise(c / total)


def within_budget(size: Column, order: list[Column], budget: int, by: list[str] | None = None) -> Column:
    """Whether a row is in the longest prefix whose sizes sum to at most the budget."""
    w = W.partitionBy(*(by or [])).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return F.sum(size).over(w) <= budget

"""Similarities as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _d(c: Column | str) -> Column:
    return F.transform(F.col(c) if isinstance(c, str) else c, lambda x: x.cast("double"))


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_d(a), _d(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column | str, b: Column | str) -> Column:
    """0 where a vector has no length."""
    return F.coalesce(dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0)), F.lit(0.0))


def jaccard(a: Column | str, b: Column | str) -> Column:
    return F.coalesce(F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0)), F.lit(0.0))


def set_distance(a: Column | str, b: Column | str) -> Column:
    """0 for equal sets, 1 - 2J/3 if one holds the other, 1 - J/3 if they overlap, else 1 (J: Jaccard)."""
    a, b = (F.array_distinct(F.col(x) if isinstance(x, str) else x) for x in (a, b))
    both = F.size(F.array_intersect(a, b))
    j = jaccard(a, b)
    equal = (F.size(a) == both) & (F.size(b) == both)
    nested = (F.size(a) == both) | (F.size(b) == both)
    return F.when(equal, 0.0).when(both == 0, 1.0).when(nested, 1 - j * 2 / 3).otherwise(1 - j / 3)

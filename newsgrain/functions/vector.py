"""Vector and set similarities by higher-order functions, guarded for empty input."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector is null, empty or zero."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.coalesce(F.size(a), F.lit(0)) > 0) & (F.coalesce(F.size(b), F.lit(0)) > 0) & (n > 0), dot(a, b) / n).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    """Share of common members of two arrays; 0 if both are empty."""
    u = F.size(F.array_union(a, b))
    return F.when(u > 0, F.size(F.array_intersect(a, b)) / u).otherwise(0.0)

"""Vector and map arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 where either has no length."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(0.0)


def synonym_score(a: Column, b: Column, cutoff: float = 0.4) -> Column:
    """Cosine above the cutoff, else 0; 0 where a vector is missing."""
    c = F.when(a.isNotNull() & b.isNotNull(), cosine(a, b)).otherwise(0.0)
    return F.when(c > cutoff, c).otherwise(0.0)


def feature_diff(a: Column, b: Column) -> Column:
    """Difference of two maps over all their keys, a missing key counting as 0."""
    return F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x, F.lit(0.0)) - F.coalesce(y, F.lit(0.0)))

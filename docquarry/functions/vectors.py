"""Vector expressions on ``array<float>`` columns, computed in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null when either vector has no length."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n)


def is_usable(v: Column) -> Column:
    """Neither missing, empty nor all zero."""
    return F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))


def stored(v: Column) -> Column:
    """Vectors are stored with six decimals."""
    return F.transform(_double(v), lambda x: F.round(x, 6)).cast("array<float>")

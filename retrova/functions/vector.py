"""Vector functions as column expressions over arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Shortest length by which a vector is divided, so that the zero vector stays zero (fixed value).
LEAST_NORM = 1e-12


def _double(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def norm(v: Column | str) -> Column:
    return F.sqrt(F.aggregate(_double(v), F.lit(0.0), lambda s, x: s + x * x))


def normalize(v: Column | str) -> Column:
    """The vector scaled to length 1; the zero vector as it is."""
    length = F.greatest(norm(v), F.lit(LEAST_NORM))
    return F.transform(_double(v), lambda x: x / length)


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column | str, b: Column | str) -> Column:
    return dot(a, b) / (F.greatest(norm(a), F.lit(LEAST_NORM)) * F.greatest(norm(b), F.lit(LEAST_NORM)))

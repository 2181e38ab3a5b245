"""Dense vector expressions (J3) on ``array<float|double>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def dot(a: Column | str, b: Column | str) -> Column:
    """Sum of element products in double precision (arrays of equal length)."""
    prods = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prods, F.lit(0.0).cast("double"), lambda acc, z: acc + z)


def norm(a: Column | str) -> Column:
    """Euclidean length; compute once per row and keep it as a column."""
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str, norm_a: Column | None = None,
           norm_b: Column | None = None) -> Column:
    """Cosine similarity; NULL when either vector has zero length."""
    na = norm(a) if norm_a is None else norm_a
    nb = norm(b) if norm_b is None else norm_b
    denom = na * nb
    return F.when(denom > 0, dot(a, b) / denom)

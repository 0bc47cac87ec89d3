"""Vector expressions on ARRAY<FLOAT|DOUBLE> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a, b) -> Column:
    prods = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prods, F.lit(0.0), lambda acc, x: acc + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine_similarity(a, b) -> Column:
    """Cosine of two vectors; null when either is null/empty or has zero norm."""
    denom = norm(a) * norm(b)
    ok = (F.size(_col(a)) > 0) & (F.size(_col(b)) > 0) & (denom > 0)
    return F.when(ok, dot(a, b) / denom)


def class_scores(a, classes: int) -> Column:
    """One score per class from the whole vector: dimension i counts towards class i % classes."""
    arr = _col(a)
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda c: F.aggregate(
        F.filter(F.transform(arr, lambda x, i: F.struct(x.cast("double").alias("x"), i.alias("i"))),
                 lambda e: e["i"] % classes == c),
        F.lit(0.0), lambda acc, e: acc + e["x"]))


def argmax(a) -> Column:
    """Zero-based position of the largest element, the first on ties; null for an empty or null vector."""
    arr = _col(a)
    return F.when(F.size(arr) > 0, F.array_position(arr, F.array_max(arr)) - 1)

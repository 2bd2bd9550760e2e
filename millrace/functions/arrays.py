"""Vector expressions over array<float> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _doubles(v) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def dot(a, b) -> Column:
    """Sum of products in index order."""
    return F.aggregate(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v) -> Column:
    return F.sqrt(dot(v, v))


def unit(v, eps: float = 1e-12) -> Column:
    """The vector at length one; vectors shorter than eps are divided by eps."""
    n = F.greatest(norm(v), F.lit(eps))
    return F.transform(_doubles(v), lambda x: x / n)


def cosine(a, b) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(1e-12))


def whiten(v, diagonal, damping: float = 1e-6) -> Column:
    """v / sqrt(diagonal + damping), element by element."""
    return F.zip_with(_doubles(v), _doubles(diagonal), lambda x, d: x / F.sqrt(d + damping))


def project(v, rows: list[list[float]]) -> Column:
    """The product of a small fixed matrix with the vector, as an expression."""
    return F.array(*[dot(v, F.array(*[F.lit(float(x)) for x in row])) for row in rows])


def argmax(v) -> Column:
    """0-based place of the first largest element."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")

"""Vector arithmetic as columns over array<double>, evaluated in the JVM. A null vector or element gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def literal(vector: list[float]) -> Column:
    """A query vector as a constant, which is folded once."""
    return F.array(*[F.lit(float(x)) for x in vector])


def dot(a: Column | str, b: Column | str) -> Column:
    return _sum(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")))


def magnitude(v: Column | str) -> Column:
    return F.sqrt(_sum(F.transform(_col(v), lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column | str, b: Column | str) -> Column:
    """0 where either vector is all zero."""
    na, nb = magnitude(a), magnitude(b)
    return F.when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(dot(a, b) / (na * nb))


def euclidean(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(_sum(F.zip_with(_col(a), _col(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def normalize(v: Column | str) -> Column:
    """Scaled to length 1; an all-zero vector stays as it is."""
    n = magnitude(v)
    return F.when(n == 0, _col(v).cast("array<double>")).otherwise(F.transform(_col(v), lambda x: x.cast("double") / n))


def is_valid(v: Column | str, dimension: int) -> Column:
    """True for an array of ``dimension`` finite numbers, false for all else, null included."""
    fine = F.forall(_col(v), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.coalesce((F.size(_col(v)) == dimension) & fine, F.lit(False))

"""Vector functions over arrays, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """The vector over its length, the length being 1e-9 at least."""
    n = F.greatest(norm(a), F.lit(1e-9))
    return F.transform(a, lambda x: x.cast("double") / n)


def cosine(a: Column, b: Column) -> Column:
    """Dot product over the product of lengths, that being 1e-9 at least."""
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(1e-9))


def strict_cosine(a: Column, b: Column) -> Column:
    """0 where a vector has no length; vectors of different sizes are an error."""
    n = norm(a) * norm(b)
    value = F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)
    return F.when(F.size(a) == F.size(b), value).otherwise(F.raise_error(F.lit("vectors of different sizes")).cast("double"))

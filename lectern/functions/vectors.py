"""Vectors as arrays, computed in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalized(a: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    size = norm(a)
    # an array of one element, so that the norm is computed once a row and not once an element
    return F.element_at(F.transform(F.array(F.when(size > 0, size).otherwise(F.lit(1.0))), lambda n: F.transform(a, lambda x: x.cast("double") / n)), 1)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of the angle; 0 where a vector is zero."""
    both = norm(a) * norm(b)
    return F.when(both > 0, dot(a, b) / both).otherwise(F.lit(0.0))

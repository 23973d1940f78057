"""Vector functions over array columns; sums run in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from placelens.functions.text import let


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)


def norm(a: Column) -> Column:
    squares = lambda total, x: total + x.cast("double") * x.cast("double")
    return F.sqrt(F.aggregate(a, F.lit(0.0), squares))


def normalise(a: Column) -> Column:
    """Unit vector as float32; a zero vector stays zero."""
    unit = lambda length: F.transform(
        a, lambda x: F.when(length > 0, x.cast("double") / length).otherwise(F.lit(0.0)).cast("float")
    )
    return let(norm(a), unit)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if either vector is zero."""
    scaled = lambda lengths: F.when(lengths > 0, dot(a, b) / lengths).otherwise(F.lit(0.0))
    return let(norm(a) * norm(b), scaled)

"""Vectors as exact integers: the usable rows of a table of embeddings, each component floor(scale * x)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sums of products and squared distances have to stay below this to be exact in a long.
MOST = 1 << 62


def usable(vectors: DataFrame, id_col: str, vector_col: str, **others: Column) -> DataFrame:
    """__id, __x (array of doubles) and the others: rows whose vector has components and none that is null or not finite."""
    x = F.col("__x")
    named = vectors.select(F.col(id_col).cast("long").alias("__id"), F.col(vector_col).cast("array<double>").alias("__x"), *(c.alias(n) for n, c in others.items()))
    return named.filter(x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))))


def largest(scale: int) -> Column:
    """The largest magnitude of a floor in __x, as a double."""
    return F.coalesce(F.max(F.array_max(F.transform("__x", lambda c: F.abs(c * scale) + 1))), F.lit(0.0))


def floors(scale: int, most: float) -> Column:
    """floor(scale * x) of every component of __x: ints where `most` allows it, else longs."""
    return F.transform("__x", lambda c: F.floor(c * scale)).cast("array<int>" if most < 1 << 31 else "array<long>")

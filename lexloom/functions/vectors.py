"""Vectors as arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column, b_norm: Column | None = None) -> Column:
    """Cosine of two vectors; -1 if their lengths differ, one is empty or has norm zero."""
    size = norm(a) * (norm(b) if b_norm is None else b_norm)
    usable = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (size > 0)
    return F.when(usable, dot(a, b) / F.nullif(size, F.lit(0.0))).otherwise(F.lit(-1.0))


def l2_normalize(a: Column) -> Column:
    """The vector at length 1; a zero vector stays as it is."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x / F.nullif(n, F.lit(0.0)))).otherwise(a)


def rounded(a: Column, places: int = 6) -> Column:
    return F.transform(a, lambda x: F.round(x, places))


def parse(c: Column) -> Column:
    """A JSON array as a vector; anything else is empty."""
    return F.coalesce(F.from_json(c, "array<double>"), F.array().cast("array<double>"))


def is_embedded(a: Column) -> Column:
    """Rows that have an embedding: more than 10 values."""
    return F.coalesce(F.size(a) > 10, F.lit(False))


def lacks_embedding(a: Column) -> Column:
    """Rows that need one: fewer than 10 values. Just 10 are neither."""
    return F.coalesce(a.isNull() | (F.size(a) < 10), F.lit(True))


def mean_pool(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """One vector per key: the mean of its vectors, component by component."""
    each = rows.select(key, F.posexplode(vector).alias("i", "x")).groupBy(key, "i").agg(F.avg("x").alias("x"))
    return each.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias(vector))

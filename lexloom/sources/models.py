"""Embedding and text models behind a function, with batching, retries and checks; offline runs pass their own."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

Model = Callable[[list[str]], list[list[float]]]


def with_retries(call: Callable, tries: int = 3, wait: float = 0.4, factor: float = 2.0, retry: Callable[[Exception], bool] = lambda e: True) -> Callable:
    """call with growing waits between tries; an error that retry() refuses is raised at once."""

    def run(*args):
        for k in range(tries):
            try:
                return call(*args)
            except Exception as e:
                if k + 1 == tries or not retry(e):
                    raise
                time.sleep(wait * factor**k)

    return run


def embed(texts: Column, model: Model, dim: int, prefix: str = "passage: ", longest: int = 1800, batch: int = 8) -> Column:
    """Vectors of texts: prefixed, cut to the model's input, checked for number and dimension, at length 1."""

    @F.pandas_udf(ArrayType(DoubleType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        call = with_retries(model)
        for s in batches:
            out: list[list[float] | None] = []
            for at in range(0, len(s), batch):
                part = [prefix + (x or "")[:longest] for x in s[at : at + batch]]
                vectors = call(part)
                if len(vectors) != len(part) or any(len(v) != dim for v in vectors):
                    raise ValueError(f"the model gave {len(vectors)} vectors for {len(part)} texts, or not of {dim} values")
                for v in vectors:
                    a = np.asarray(v, float)
                    n = np.linalg.norm(a)
                    out.append((a / n if n else a).tolist())
            yield pd.Series(out)

    return run(texts)


def pooled(vectors: Column, dim: int) -> Column:
    """A model's answer as one vector: the mean of a matrix of token vectors; a wrong dimension fails."""
    mean = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.aggregate(vectors, F.lit(0.0), lambda s, v: s + F.get(v, i)) / F.size(vectors))
    wrong = F.exists(vectors, lambda v: F.size(v) != dim)
    return F.when(wrong, F.raise_error(F.lit("wrong dimension"))).otherwise(mean)


def embed_missing(rows: DataFrame, cache: DataFrame, key: str, texts: Column, model: Model, dim: int) -> DataFrame:
    """Rows with `embedding`: from the cache (key, embedding) where it has the key, else from the model, in one pass."""
    joined = rows.drop("embedding").join(cache.select(key, F.col("embedding").alias("__cached")), key, "left")
    known = joined.filter(F.col("__cached").isNotNull()).withColumn("embedding", F.col("__cached"))
    fresh = joined.filter(F.col("__cached").isNull()).withColumn("embedding", embed(texts, model, dim))
    return known.unionByName(fresh).drop("__cached")

"""Counts over the corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions.vectors import is_embedded


def by_type(chunks: DataFrame, column: str = "source_type") -> DataFrame:
    return chunks.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def by_dataset(chunks: DataFrame, column: str = "hf_dataset") -> DataFrame:
    """Rows per dataset; a null one is "unknown" and stays apart from a dataset of that name, as the raw column is grouped."""
    return chunks.groupBy(column).agg(F.count(F.lit(1)).alias("n")).select(F.coalesce(column, F.lit("unknown")).alias(column), "n")


def totals(chunks: DataFrame, embedding: str = "embedding", searchable: Column | None = None) -> DataFrame:
    """All rows, embedded rows and searchable rows in one pass."""
    return chunks.agg(F.count(F.lit(1)).alias("total"), F.count_if(is_embedded(F.col(embedding))).alias("embedded"), F.count_if(F.lit(True) if searchable is None else searchable).alias("searchable"))


def length_stats(chunks: DataFrame, size: Column) -> DataFrame:
    return chunks.select(size.alias("s")).agg(F.min("s").alias("least"), F.max("s").alias("most"), F.median("s").alias("median"), F.avg("s").alias("mean"), F.count("s").alias("n"))


def page_range(listing: DataFrame, page: str) -> DataFrame:
    return listing.agg(F.min(page).alias("first_page"), F.max(page).alias("last_page"), F.count_distinct(page).alias("pages"))


def by_dimension(rows: DataFrame, dimensions: dict[str, Column], size: Column) -> DataFrame:
    """(dimension, value, pages, characters): counts by each of several columns, in one pass over the rows."""
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("dimension"), value.alias("value")) for name, value in dimensions.items())))
    return rows.select(size.alias("__size"), each.alias("__d")).groupBy("__d.dimension", "__d.value").agg(F.count(F.lit(1)).alias("pages"), F.sum("__size").alias("characters"))

"""Writing tables and files. A table is a folder of Parquet; a rewrite is written beside it and swapped in."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions.text import search_text, search_tokens
from lexloom.operators import state


def append(rows: DataFrame, path: str, *partition_by: str) -> None:
    rows.write.mode("append").partitionBy(*partition_by).parquet(path)


def swap(rows: DataFrame, path: str, *partition_by: str) -> None:
    """Replace a table whose old rows may be read by the new ones: write beside, rename, and delete the old one last.

    A rename that fails is an error that leaves the old table in its place. A reader between the two renames finds none.
    """
    spark = rows.sparkSession
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    swap_in(place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), spark, rows, path, *partition_by)


def swap_in(fs, spark: SparkSession, rows: DataFrame, path: str, *partition_by: str) -> None:
    """swap on a given Hadoop file system."""
    fresh, old = f"{path}.{uuid.uuid4().hex}.new", f"{path}.{uuid.uuid4().hex}.old"
    rows.write.partitionBy(*partition_by).parquet(fresh)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path

    def move(a: str, b: str) -> None:
        if not fs.rename(place(a), place(b)):
            raise OSError(f"{a} could not be renamed to {b}")

    there = fs.exists(place(path))
    if there:
        move(path, old)
    try:
        move(fresh, path)
    except Exception:
        if there:
            move(old, path)
        raise
    if there:
        fs.delete(place(old), True)


def insert_ignore(rows: DataFrame, path: str, key: str) -> None:
    """Append the rows whose key the table lacks; first writer wins."""
    table = rows.sparkSession.read.schema(rows.schema).parquet(path)
    fresh = rows.groupBy(key).agg(F.min(F.struct(*(c for c in rows.columns if c != key))).alias("__row")).select(key, "__row.*").select(*rows.columns)
    append(fresh.join(table.select(key), key, "left_anti"), path)


def upsert(rows: DataFrame, path: str, key: str, updated: list[str]) -> None:
    table = rows.sparkSession.read.parquet(path)
    swap(state.upsert(table, rows, key, updated), path)


def scoped_replace(rows: DataFrame, path: str, scope: list[str]) -> None:
    swap(state.scoped_replace(rows.sparkSession.read.parquet(path), rows, scope), path)


def with_search_tokens(chunks: DataFrame, column: str = "tokens") -> DataFrame:
    """Chunks with their search tokens where those are null (the backfill of full-text search)."""
    found = search_tokens(search_text(F.col("source_title"), F.col("article_number"), F.col("content")))
    return chunks.withColumn(column, F.coalesce(F.col(column), found) if column in chunks.columns else found)


def stored_chunks(rows: DataFrame, schema_columns: list[str], longest: int = 3500) -> DataFrame:
    """Rows in the stored shape: known columns only, contents cut."""
    return rows.withColumn("content", F.substring("content", 1, longest)).select(*(F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in schema_columns))


def json_files(rows: DataFrame, path: str, compression: str = "none") -> None:
    """JSON lines; a committed write replaces a folder as a whole."""
    rows.write.mode("overwrite").option("compression", compression).json(path)


def retry_urls(pages: DataFrame, failed: Column) -> DataFrame:
    """Distinct urls of failed pages in order, for the next crawl."""
    return pages.filter(failed).select("url").distinct().orderBy("url")


def seed_registry(registry: DataFrame, sources: DataFrame) -> DataFrame:
    """The registry with the sources whose id it lacks."""
    return state.insert_ignore(registry, sources, "id")


def merge_sources(parts: list[DataFrame], existing: DataFrame, key: str = "id", replaced: Column | None = None) -> DataFrame:
    """One corpus from several sources: existing rows first (without those that `replaced` names), then new keys."""
    base = existing if replaced is None else existing.filter(~F.coalesce(replaced, F.lit(False)))
    fresh = parts[0]
    for p in parts[1:]:
        fresh = fresh.unionByName(p, allowMissingColumns=True)
    return state.insert_ignore(base, fresh, key)


def read_local(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(path)

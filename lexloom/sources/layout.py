"""Where stored chunks lie, for the joins and lookups that they serve: whole rows bucketed by id, and a narrow table of
article numbers partitioned by a slice of the number. Names and folders are the caller's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions.references import article_refs, match_values
from lexloom.functions.text import latin_digits
from lexloom.operators import retrieval

#: Folders of the table of article numbers; what a lookup names on the driver is at most so many integers.
SLICES = 64
ARTICLE = ("id", "source_type", "source_title", "article_number")


def store(rows: DataFrame, name: str, path: str, key: str = "id", buckets: int = 256) -> DataFrame:
    """Append rows to a table bucketed and sorted by key (made if missing), one file for each bucket a write; returns the table.

    Joins on the key then move the other side only (retrieved ids, cached vectors, new rows), whatever the size of the
    table. Take at least spark.sql.shuffle.partitions buckets: Spark shuffles both sides where a table has fewer.
    """
    rows.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).format("parquet").mode("append").saveAsTable(name)
    return rows.sparkSession.table(name)


def insert_ignore(rows: DataFrame, name: str, path: str, key: str = "id", buckets: int = 256) -> DataFrame:
    """store the rows whose key the table lacks; of rows with one key the smallest goes in, as in sinks.insert_ignore."""
    others = [c for c in rows.columns if c != key]
    one = rows.groupBy(key).agg(F.min(F.struct(*others)).alias("__row")).select(key, "__row.*").select(*rows.columns)
    return store(one.join(rows.sparkSession.table(name).select(key), key, "left_anti"), name, path, key, buckets)


def slice_of(number: Column) -> Column:
    """By the number's digits alone, so that its spellings share a slice."""
    return F.pmod(F.xxhash64(F.regexp_replace(latin_digits(number), "[^0-9]", "")), F.lit(SLICES)).cast("int")


def store_articles(rows: DataFrame, path: str) -> None:
    """Append the rows that have an article number, as ARTICLE, to folders by slice, sorted by number.

    Rows are dealt by ranges, so a number that a third of all rows carry is several tasks' work and lies in several files.
    """
    named = rows.filter("article_number is not null").select(*ARTICLE, slice_of(F.col("article_number")).alias("slice"))
    dealt = named.repartitionByRange("slice", "article_number", "id")
    dealt.sortWithinPartitions("slice", "article_number", "id").write.mode("append").partitionBy("slice").parquet(path)


def articles_asked(questions: DataFrame, path: str) -> DataFrame:
    """The stored article numbers in the slices that the questions ask for; the other folders are not read."""
    spark: SparkSession = questions.sparkSession
    asked = questions.select(F.explode(article_refs(F.col("question"))).alias("ref")).select(F.explode(match_values(F.col("ref"))).alias("value"))
    slices = [r[0] for r in asked.select(slice_of(F.col("value"))).distinct().collect()]
    return spark.read.parquet(path).filter(F.col("slice").isin(slices)).select(*ARTICLE)


def exact_lookup(questions: DataFrame, path: str, limit: int = retrieval.EXACT_LIMIT) -> DataFrame:
    """retrieval.exact_lookup over the table of article numbers: (question_id, id, source_type, source_title, article_number)."""
    return retrieval.exact_lookup(questions, articles_asked(questions, path), limit)

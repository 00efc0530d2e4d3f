"""Statistics that merge: a row for each source and day, with sketches for medians and distinct counts, so that totals over
any days come from the stored rows and a day that is added is the only one read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size of the quantile sketch: ranks are off by less than 0.5 % of the rows, with a confidence of 99 %.
QUANTILE_K = 800
#: Log of the registers of the distinct-count sketch: a standard error of 0.8 %.
DISTINCT_LG_K = 14

STORED = "source string, n long, least long, most long, total long, sizes binary, members binary, day date"


def by_day(rows: DataFrame, source: Column, day: Column, size: Column, member: Column) -> DataFrame:
    """STORED rows: each (source, day) with its count, least, most and total size, and sketches of sizes and members.

    Null sizes and members count in n alone; a null source or day is a group of its own. Sketches have a bounded size and
    are combined in each task before the shuffle, so a hot source costs no more than others.
    """
    named = rows.select(source.cast("string").alias("source"), size.cast("long").alias("s"), member.cast("string").alias("m"), day.cast("date").alias("day"))
    return named.groupBy("source", "day").agg(
        F.count(F.lit(1)).alias("n"), F.min("s").alias("least"), F.max("s").alias("most"), F.sum("s").alias("total"),
        F.kll_sketch_agg_bigint("s", QUANTILE_K).alias("sizes"), F.hll_sketch_agg("m", DISTINCT_LG_K).alias("members"),
    ).select("source", "n", "least", "most", "total", "sizes", "members", "day")


def refresh(statistics: DataFrame, path: str) -> None:
    """Write days of STORED rows into the table, partitioned by day; a day that is there is replaced, the others stay."""
    statistics.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def stored(spark, path: str) -> DataFrame:
    return spark.read.schema(STORED).parquet(path)


def merged(statistics: DataFrame, *by: str) -> DataFrame:
    """Statistics over the groups of `by` (source, day, or none for all): exact counts, bounds and means, estimated median
    and distinct members. Only stored rows are read. A group without sizes has a null median and mean."""
    sizes, members = F.kll_merge_agg_bigint("sizes", QUANTILE_K), F.hll_union_agg("members")
    known = statistics.groupBy(*by).agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"), F.sum("total").alias("total"), sizes.alias("__sizes"), members.alias("__members"))
    some = F.kll_sketch_get_n_bigint("__sizes")
    return known.select(*by, "n", "least", "most", "total", F.when(some > 0, F.col("total") / some).alias("mean"), F.when(some > 0, F.kll_sketch_get_quantile_bigint("__sizes", F.lit(0.5))).alias("median"), F.hll_sketch_estimate("__members").alias("members"))

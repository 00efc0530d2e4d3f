"""State tables: upserts, queues, rate limits, histories. Every read of the clock is a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions.text import resets_in, window_start


def insert_ignore(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The table with the rows whose key it lacks; of rows with one key the first writer (smallest values) wins."""
    fresh = rows.groupBy(key).agg(F.min(F.struct(*(c for c in rows.columns if c != key))).alias("__row")).select(key, "__row.*").select(*rows.columns)
    return table.unionByName(fresh.join(table.select(key), key, "left_anti"), allowMissingColumns=True)


def upsert(table: DataFrame, rows: DataFrame, key: str, updated: list[str]) -> DataFrame:
    """The table with the rows: known keys get only the `updated` columns, new ones all. A null in a row updates too.

    Of rows with one key the one with the largest values, compared column by column, counts.
    """
    others = [c for c in rows.columns if c != key]
    one = rows.groupBy(key).agg(F.max(F.struct(*others)).alias("__row")).select(key, *(F.col("__row")[c].alias(c) for c in others)) if others else rows.distinct()
    fresh = one.select(F.col(key).alias("__key"), F.struct(*rows.columns).alias("__new"))
    joined = table.withColumn("__old", F.lit(True)).join(fresh, F.col(key) == F.col("__key"), "full_outer")
    old, new = F.coalesce("__old", F.lit(False)), F.col("__new").isNotNull()
    pick = lambda c: F.when(new & (~old | F.lit(c in updated)), F.col("__new")[c]).otherwise(F.col(c)) if c in rows.columns else F.col(c)
    return joined.select(*(pick(c).alias(c) for c in table.columns))


def scoped_replace(table: DataFrame, rows: DataFrame, scope: list[str]) -> DataFrame:
    """The table with all rows of the scopes that `rows` has replaced by those rows."""
    return table.join(rows.select(*scope).distinct(), scope, "left_anti").unionByName(rows, allowMissingColumns=True)


def delete_owned(table: DataFrame, keys: DataFrame, key: str, owner: str) -> DataFrame:
    """The table without rows that match both key and owner."""
    return table.join(keys.select(key, owner).distinct(), [key, owner], "left_anti")


def expire(table: DataFrame, time: str, as_of: Column, older_than: str = "1 hour") -> DataFrame:
    return table.filter(F.col(time) >= as_of - F.expr(f"INTERVAL {older_than}"))


def rate_limit(events: DataFrame, key: str, ts: str, tie: str, seconds: int, limit: int) -> DataFrame:
    """Each event with its window, its number in it, whether it is allowed, and the seconds until the window ends.

    Denied requests count too. The window function runs per (key, window), which bounds what one group holds in time.
    """
    start = window_start(F.col(ts), seconds)
    hits = F.count(F.lit(1)).over(Window.partitionBy(key, "window_start").orderBy(ts, tie).rowsBetween(Window.unboundedPreceding, 0))
    counted = events.withColumn("window_start", start).withColumn("hits", hits)
    return counted.withColumns({"allowed": F.col("hits") <= limit, "remaining": F.greatest(F.lit(0), F.lit(limit) - F.col("hits")), "reset_in": resets_in(F.col(ts), seconds)})


def window_counts(events: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    return events.groupBy(key, window_start(F.col(ts), seconds).alias("window_start")).agg(F.count(F.lit(1)).alias("hits"))


def increment(table: DataFrame, events: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """The table (bucket_key, window_start, hits) with the events' hits added to their key and window."""
    more = window_counts(events, key, ts, seconds).select(F.col(key).cast("string").alias("bucket_key"), "window_start", F.col("hits").cast("long").alias("hits"))
    both = table.select("bucket_key", "window_start", F.col("hits").cast("long").alias("hits")).unionByName(more)
    return both.groupBy("bucket_key", "window_start").agg(F.sum("hits").alias("hits"))


def owns(rows: DataFrame, keys: DataFrame, key: str, owner: str) -> DataFrame:
    """keys (key, owner) with `owned`: whether such a row exists."""
    have = rows.select(F.col(key).alias("__k"), F.col(owner).alias("__o")).distinct()
    return keys.join(have, (F.col(key) == F.col("__k")) & (F.col(owner) == F.col("__o")), "left").withColumn("owned", F.col("__k").isNotNull()).drop("__k", "__o")


def latest(rows: DataFrame, group: str, time: str, tie: str, n: int = 50) -> DataFrame:
    """The latest n rows of each group with their place, oldest first."""
    w = Window.partitionBy(group)
    found = rows.withColumn("__rn", F.row_number().over(w.orderBy(F.desc(time), F.desc(tie)))).filter(F.col("__rn") <= n)
    return found.withColumn("place", F.row_number().over(w.orderBy(F.desc("__rn")))).drop("__rn")


def default_of(rows: DataFrame, group: str, time: str, tie: str) -> DataFrame:
    """The oldest row of each group."""
    return rows.groupBy(group).agg(F.min_by(F.struct(*rows.columns), F.struct(time, tie)).alias("__row")).select("__row.*")


def resolve_matter(requests: DataFrame, matters: DataFrame) -> DataFrame:
    """Each request (user_id, matter_id) with the matter it is for: its own if the user owns it, else the user's oldest."""
    owned = matters.select(F.col("user_id").alias("__u"), F.col("matter_id").alias("__m")).distinct().withColumn("__owned", F.lit(True))
    oldest = default_of(matters, "user_id", "created_at", "matter_id").select("user_id", F.col("matter_id").alias("__default"))
    found = requests.join(owned, (F.col("user_id") == F.col("__u")) & (F.col("matter_id") == F.col("__m")), "left").drop("__u")
    return found.join(oldest, "user_id", "left").withColumn("resolved", F.when(F.col("__owned"), F.col("matter_id")).otherwise(F.col("__default"))).drop("__m", "__owned", "__default")


def over_quota(files: DataFrame, user: str, limit: int = 20) -> DataFrame:
    return files.groupBy(user).agg(F.count(F.lit(1)).alias("n")).withColumn("full", F.col("n") >= limit)


def with_default(embeddings: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Rows with their cached value (null: still to be computed)."""
    return embeddings.join(cache, key, "left")

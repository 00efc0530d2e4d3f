"""URL filters (op8): host-suffix and path-prefix expressions, joined on short hash prefixes and confirmed by full digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import materialize

#: Rules are broadcast while they are at most so many, of so many bytes; beyond, they are joined by shuffle.
BROADCAST_RULES, BROADCAST_BYTES = 100_000, 32 << 20

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): what follows the first :// up to / ? # (A-Z lower-cased), then up to ? or #. No ://, null: both empty."""
    after = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.regexp_extract(after, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def host_suffixes(host: Column) -> Column:
    """The host and what follows each of its dots; an empty host has none."""
    labels = F.split(host, r"\.", -1)
    n = F.size(labels)
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n - i + 1), ".")))


def judge(pages: DataFrame, rules: DataFrame, *, url_col: str = "url", default: str = "allow", prefix: int = 8, broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """pages with host, path, rule (host + path of the rule that decides, else null) and verdict (its verdict, else default).

    rules: host, path, verdict. A rule fits its host and all subdomains if the url's path starts with the rule's path.
    Among those that fit, the longest rule (host + path) wins; equally long: the longer host, then block before allow.
    Each distinct url is expanded into host suffixes times path prefixes; only lengths that rule paths have are tried
    (distinct lengths: a short list of integers that grows with no table). Expressions meet rules on the first `prefix`
    hex digits of their SHA-256 and are confirmed by the whole digest. A null or malformed url has empty host and path
    and no rule; a rule with null or empty host never fits, a null path is empty, repeated rules count once. Every page
    row is returned, repeated ones and null ids too; columns named like an output are replaced.
    """
    named = rules.select(F.translate(F.col("host"), _UPPER, _LOWER).alias("__rh"), F.coalesce(F.col("path"), F.lit("")).alias("__rp"), F.col("verdict").alias("__rv")).filter(F.col("__rh") != "").distinct()
    separator = "\x00"
    digest = F.sha2(F.concat("__rh", F.lit(separator), "__rp"), 256)
    named = named.withColumn("__rd", digest).withColumn("__rk", F.substring("__rd", 1, prefix))
    shape = named.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("__rh") + F.octet_length("__rp") + 100), F.lit(0)).alias("size"), F.array_sort(F.collect_set(F.length("__rp"))).alias("lengths")).first()
    if shape["n"] <= broadcast_rules and shape["size"] <= BROADCAST_BYTES:
        named = F.broadcast(named)

    host, path = split_url(F.col("__url"))
    urls = pages.select(F.col(url_col).alias("__url")).filter(F.col("__url").isNotNull()).distinct().select("__url", host.alias("__h"), path.alias("__p"))
    prefixes = F.transform(F.filter(F.array(*(F.lit(n) for n in shape["lengths"])).cast("array<int>"), lambda n: n <= F.length("__p")), lambda n: F.substring(F.col("__p"), F.lit(1), n))
    expressions = urls.withColumn("__eh", F.explode(host_suffixes(F.col("__h")))).withColumn("__ep", F.explode(prefixes))
    expressions = expressions.withColumn("__ed", F.sha2(F.concat("__eh", F.lit(separator), "__ep"), 256)).withColumn("__ek", F.substring("__ed", 1, prefix))
    hits = expressions.join(named, (F.col("__ek") == F.col("__rk")) & (F.col("__ed") == F.col("__rd")))
    rank = F.struct(F.length("__rh") + F.length("__rp"), F.length("__rh"), F.when(F.col("__rv") == "block", 1).otherwise(0), F.concat("__rh", "__rp"), "__rv")
    # written, so that both sides of the last join are plain shuffles and a url that many pages have can be split
    best = materialize(hits.groupBy("__url").agg(F.max(rank).alias("__best")))

    host, path = split_url(F.col(url_col))
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    judged = pages.join(best.hint("merge"), pages[url_col] == best["__url"], "left")  # its compressed size hides what a broadcast would weigh
    return judged.select(*(pages[c] for c in kept), host.alias("host"), path.alias("path"), F.col("__best.col4").alias("rule"), F.coalesce(F.col("__best.__rv"), F.lit(default)).alias("verdict"))

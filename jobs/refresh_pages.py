"""Refresh of crawled pages: the chunks of pages whose text has changed are replaced, all others stay as they are.

    python -m jobs.refresh_pages --source s3a://crawl/pages --target s3a://corpus/pages

A high-water mark over page_id, kept as a table, says what has been taken. Newer pages are cut down to the last version of
each address, compared by hash with what is stored, and only the partitions in which something changed are written anew.
The mark is written last: a run that was killed before takes the same pages again, finds those that were written already
unchanged, and ends in the same table.
"""

from __future__ import annotations

import logging
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.base import existing, main, overwrite_partitions
from lexloom.functions.cleaning import page_text, page_title
from lexloom.functions.text import content_hash
from lexloom.operators import crawl
from lexloom.session import materialize, spread

log = logging.getLogger(__name__)

PAGES = "id string, url string, site string, title string, place int, content string, text_hash string, part int, slice int"
MARK = "page_id long"
RESULTS = "processed long, updated long, unchanged long, skipped long, failed long, newly_discovered int, page_id long"
#: Partitions by site and, within a site, by address: a crawl of a few sites rewrites those only, and a large one is many.
PARTS, SLICES = 64, 16


def _address() -> Column:
    """The url without its fragment."""
    return F.regexp_replace("url", "#.*$", "")


def _site() -> Column:
    return crawl.bare_host(crawl.host_of(F.col("url")))


def _placed(rows: DataFrame) -> DataFrame:
    """rows with part and slice, the partition that an address belongs to."""
    bucket = lambda c, n: F.coalesce(F.pmod(F.crc32(F.col(c).cast("binary")), F.lit(n)), F.lit(0)).cast("int")
    return rows.withColumns({"part": bucket("site", PARTS), "slice": bucket("url", SLICES)})


def last_versions(pages: DataFrame) -> DataFrame:
    """url (without fragment), site, title, text, text_hash of each address: its page with the largest id (ties: the largest
    hash). max_by keeps one row an address and task before the shuffle, so an address with very many versions is no hot key."""
    body = pages.select("page_id", _address().alias("url"), page_title(F.col("html")).alias("title"), page_text(F.col("html")).alias("text"))
    named = body.withColumns({"site": _site(), "text_hash": content_hash(F.concat_ws("\n", "title", "text"))})
    return named.groupBy("url").agg(F.max_by(F.struct("site", "title", "text", "text_hash"), F.struct("page_id", "text_hash")).alias("__page")).select("url", "__page.*")


def refresh(spark: SparkSession, source: str, target: str, least_chars: int = 200, chunk_chars: int = 1100, overlap_chars: int = 150) -> DataFrame:
    """Take the pages above the mark into `target`; returns the chunks of all pages as they stand now.

    source: Parquet files of page_id, url, html (other columns are not read), ids ascending with time; pages that come late
    under an id below the mark are not taken. target: folders pages (chunks by part and slice), mark and ticks. Pages
    without id, address or html, and texts under `least_chars`, are skipped and leave an address's older text in place.
    """
    done = existing(spark, f"{target}/mark", MARK).agg(F.max("page_id")).first()[0]
    log.info("reading pages of %s above %s", source, done)
    pages = spread(spark.read.parquet(source)).select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    new = pages if done is None else pages.filter(F.col("page_id") > done)
    high = new.agg(F.max("page_id")).first()[0]  # reads the ids only
    if high is not None:
        new = new.filter(F.col("page_id") <= high)
        stored = existing(spark, f"{target}/pages", PAGES)
        places = _placed(new.select(_address().alias("url")).withColumn("site", _site())).select("part", "slice").distinct()  # PARTS * SLICES rows at most
        old = stored.filter("place = 0").join(F.broadcast(places), ["part", "slice"], "left_semi").select("url", F.col("text_hash").alias("old_hash"))
        able = F.col("url").isNotNull() & F.col("html").isNotNull()
        latest = last_versions(new.filter(able & (F.length(page_text(F.col("html"))) >= least_chars)))
        compared = latest.join(old, "url", "left").withColumn("result", F.when(F.col("text_hash") == F.col("old_hash"), "unchanged").otherwise("updated"))
        # written, as two passes read it and the second one changes what it was compared with
        changes = materialize(_placed(compared).select("url", "site", "title", "text_hash", F.when(F.col("result") == "updated", F.col("text")).alias("text"), "result", "part", "slice"))
        changed = changes.filter("result = 'updated'")
        touched = changed.select("part", "slice").distinct()
        kept = stored.join(F.broadcast(touched), ["part", "slice"], "left_semi").join(changed.select("url"), "url", "left_anti")
        fresh = crawl.page_chunks(changed, chunk_chars, overlap_chars).join(changed.drop("text", "result"), "url")
        columns = [f.split()[0] for f in PAGES.split(", ")]
        overwrite_partitions(materialize(kept.select(*columns).unionByName(fresh.select(*columns))), f"{target}/pages", "part", "slice")
        counts = crawl.tick_counts(changes.select("result")).withColumn("page_id", F.lit(high))
        counts.select(*(f.split()[0] for f in RESULTS.split(", "))).coalesce(1).write.mode("append").parquet(f"{target}/ticks")
        spark.createDataFrame([(high,)], MARK).coalesce(1).write.mode("append").parquet(f"{target}/mark")
        log.info("pages %s to %s: %s; wrote to %s", done, high, counts.first().asDict(), target)
    else:
        log.info("nothing above %s", done)
    return existing(spark, f"{target}/pages", PAGES)


if __name__ == "__main__":
    main(refresh, str(Path(__file__).with_suffix(".toml")))

"""Incremental ingestion: new document files become accepted documents and chunks, each file once.

    python -m jobs.ingest_documents --source s3a://raw/documents --target s3a://corpus --checkpoint s3a://corpus/_ingest

A file stream over the source takes what has arrived since the last run. Each micro-batch is judged by gates, rid of
repeated ids and texts, of itself and of all earlier batches, and cut into chunks. Whatever a batch writes lies in
partitions named by the batch, which a batch that comes again overwrites; so a run that was killed anywhere can be started
again with the same result.
"""

from __future__ import annotations

import functools
import logging
import re
from pathlib import Path

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.base import existing, main, overwrite_partitions
from lexloom.functions.chunking import sliding_chunks
from lexloom.functions.text import normalized_hash, text
from lexloom.operators import corpus

log = logging.getLogger(__name__)

RAW = "doc_id long, text string, lang string, source string"
DOCUMENTS = "doc_id long, text string, digest string, source string, lang string, batch long"
CHUNKS = "doc_id long, place int, content string, batch long, lang string"
REPORT = "reason string, n long, batch long"


def as_pattern(path: str) -> str:
    """A path as a pattern that matches just it: a file stream takes a single file by pattern only."""
    return path if re.search(r"[*?\[{]", path) else re.sub(r"([^/]+)/*$", r"{\1}", path)


def gates(least_chars: int) -> Column:
    """Why a row is refused; null if it is not."""
    return corpus.first_failing([("no_id", F.col("doc_id").isNull()), ("short", corpus.is_junk(text("text"), least=least_chars))])


def ingest_batch(rows: DataFrame, batch: int, target: str, least_chars: int, chunk_chars: int, overlap_chars: int) -> None:
    """Judge, deduplicate and write one micro-batch.

    Of rows that share an id the one with the least digest stays, of texts that differ in white space only the smallest
    id; ids and texts of earlier batches stay out. Both steps keep one row a key and task before anything is shuffled,
    and earlier batches are read without their texts.
    """
    spark = rows.sparkSession
    judged = rows.select("doc_id", "text", "source", F.coalesce(F.nullif(F.trim("lang"), F.lit("")), F.lit("unknown")).alias("lang"), gates(least_chars).alias("reason"))
    passed = judged.filter("reason is null").drop("reason").withColumn("digest", normalized_hash(text("text")))
    unique = corpus.first_per_key(corpus.first_per_key(passed, F.col("doc_id"), "digest").drop("__key"), F.col("digest"), "doc_id").persist(StorageLevel.DISK_ONLY)
    earlier = existing(spark, f"{target}/documents", DOCUMENTS).filter(F.col("batch") < batch)
    fresh = unique
    for key in ("doc_id", "digest"):
        # what earlier batches share with this one: the large side meets the small one's keys and passes on hits only
        fresh = corpus.without_existing(fresh, earlier.select(key).join(unique.select(key), key, "left_semi"), key)
    overwrite_partitions(fresh.select("doc_id", "text", "digest", "source", "lang", F.lit(batch).cast("long").alias("batch")), f"{target}/documents", "batch")
    unique.unpersist()

    accepted = existing(spark, f"{target}/documents", DOCUMENTS).filter(F.col("batch") == batch)
    pieces = accepted.select("doc_id", F.posexplode(sliding_chunks(F.col("text"), chunk_chars, overlap_chars)).alias("place", "content"), "batch", "lang")
    overwrite_partitions(pieces, f"{target}/chunks", "batch", "lang")

    refused = {r["reason"]: r["n"] for r in corpus.histogram(judged.select("reason")).collect()}  # a row a gate
    kept = accepted.count()
    counts = {k: n for k, n in refused.items() if k != "selected"} | {"duplicate": refused.get("selected", 0) - kept, "accepted": kept}
    report = spark.createDataFrame([(k, n, batch) for k, n in sorted(counts.items())], REPORT)
    overwrite_partitions(report.coalesce(1), f"{target}/report", "batch")
    log.info("batch %d: read %d rows, wrote to %s: %s", batch, sum(refused.values()), target, counts)


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str, least_chars: int = 200, chunk_chars: int = 1100, overlap_chars: int = 150, files_per_batch: int = 1000) -> DataFrame:
    """Take the files that have come to `source` since the last run into `target`; returns the chunks as they stand now.

    source: a folder of Parquet files, one file, or a pattern; of their columns doc_id, text, lang and source are read. target: folders documents, chunks
    and report, by batch; chunks also by language. checkpoint: what has been taken. Null ids and texts under `least_chars`
    are refused, a null or blank language is `unknown`. An empty source gives no rows.
    """
    log.info("reading new files of %s, checkpoint %s", source, checkpoint)
    stream = spark.readStream.schema(RAW).option("maxFilesPerTrigger", files_per_batch).parquet(as_pattern(source))
    batch = functools.partial(ingest_batch, target=target, least_chars=least_chars, chunk_chars=chunk_chars, overlap_chars=overlap_chars)
    query = stream.writeStream.foreachBatch(lambda rows, n: batch(rows, n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("done: %d batches in this run", sum(p["numInputRows"] > 0 for p in query.recentProgress))
    return existing(spark, f"{target}/chunks", CHUNKS)


if __name__ == "__main__":
    main(ingest, str(Path(__file__).with_suffix(".toml")))

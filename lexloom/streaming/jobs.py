"""Structured Streaming jobs: rate limits, the crawl's micro-batches, resumable loading, line re-assembly."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lexloom.functions.text import window_start
from lexloom.operators.corpus import running_before
from lexloom.sources import readers

#: Windows of a key that lie in one group of state.
SPAN = 1024
DECISION = "key string, ts timestamp, window_start timestamp, hits int, allowed boolean"


def window_hits(events: DataFrame, key: str, ts: str, seconds: int, late: str = "1 hour") -> DataFrame:
    """Hits per key and fixed window; state of windows older than the watermark goes."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, f"{seconds} seconds").alias("w"), key).agg(F.count(F.lit(1)).alias("hits")).select(key, F.col("w.start").alias("window_start"), "hits")


def decide(events: DataFrame, key: str, ts: str, seconds: int, limit: int, late: str = "1 hour") -> DataFrame:
    """A decision for each event as it comes: its number in its window, counted in state per key and window.

    Denied events count too. The windows of a key lie together in groups of SPAN, as most windows hold few events and a
    group costs far more than an event. A group's state is one number a window, dropped once the watermark has passed it.
    """

    def run(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark = state.getCurrentWatermarkMs()
        starts, counts = map(np.array, state.get) if state.exists else (np.empty(0, np.int64), np.empty(0, np.int64))
        live = starts // 1000 + 1000 * seconds > mark
        hits: dict[int, int] = dict(zip(starts[live].tolist(), counts[live].tolist(), strict=True))
        for frame in () if state.hasTimedOut else batches:
            frame = frame.iloc[np.lexsort((frame["ts"].to_numpy(), frame["window_us"].to_numpy()))]
            known, first, n = np.unique(frame["window_us"].to_numpy(), return_index=True, return_counts=True)
            before = np.array([hits.get(w, 0) for w in known.tolist()], np.int64)
            number = np.arange(1, len(frame) + 1) + np.repeat(before - first, n)
            hits.update(zip(known.tolist(), (before + n).tolist(), strict=True))
            yield pd.DataFrame({"key": frame["key"], "ts": frame["ts"], "window_start": frame["window_start"], "hits": number.astype(np.int32), "allowed": number <= limit})
        if not hits:
            state.remove()
            return
        state.update((list(hits), list(hits.values())))
        # the first window that ends wakes the group; what has ended is dropped there
        state.setTimeoutTimestamp(max(min(hits) // 1000 + 1000 * seconds, mark + 1))

    start = window_start(F.col("ts"), seconds)
    named = events.select(F.col(key).cast("string").alias("key"), F.col(ts).alias("ts")).withWatermark("ts", late).withColumns({"window_start": start, "window_us": F.unix_micros(start)})
    spans = named.withColumn("span", F.floor(F.col("window_us") / (SPAN * seconds * 1_000_000)))
    return spans.groupBy("key", "span").applyInPandasWithState(run, DECISION, "starts array<long>, hits array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def micro_batches(pages: DataFrame, tick: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Run a crawl tick on each micro-batch of pages; tick must give the same result if a batch comes again (anti-joins do)."""
    writer = pages.writeStream.foreachBatch(tick).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 minutes")).start()


def load_once(files: DataFrame, path: str, key: str, checkpoint: str) -> StreamingQuery:
    """Load a stream of files into a table, row keys that are there already left out; stops when all is read and resumes
    where it stopped."""

    def batch(rows: DataFrame, _: int) -> None:
        spark = rows.sparkSession
        try:
            known = spark.read.parquet(path).select(key)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            known = rows.select(key).limit(0)
        rows.dropDuplicates([key]).join(known, key, "left_anti").write.mode("append").parquet(path)

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def load_pages(spark: SparkSession, path: str, checkpoint: str, total: int, length: int, pages: int = 64, seconds: float = 12.0, **source: str) -> int:
    """Load a paged dataset of `total` rows (readers.paged_stream's options) into path/batch=N, `pages` pages a micro-batch.

    Starts no further batch after `seconds`; the next call goes on where this one stopped. A batch whose page failed is
    taken again as it was planned and overwrites its own folder, so every row is there once. Returns the rows taken so far.
    """

    def batch(rows: DataFrame, n: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={n}")

    end, taken = time.monotonic() + seconds, planned_rows(spark, checkpoint)
    while True:
        until = min(total, taken + pages * length)
        stream = readers.paged_stream(spark, until=until, length=length, **source)
        stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        taken = until
        if taken >= total or time.monotonic() >= end:
            return taken


def planned_rows(spark: SparkSession, checkpoint: str) -> int:
    """The row up to which a paged stream's batches are planned, from its checkpoint; 0 before the first."""
    try:
        lines = spark.read.text(f"{checkpoint}/offsets")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0
    return lines.agg(F.max(F.get_json_object("value", "$.row").try_cast("long"))).first()[0] or 0


def reassemble_lines(pieces: DataFrame, stream: str, place: str, piece: str) -> DataFrame:
    """(stream, line_no, line): text pieces of a stream joined in order and cut at newlines; what follows the last is a line too.

    Each piece is cut by itself; a part's line is the number of newlines before it, so only the parts of one line are ever
    joined, and newlines are counted by ranges of a stream, however long it is.
    """
    cut = pieces.select(stream, place, F.split(piece, "\n").alias("__parts"))
    placed = running_before(cut, [F.col(place)], F.size("__parts") - 1, "__before", stream)
    each = placed.select(stream, place, "__before", F.posexplode("__parts").alias("__i", "__part")).select(stream, place, (F.col("__before") + F.col("__i")).cast("int").alias("line_no"), "__part")
    lines = each.groupBy(stream, "line_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(place, "__part"))), lambda s: s["__part"]), "").alias("line"))
    return lines.filter(F.trim("line") != "")


def events_of(lines: DataFrame, line: str = "line") -> DataFrame:
    """Lines as events: type (sources, c, done, error, or data of a server-sent event) and payload."""
    body = F.regexp_replace(line, r"^data:\s*", "")
    return lines.withColumn("event", F.get_json_object(body, "$.type")).withColumn("payload", body).filter(body != "[DONE]")

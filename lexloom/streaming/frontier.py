"""The crawl frontier as state of a stream: one value and one timer for each url, read back as a table.

Events (EVENT) come as files; a stream keeps for each url what the batch operators keep in the frontier table, so a tick
touches the urls it names and not the whole frontier. Discovery, retries and the outcome of a fetch are transitions of one
url's state; a page that was done `age` ago falls due by a timer. How many due pages of a source are asked for in a tick
is decided over the state's table (`requeued`), since it concerns many urls.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from lexloom.operators import crawl

#: kind: found (a link), fetched (result and hash as crawl.outcome gives them to a page without history), requeued, or
#: tick (moves the clock only; any url). at: when the event was written, not before that of the last tick.
EVENT = "kind string, url string, source_id string, at timestamp, result string, hash string"
STATE = "source_id string, status string, attempts int, hash string, discovered_at timestamp, last_crawled_at timestamp, due_ms long"
CHANGE = "url string, source_id string, result string, status string, attempts int, hash string, at timestamp"

#: Failures after which a page is given up, and the age at which a page is asked for again.
ATTEMPTS = 3
AGE_HOURS = 24

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Page(StatefulProcessor):
    """One url's transitions. Found rows are reduced to the earliest, however many name the url; fetches are few."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.page = handle, handle.getValueState("page", STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        found, steps = None, []
        for r in rows:
            if r.kind == "found":
                here = (r.at, r.source_id or "", r.source_id)
                found = here if found is None else min(found, here, key=lambda x: x[:2])
            elif r.kind != "tick":
                steps.append(r)
        old = self.page.get() if self.page.exists() else None
        if old is None:
            if found is None:
                return  # what was never found has no state
            old = (found[2], "pending", 0, None, found[0], None, None)
            yield self._change(key[0], old, "found", found[0])
        for r in sorted(steps, key=lambda r: (r.at, r.kind != "requeued")):
            old, result = self._step(old, r)
            yield self._change(key[0], old, result, r.at)
        self.page.update(old)

    def _step(self, old: tuple, r: Row) -> tuple[tuple, str]:
        source, status, attempts, known, discovered, last, due = old
        if r.kind == "requeued":
            return (source, "pending" if status == "due" else status, attempts, known, discovered, last, due), "requeued"
        if due is not None:
            self.handle.deleteTimer(due)
            due = None
        result = "unchanged" if r.result == "updated" and r.hash == known else r.result
        if result == "skipped":
            status = "skipped"
        elif result == "failed":
            attempts += 1
            status = "failed" if attempts >= ATTEMPTS else "pending"
        else:
            status, known, last, due = "done", r.hash, r.at, int(r.at.timestamp() * 1000) + AGE_HOURS * 3_600_000
            self.handle.registerTimer(due)
        return (source, status, attempts, known, discovered, last, due), result

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:
        source, status, attempts, known, discovered, last, _ = self.page.get()
        if status == "done":
            old = (source, "due", attempts, known, discovered, last, None)
            self.page.update(old)
            yield self._change(key[0], old, "due", last)

    def _change(self, url: str, page: tuple, result: str, at: object) -> Row:
        return Row(url=url, source_id=page[0], result=result, status=page[1], attempts=page[2], hash=page[3], at=at)

    def close(self) -> None:
        pass


def found(links: DataFrame, at: Column) -> DataFrame:
    """Events of links (url, source_id); a url found again changes nothing, a null one is left out."""
    return _events(links.filter("url is not null").groupBy("url").agg(F.min("source_id").alias("source_id")), "found", at)


def fetched(pages: DataFrame, at: Column) -> DataFrame:
    """Events of fetched pages (url, ok, is_html, allowed, text), judged as crawl.outcome judges them; the state has the rest."""
    judged = crawl.outcome(pages.withColumns({"old_hash": F.lit(None).cast("string"), "attempts": F.lit(0)}))
    return _events(judged, "fetched", at, F.col("result"), F.col("hash"))


def tick(spark: SparkSession, at: Column) -> DataFrame:
    """The event that moves the clock to `at`, so that timers before it (less the watermark's delay) fall due."""
    return _events(spark.range(1).select(F.lit("").alias("url")), "tick", at)


def _events(rows: DataFrame, kind: str, at: Column, result: Column | None = None, hashed: Column | None = None) -> DataFrame:
    nothing = F.lit(None).cast("string")
    source = F.col("source_id").cast("string") if "source_id" in rows.columns else nothing
    return rows.select(F.lit(kind).alias("kind"), "url", source.alias("source_id"), at.cast("timestamp").alias("at"), (nothing if result is None else result).alias("result"), (nothing if hashed is None else hashed).alias("hash"))


def changes(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """A stream of events as a stream of CHANGE rows, one for each transition. Events later than `late` behind the newest are lost."""
    return events.withWatermark("at", late).groupBy("url").transformWithState(_Page(), CHANGE, "append", "EventTime")


def advance(spark: SparkSession, events: str, out: str, checkpoint: str, late: str = "1 hour") -> StreamingQuery:
    """Take the event files that came since the last run into the state and append the transitions to `out`.

    Stops when all is read; a run that is killed is taken up where its checkpoint stands. The state needs RocksDB, which
    is set for this query alone.
    """
    with _setting(spark, _PROVIDER, _ROCKS):
        rows = spark.readStream.schema(EVENT).parquet(events)
        return changes(rows, late).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def pages(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The frontier as the last finished batch left it, from the state: url and the columns of STATE but the timer's."""
    with _setting(spark, _PROVIDER, _ROCKS):
        rows = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "page").load()
        return rows.select("key.url", *(F.col(f"value.{c.split()[0]}") for c in STATE.split(", ") if not c.startswith("due_ms")))


def requeued(frontier: DataFrame, at: Column, per_source: int = 3) -> DataFrame:
    """Events that ask again for the `per_source` oldest due pages of each source; the others stay due."""
    oldest = Window.partitionBy("source_id").orderBy(F.asc_nulls_last("last_crawled_at"), "url")
    head = frontier.filter("status = 'due'").withColumn("__rn", F.row_number().over(oldest)).filter(F.col("__rn") <= per_source)
    return _events(head, "requeued", at)


@contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)

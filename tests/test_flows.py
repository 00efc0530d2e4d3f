"""Streams with state, paged rows and merged statistics."""

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from lexloom.operators import corpus, crawl, ligatures, retrieval, rollups
from lexloom.plans import exchange
from lexloom.sources import layout, readers
from lexloom.streaming import frontier, jobs

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
PAGE = "url string, source_id string, ok boolean, is_html boolean, allowed boolean, text string"


def _tables(spark, tmp_path):
    return [str(tmp_path / n) for n in ("events", "changes", "checkpoint")]


def test_frontier_as_state_equals_the_batch_operators(spark, tmp_path):
    events, out, checkpoint = _tables(spark, tmp_path)
    urls = [(f"http://h/{i:02}", f"s{i % 2}") for i in range(20)]
    start, before = dt.datetime(2024, 1, 1), spark.conf.get(PROVIDER, None)
    batch = spark.createDataFrame([(u, s, "pending", 0, None, None) for u, s in urls], "url string, source_id string, status string, attempts int, old_hash string, last_crawled_at timestamp")
    frontier.found(spark.createDataFrame(urls + urls[:5] + [(None, "s0")], "url string, source_id string"), F.lit(start)).write.mode("append").parquet(events)
    results = []
    for n, hours in enumerate((0, 26, 52)):
        at = start + dt.timedelta(hours=hours)
        if n:  # the clock moves; what is a day older than the watermark falls due, three a source are asked for again
            frontier.tick(spark, F.lit(at)).write.mode("append").parquet(events)
            frontier.advance(spark, events, out, checkpoint).awaitTermination(120)
            frontier.requeued(frontier.pages(spark, checkpoint), F.lit(at)).write.mode("append").parquet(events)
            frontier.advance(spark, events, out, checkpoint).awaitTermination(120)
            batch = crawl.requeue_stale(batch, F.lit(at - dt.timedelta(hours=1)))
        rows = []
        for r in batch.filter("status = 'pending'").collect():
            i = int(r.url[-2:])
            rows.append((r.url, r.source_id, i % 4 != 1, i % 7 != 3, i % 9 != 5, ("x" if i % 2 else "y" * (n + 1)) * (100 if i % 6 == 0 else 300)))
        pages = spark.createDataFrame(rows, PAGE)
        frontier.fetched(pages, F.lit(at)).write.mode("append").parquet(events)
        frontier.advance(spark, events, out, checkpoint).awaitTermination(120)
        judged = crawl.outcome(pages.join(batch.select("url", "old_hash", "attempts"), "url"))
        results += [(r.url, r.result, r.status, r.attempts) for r in judged.collect()]
        done = judged.select("url", F.col("status").alias("s"), F.col("attempts").alias("a"), F.col("hash").alias("h"), F.when(F.col("status") == "done", F.lit(at)).alias("at"))
        new = lambda a, b: F.coalesce(b, a)
        joined = batch.join(done, "url", "left").select("url", "source_id", new(F.col("status"), F.col("s")).alias("status"), new(F.col("attempts"), F.col("a")).alias("attempts"), new(F.col("old_hash"), F.col("h")).alias("old_hash"), new(F.col("last_crawled_at"), F.col("at")).alias("last_crawled_at"))
        batch = spark.createDataFrame(joined.collect(), joined.schema)
        held = {r.url: r for r in frontier.pages(spark, checkpoint).collect()}
        assert len(held) == 20
        for r in batch.collect():
            h = held[r.url]
            assert (h.source_id, "done" if h.status == "due" else h.status, h.attempts, h.hash, h.last_crawled_at) == (r.source_id, r.status, r.attempts, r.old_hash, r.last_crawled_at)
    told = spark.read.parquet(out)
    assert sorted((r.url, r.result, r.status, r.attempts) for r in told.filter("result not in ('found', 'due', 'requeued')").collect()) == sorted(results)
    assert {"failed", "done", "skipped"} <= {r.status for r in batch.collect()} and {"updated", "unchanged"} <= {r[1] for r in results}
    assert told.filter("result = 'found'").count() == 20 and told.filter("result = 'requeued'").count() > 0
    counts = {(r.source_id, r.status): r.n for r in crawl.status_counts(frontier.pages(spark, checkpoint)).collect()}
    assert sum(counts.values()) == 20
    assert spark.conf.get(PROVIDER, None) == before


def failing_page(dataset, offset, length):
    """A fetch that fails on the fourth page while the dataset's flag stands."""
    import os

    if offset == 30 and os.path.exists(f"{dataset}/down"):
        raise OSError("page 3 is down")
    return [(i, f"row {i}") for i in range(offset, offset + length)]


def test_a_paged_stream_goes_on_after_a_failed_page(spark, tmp_path):
    flag = tmp_path / "down"
    flag.touch()
    out, checkpoint = str(tmp_path / "rows"), str(tmp_path / "checkpoint")
    source = {"dataset": str(tmp_path), "module": "tests.test_flows", "function": "failing_page", "schema": "row_index long, content string"}

    def load(seconds, pages=2):
        return jobs.load_pages(spark, out, checkpoint, 75, 10, pages, seconds, **source)

    assert load(0) == 20  # no time is left after the first batch of two pages
    with pytest.raises(Exception, match="page 3 is down"):
        load(60)
    assert sorted(r.row_index for r in spark.read.parquet(out).collect()) == list(range(20))
    assert jobs.planned_rows(spark, checkpoint) == 40
    flag.unlink()
    assert load(60) == 75  # the failed batch as it was planned, then the rest; the last page is short
    assert load(60) == 75
    assert sorted((r.row_index, r.content) for r in spark.read.parquet(out).collect()) == [(i, f"row {i}") for i in range(75)]
    rows = readers.paged(spark, str(tmp_path), [0, 10], 10, "tests.test_flows", "failing_page", "row_index long, content string")
    assert rows.count() == 20


def test_a_paged_stream_ends_within_a_page_and_goes_on_there(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / name) for name in ("source", "out", "checkpoint"))
    rows = spark.range(47).select(F.col("id").alias("doc_id"), F.concat(F.lit("row "), "id").alias("content"), F.floor(F.col("id") / 10).alias("page"))
    rows.repartition("page").write.partitionBy("page").parquet(source)
    how = {"dataset": source, "module": "lexloom.sources.readers", "function": "parquet_page", "schema": "doc_id long, content string"}
    for total in (33, 47):
        assert jobs.load_pages(spark, out, checkpoint, total, 10, 2, 60, **how) == total
        assert sorted((r.doc_id, r.content) for r in spark.read.parquet(out).collect()) == [(i, f"row {i}") for i in range(total)]


def test_pages_of_a_batch_are_dealt_to_a_bounded_number_of_partitions(monkeypatch):
    monkeypatch.setattr(readers, "MOST_PARTITIONS", 4)
    found = readers._PagedStreamReader({"length": "10"}).partitions({"row": 15}, {"row": 123})
    assert len(found) <= 4
    assert [i for part in found for p in part.pages for i in range(p.offset + p.first, p.offset + p.last)] == list(range(15, 123))


def test_json_values_share_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(exchange, "FILE_LISTS", 8)
    rows = spark.range(20).withColumnRenamed("id", "part")
    exchange._json_values(rows, F.to_json(F.struct(F.col("part").alias("n"))), str(tmp_path / "values"))
    found = spark.read.schema("n long").json(str(tmp_path / "values"), multiLine=True)
    assert sorted(r.n for r in found.select("n").collect()) == list(range(20)) and len(found.inputFiles()) == 3


def test_decisions_count_on_over_batches_with_one_group_a_key(spark, tmp_path):
    place = {name: str(tmp_path / name) for name in ("in", "out", "state")}
    schema = "user long, ts timestamp"
    rows = spark.range(600).select((F.col("id") % 2).alias("user"), F.timestamp_seconds(F.lit(1_700_000_000) + F.floor(F.col("id") / 4) * 60).alias("ts"))

    def step(late):
        rows.write.mode("append").parquet(place["in"])
        stream = spark.readStream.schema(schema).parquet(place["in"])
        query = jobs.decide(stream, "user", "ts", 60, 3, late).writeStream.format("parquet").option("path", place["out"]).option("checkpointLocation", place["state"]).trigger(availableNow=True).start()
        query.awaitTermination()
        return max((s.numRowsTotal for p in query.recentProgress for s in p.stateOperators), default=0)

    for batch in (1, 2):  # two events a user and minute in each
        assert step("1 day") <= 4  # two users, two spans at most; 300 windows
        found = spark.read.schema(jobs.DECISION).parquet(place["out"]).groupBy("key", "window_start").agg(F.sort_array(F.collect_list("hits")).alias("hits"), F.count_if("allowed").alias("allowed")).collect()
        assert len(found) == 300 and {(tuple(r.hits), r.allowed) for r in found} == {(tuple(range(1, 2 * batch + 1)), min(3, 2 * batch))}


def test_lam_alef_is_repaired_by_the_lexicon_alone(spark):
    lexicon = spark.createDataFrame([("اطلاعات", 9), ("آنلاین", 4), ("الان", 5), ("حال", 8), ("کلا", 2), ("کال", 2), ("بلاد", 3), ("بالد", 3), (None, 1)], "word string, n long")
    rows = [(1, "اطالعات، آنالین! (اطالعات)", 7), (2, "الان حال", 7), (3, "النه", 7), (4, "", 7), (5, None, 7), (6, "plain text\n", 7), (7, "ال" * 40, 7), (1, "اطالعات، آنالین! (اطالعات)", 7), (8, " اطالعات\n\n" * 2000, 7)]
    found = ligatures.repaired(spark.createDataFrame(rows, "id long, text string, repaired_by long"), lexicon, "text").collect()
    told = {r.id: r for r in found}
    assert len(found) == len(rows) and set(found[0].asDict()) == {"id", "text", "repaired_by", "repaired", "doubtful"}
    assert (told[1].text, told[1].repaired, told[1].doubtful) == ("اطلاعات، آنلاین! (اطلاعات)", 3, 0)
    assert (told[2].text, told[2].repaired, told[2].doubtful) == ("الان حال", 0, 0)  # known words are left alone
    assert (told[3].text, told[3].doubtful) == ("النه", 1) and told[7].text == "ال" * 40 and told[7].doubtful == 1
    assert [(told[i].text, told[i].repaired) for i in (4, 5, 6)] == [("", 0), (None, 0), ("plain text\n", 0)]
    assert told[8].text == " اطلاعات\n\n" * 2000 and told[8].repaired == 2000
    tie = ligatures.fixes(spark.createDataFrame([("الال",), ("الال",)], "word string"), spark.createDataFrame([("لاال", 2), ("اللا", 2)], "word string, n long")).collect()
    assert [(r.word, r.fixed) for r in tie] == [("الال", None)]  # equally frequent readings: nothing is guessed
    assert ligatures.fixes(spark.createDataFrame([("الال",)], "word string"), spark.createDataFrame([("لاال", 2), ("اللا", 3)], "word string, n long")).first().fixed == "اللا"
    rate = lambda texts: corpus.lexicon_hits(texts, lexicon, "id", "text").filter("id = 8").first().rate
    assert rate(spark.createDataFrame([r[:2] for r in rows], "id long, text string")) == 0.0
    assert rate(spark.createDataFrame([(8, told[8].text)], "id long, text string")) == 1.0
    assert ligatures.repaired(spark.createDataFrame([], "id long, text string"), lexicon, "text").count() == 0


def test_lam_alef_of_any_number_of_pairs_is_read_either_way(spark):
    broken, whole = ligatures.BROKEN, ligatures.WHOLE
    many = [broken * 7, "ب" + broken * 7, broken * 6 + "ب" + broken, "𞤀" + (broken + "𞤀") * 8, broken * 3000]  # the fourth outside the basic plane
    turned = [whole * 7, "ب" + whole + broken * 5 + whole, broken * 6 + "ب" + whole, "𞤀" + (whole + "𞤀") * 8, broken * 2999 + whole]
    unread = [broken * 8, "ت" * 11 + broken * 7, "ث" + broken * 9]
    near = [whole * 5 + "لل" + "اا" + "لا", "ت" * 11 + "لل" + "اا" + broken * 5, "ث" + broken * 5 + "اا" + "لل" + broken * 2]  # of the same key, but by no turned pairs
    tie = "ج" + broken * 9
    lexicon = [(w, 3) for w in turned + near] + [("ج" + whole * 9, 2), ("ج" + broken * 8 + whole, 2), ("ج" + whole + broken * 8, 1)]
    found = {r.word: r.fixed for r in ligatures.fixes(spark.createDataFrame([(w,) for w in [*many, *unread, tie]], "word string"), spark.createDataFrame(lexicon, "word string, n long")).collect()}
    assert found == dict(zip(many, turned)) | dict.fromkeys([*unread, tie])
    letters, dice = ("ا", "ل", "ب"), random.Random(7)
    words = {"".join(dice.choices(letters, (4, 4, 1), k=dice.randint(2, 17))) for _ in range(300)}
    known = {}
    for word in sorted(words):  # by pairs turned at random, and by letters swapped at random, which is mostly no reading
        parts = word.split(broken)
        known |= {parts[0] + "".join(dice.choice((broken, whole)) + p for p in parts[1:]): dice.randint(1, 3) for _ in range(6)}
        i = dice.randrange(len(word) - 1)
        known[word[:i] + word[i + 1] + word[i] + word[i + 2 :]] = dice.randint(1, 3)
    known = {w: n for w, n in known.items() if dice.random() < 0.7 and w not in words}
    want = {}
    for word in (w for w in words if broken in w):
        parts = word.split(broken)
        hits = {r: known[r] for joints in itertools.product((broken, whole), repeat=len(parts) - 1) if (r := parts[0] + "".join(j + p for j, p in zip(joints, parts[1:]))) in known}
        best = [r for r, n in hits.items() if n == max(hits.values())]
        want[word] = best[0] if len(best) == 1 else None
    found = ligatures.fixes(spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame(list(known.items()), "word string, n long")).collect()
    assert {r.word: r.fixed for r in found} == want and len(found) == len(want) and sum(w is not None for w in want.values()) > 100


def test_merged_statistics_keep_their_bounds_and_read_only_what_is_new(spark, tmp_path):
    path = str(tmp_path / "statistics")
    rows = spark.range(60_000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 5)).alias("source"), F.expr("date'2024-01-01' + cast(id % 4 as int)").alias("day"), (F.col("id") * 7919 % 60_013).alias("size"), (F.col("id") % 20_000).alias("member"))
    columns = [F.col(c) for c in ("source", "day", "size", "member")]
    rows.write.partitionBy("day").parquet(str(tmp_path / "rows"))
    base = spark.read.parquet(str(tmp_path / "rows"))
    rollups.refresh(rollups.by_day(base.filter("day < '2024-01-04'"), *columns), path)
    before = {f.name: f.stat().st_mtime_ns for f in (tmp_path / "statistics").glob("day=2024-01-0[123]/*.parquet")}
    added = base.filter("day = '2024-01-04'")
    plan = added._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan  # the day's partition alone is read
    for _ in range(2):  # a day that is written again takes its own place
        rollups.refresh(rollups.by_day(added, *columns), path)
    assert before == {f.name: f.stat().st_mtime_ns for f in (tmp_path / "statistics").glob("day=2024-01-0[123]/*.parquet")}
    for by in (["source"], ["day"], []):
        exact = rows.groupBy(*by).agg(F.count("size").alias("n"), F.min("size").alias("least"), F.max("size").alias("most"), F.sum("size").alias("total"), F.count_distinct("member").alias("members"), F.collect_list("size").alias("sizes"))
        want = {tuple(r[c] for c in by): r for r in exact.collect()}
        found = rollups.merged(rollups.stored(spark, path), *by).collect()
        assert len(found) == len(want)
        for r in found:
            w = want[tuple(r[c] for c in by)]
            assert (r.n, r.least, r.most, r.total) == (w.n, w.least, w.most, w.total) and r.mean == pytest.approx(w.total / w.n)
            assert abs(sum(x <= r.median for x in w.sizes) / w.n - 0.5) < 0.02 and abs(r.members - w.members) <= 0.04 * w.members
    nothing = rollups.by_day(spark.createDataFrame([(None, None, None, None), ("a", None, None, "m")], "source string, day date, size long, member string"), *columns)
    assert [(r.source, r.n, r.mean, r.median, r.members) for r in rollups.merged(nothing, "source").orderBy("source").collect()] == [(None, 1, None, None, 0), ("a", 1, None, None, 1)]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bucketed_rows_are_joined_where_they_lie(spark, tmp_path):
    rows = spark.range(2_000).select("id", F.concat(F.lit("text "), "id").alias("content"))
    made = layout.store(rows.filter("id % 2 = 0"), "laid_out", str(tmp_path / "rows"), buckets=8)
    new = spark.range(0, 2_000, 5).select("id", F.lit("new").alias("content"))
    before, adaptive = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for sides that are too large to broadcast
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        for plan in (_plan(new.join(made, "id")), _plan(made.join(new, "id", "left_anti")), _plan(made.join(made.select("id", F.lit(1).alias("hit")), "id"))):
            assert "Bucketed: true" in plan
            assert plan.count("Exchange") == plan.count("Range (")  # what is not laid out moves, and only that
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    after = layout.insert_ignore(new.unionByName(new), "laid_out", str(tmp_path / "rows"), buckets=8)
    want = {i: f"text {i}" for i in range(0, 2_000, 2)} | {i: "new" for i in range(5, 2_000, 10)}
    assert sorted((r.id, r.content) for r in after.collect()) == sorted(want.items())
    assert len(list((tmp_path / "rows").glob("*.parquet"))) == 16  # a file for each bucket and write
    spark.sql("drop table laid_out")


def test_an_exact_lookup_reads_the_slices_asked_for(spark, tmp_path):
    path = str(tmp_path / "articles")
    rows = spark.range(3_000).select(F.col("id"), F.lit("statute").alias("source_type"), F.concat(F.lit("law "), F.col("id") % 3).alias("source_title"), F.when(F.col("id") % 3 == 0, "7").when(F.col("id") % 50 > 0, (F.col("id") % 400).cast("string")).alias("article_number"), F.lit("x").alias("content"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be one task's
    try:
        layout.store_articles(rows, path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    asked = spark.createDataFrame([(1, "ماده 12"), (2, "ماده ۷"), (3, "nothing"), (4, None)], "question_id long, question string")
    found = layout.exact_lookup(asked, path)
    assert sorted((r.question_id, r.id) for r in found.collect()) == sorted((r.question_id, r.id) for r in retrieval.exact_lookup(asked, rows).collect())
    read = {f.split("slice=")[1].split("/")[0] for f in layout.articles_asked(asked, path).select(F.input_file_name()).distinct().toPandas().iloc[:, 0]}
    assert 0 < len(read) <= 2  # two numbers are asked for, in whatever spelling
    assert len(list((tmp_path / "articles").glob("slice=*"))) == layout.SLICES
    seven = spark.read.parquet(path).filter("article_number = '7'").select(F.input_file_name()).distinct().count()
    assert seven > 1  # the number of a third of the rows
    assert layout.exact_lookup(asked.filter("question_id = 3"), path).count() == 0

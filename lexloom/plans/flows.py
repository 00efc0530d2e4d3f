"""Registered queries of streams with state, paged rows and merged statistics; they write into a new folder under the
shared one, run as often as the task would, and return what stands there. Importing this module adds them to the catalogue."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lexloom.operators import ligatures, rollups
from lexloom.operators.corpus import running_before
from lexloom.plans.catalogue import ORACLE_SQL, _folder, chunks, query, questions, table
from lexloom.sources import layout
from lexloom.streaming import frontier, jobs


@query("""with p as (select url, min(page_id) as id, min_by(html, page_id) as html from pages group by url),
a as (select *, id % 5 as source, id % 11 = 0 as barred, id % 7 = 0 as late, id % 14 = 0 as broken from p),
b as (select *, case when barred then 'skipped' when broken then 'pending' when late then 'done' else 'due' end as status, case when barred then 0 when broken then 2 when late then 1 else 0 end as attempts from a),
c as (select *, status = 'due' and row_number() over (partition by source, status order by url) <= 3 as again from b)
select url, cast(source as varchar) as source_id, case when again then 'done' else status end as status, cast(attempts as int) as attempts,
  cast((case when not barred and not broken and length(html) >= 200 then 1 else 0 end) + (case when again and id % 2 = 0 and length(html) >= 199 then 1 else 0 end) as bigint) as updated,
  cast((case when not barred and not broken and length(html) < 200 then 1 else 0 end) + (case when again and not (id % 2 = 0 and length(html) >= 199) then 1 else 0 end) as bigint) as unchanged
from c""")
def t4_frontier_state(spark, sf):
    """All pages found and fetched, failures fetched again, a day passes, and the three oldest of each source are asked for again."""
    path = _folder(spark, "frontier")
    events, out, checkpoint = f"{path}/events", f"{path}/changes", f"{path}/checkpoint"
    p = table(spark, sf, "pages").groupBy("url").agg(F.min_by("html", "page_id").alias("text"), F.min("page_id").alias("id")).withColumn("source_id", (F.col("id") % 5).cast("string"))
    fetch = lambda rows, fails: rows.select("url", "source_id", (F.col("id") % fails != 0).alias("ok"), F.lit(True).alias("is_html"), (F.col("id") % 11 != 0).alias("allowed"), "text")
    first, retry, day = (F.lit(x) for x in ("2024-01-01 00:00:00", "2024-01-01 10:00:00", "2024-01-02 01:30:00"))

    def step(*made) -> None:
        for rows in made:
            rows.write.mode("append").parquet(events)
        frontier.advance(spark, events, out, checkpoint).awaitTermination()

    step(frontier.found(p, first), frontier.fetched(fetch(p, 7), first))
    pending = frontier.pages(spark, checkpoint).filter("status = 'pending'").select("url")
    step(frontier.fetched(fetch(p.join(pending, "url", "left_semi"), 14), retry))
    step(frontier.tick(spark, day))
    again = frontier.requeued(frontier.pages(spark, checkpoint), day)
    changed = p.withColumn("text", F.when(F.col("id") % 2 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    step(again, frontier.fetched(fetch(changed.join(again.select("url"), "url", "left_semi"), 7), day))
    counts = spark.read.schema(frontier.CHANGE).parquet(out).groupBy("url").agg(*(F.count_if(F.col("result") == r).alias(r) for r in ("updated", "unchanged")))
    return frontier.pages(spark, checkpoint).select("url", "source_id", "status", "attempts").join(counts, "url")


@query("select doc_id, text as content from documents")
def s8_paged_stream(spark, sf):
    """Documents behind pages of 50 rows, taken by a stream that is stopped after its first batch and then goes on."""
    path, length = _folder(spark, "pages"), 50
    documents = table(spark, sf, "documents").select("doc_id", F.col("text").alias("content"))
    rows = running_before(documents, [F.col("doc_id")], F.lit(1), "place")
    rows.withColumn("page", F.floor(F.col("place") / length)).repartition("page").drop("place").write.partitionBy("page").parquet(f"{path}/source")
    total = documents.count()
    source = {"dataset": f"{path}/source", "module": "lexloom.sources.readers", "function": "parquet_page", "schema": "doc_id long, content string"}
    for seconds in (0, float("inf")):
        jobs.load_pages(spark, f"{path}/rows", f"{path}/checkpoint", total, length, 8 if seconds == 0 else 1024, seconds, **source)
    return spark.read.parquet(f"{path}/rows").select("doc_id", "content")


@query(r"""with recursive written as (select doc_id, translate(text, 'la', 'لا') as text from documents), broken as (select doc_id, replace(text, 'لا', 'ال') as text from written where doc_id % 2 = 1),
lexicon as (select word, count(*) as n from (select unnest(regexp_extract_all(text, '\p{L}+')) as word from written where doc_id % 2 = 0) group by 1),
pieces as (select doc_id, unnest(regexp_extract_all(text, '\p{L}+|\P{L}+')) as word, generate_subscripts(regexp_extract_all(text, '\p{L}+|\P{L}+'), 1) as i from broken),
doubtful as (select distinct word from pieces where contains(word, 'ال') and word not in (select word from lexicon)),
readings as (select d.word, string_split(d.word, 'ال') as parts, l.word as reading, n, 1 as i, length(string_split(d.word, 'ال')[1]) as place from doubtful d join lexicon l on translate(l.word, 'ل', 'ا') = translate(d.word, 'ل', 'ا') and starts_with(l.word, string_split(d.word, 'ال')[1])
  union all select word, parts, reading, n, i + 1, place + 2 + length(parts[i + 1]) from readings where i < len(parts) and substring(reading, place + 1, 2) in ('ال', 'لا') and substring(reading, place + 3, length(parts[i + 1])) = parts[i + 1]),
hits as (select word, reading, n from readings where i = len(parts)),
best as (select word, case when count(*) = 1 then min(reading) end as fixed from (select *, max(n) over (partition by word) as most from hits) where n = most group by word),
done as (select doc_id, sha256(string_agg(coalesce(fixed, word), '' order by i)) as hash, count(fixed) as repaired, count(d.word) - count(fixed) as doubtful from pieces left join doubtful d using (word) left join best using (word) group by doc_id)
select b.doc_id, coalesce(hash, sha256(b.text)) as hash, coalesce(repaired, 0) as repaired, coalesce(doubtful, 0) as doubtful from broken b left join done using (doc_id)""")
def x56_lam_alef(spark, sf):
    """Half of the documents with l and a as lam and alef, turned around as a broken text layer has them; the others are the lexicon."""
    written = table(spark, sf, "documents").select("doc_id", F.translate("text", "la", "لا").alias("text"))
    words = written.filter("doc_id % 2 = 0").select(F.explode(F.regexp_extract_all("text", F.lit(r"(\p{L}+)"))).alias("word"))
    broken = written.filter("doc_id % 2 = 1").withColumn("text", F.replace("text", F.lit("لا"), F.lit("ال")))
    found = ligatures.repaired(broken, words.groupBy("word").agg(F.count(F.lit(1)).alias("n")), "text")
    return found.select("doc_id", F.sha2("text", 256).alias("hash"), "repaired", "doubtful")


@query("""select event_type as source, count(*) as n, min(floor(value * 1000))::bigint as least, max(floor(value * 1000))::bigint as most, sum(floor(value * 1000)::bigint)::bigint as total, true as median_close, true as members_close
from events group by 1""")
def a20_merged_statistics(spark, sf):
    """Events by kind and day, the days after the tenth added by a second run; estimates are held against the exact ones."""
    path, size = _folder(spark, "statistics"), F.floor(F.col("value") * 1000).cast("long")
    rows = table(spark, sf, "events")
    kind, day = F.col("event_type"), F.to_date("ts")
    early = F.coalesce(F.dayofmonth("ts") <= 10, F.lit(True))
    for part in (early, ~early):
        rollups.refresh(rollups.by_day(rows.filter(part), kind, day, size, F.col("user_id")), path)
    found = rollups.merged(rollups.stored(spark, path), "source")
    held = rows.select(kind.alias("source"), size.alias("s"), "user_id").join(F.broadcast(found.select("source", "median")), "source")
    exact = held.groupBy("source").agg((F.count_if(F.col("s") < F.col("median")) / F.count("s")).alias("below"), (F.count_if(F.col("s") <= F.col("median")) / F.count("s")).alias("upto"), F.count_distinct("user_id").alias("users"))
    close = F.abs(F.col("members") - F.col("users")) <= 0.05 * F.col("users")
    return found.join(exact, "source").select("source", "n", "least", "most", "total", ((F.col("below") <= 0.52) & (F.col("upto") >= 0.48)).alias("median_close"), close.alias("members_close"))


@query(ORACLE_SQL["d1_insert_ignore"])
def d1_bucketed(spark, sf):
    """d1 into a table bucketed by id."""
    path, name, buckets = _folder(spark, "bucketed"), f"bucketed_{uuid.uuid4().hex}", max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    old = table(spark, sf, "documents").filter("doc_id % 2 = 0").select("doc_id", F.col("text").alias("content"))
    layout.store(old, name, path, "doc_id", buckets)
    return layout.insert_ignore(table(spark, sf, "labels").select("doc_id", F.lit("new").alias("content")), name, path, "doc_id", buckets)


@query(ORACLE_SQL["v1_exact_lookup"])
def v1_article_slices(spark, sf):
    """v1 over the table of article numbers, which reads the slices asked for."""
    path = _folder(spark, "articles")
    layout.store_articles(chunks(spark, sf), path)
    return layout.exact_lookup(questions(spark, sf), path).select("question_id", "id")

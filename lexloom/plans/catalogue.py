"""Registered queries over the supplied tables, each with the SQL that must give the same rows.

The tables stand for the engine's own: documents are chunks (language: kind of source, source: title and dataset),
embeddings are their vectors, pages the crawl, conversations the chat history, events requests and state, benchmark
items questions.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom import api
from lexloom.functions import anonymize, authority, chunking, cleaning, references, vectors
from lexloom.functions import text as T
from lexloom.operators import citations, classify, corpus, crawl, retrieval, state, stats, text_index, vector_index
from lexloom.session import shared_dir, spread
from lexloom.sources import sinks
from lexloom.streaming import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a function under its name, with its SQL if SQL can express it."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/{name}.parquet")
    return spread(rows) if name in ("documents", "pages") else rows


def chunks(spark: SparkSession, sf: str, embedded: bool = False) -> DataFrame:
    """documents as chunks; embedded: with vectors, joined on the id."""
    lang = F.col("lang")
    rows = table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), F.col("text").alias("content"), F.when(lang == "en", "statute").when(lang == "de", "advisory_opinion").when(lang == "fr", "case_law").otherwise("convention").alias("source_type"),
        F.col("source").alias("source_title"), (F.col("doc_id") % 97).cast("string").alias("article_number"),
        F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("https://example.org/"), "doc_id")).otherwise(F.concat(F.lit("/files/"), "doc_id")).alias("source_url"), F.col("source").alias("hf_dataset"),
    )
    if not embedded:
        return rows
    return rows.join(table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("embedding")), "id", "left")


CHUNKS = """chunks as (
  select d.doc_id as id, d.text as content, case d.lang when 'en' then 'statute' when 'de' then 'advisory_opinion' when 'fr' then 'case_law' else 'convention' end as source_type,
    d.source as source_title, cast(d.doc_id % 97 as varchar) as article_number,
    case when d.doc_id % 2 = 0 then 'https://example.org/' || d.doc_id else '/files/' || d.doc_id end as source_url, d.source as hf_dataset, e.embedding::double[] as embedding
  from documents d left join embeddings e on e.vec_id = d.doc_id)"""


def questions(spark: SparkSession, sf: str) -> DataFrame:
    """One question per benchmark item: an article number and the item's first words; its vector is that of the same id."""
    words = F.array_join(F.slice(F.split("text", r"[^\p{L}\p{N}]+"), 1, 3), " ")
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("question_id"), F.concat(F.lit("ماده "), (F.col("item_id") % 97).cast("string"), F.lit(" "), words).alias("question"), words.alias("words"))
    return asked.join(table(spark, sf, "embeddings").select(F.col("vec_id").alias("question_id"), F.col("embedding").cast("array<double>").alias("vector")), "question_id")


QUESTIONS = """questions as (
  select item_id as question_id, 'ماده ' || (item_id % 97) || ' ' || array_to_string(regexp_split_to_array(text, '[^\\p{L}\\p{N}]+')[1:3], ' ') as question,
    array_to_string(regexp_split_to_array(text, '[^\\p{L}\\p{N}]+')[1:3], ' ') as words, e.embedding::double[] as vector
  from benchmark join embeddings e on e.vec_id = item_id)"""

# ---- counts


@query("select lang as source_type, count(*) as n from documents group by lang")
def a1_count_by_type(spark, sf):
    return stats.by_type(table(spark, sf, "documents").withColumnRenamed("lang", "source_type"))


@query(f"with {CHUNKS} select count(*) as total, count(*) filter (len(embedding) > 10) as embedded, count(*) filter (length(content) >= 200) as searchable from chunks")
def a2_totals(spark, sf):
    return stats.totals(chunks(spark, sf, True), searchable=F.length("content") >= 200)


@query("select coalesce(nullif(source, 'src3'), 'unknown') as hf_dataset, count(*) as n from documents group by nullif(source, 'src3')")
def a3_count_by_dataset(spark, sf):
    return stats.by_dataset(table(spark, sf, "documents").select(F.nullif("source", F.lit("src3")).alias("hf_dataset")))


@query("select user_id % 10 as source_id, event_type as status, count(*) as n from events group by all")
def a4_crawl_status(spark, sf):
    return crawl.status_counts(table(spark, sf, "events").select((F.col("user_id") % 10).alias("source_id"), F.col("event_type").alias("status")))


@query("select count(*) filter (event_type = 'view') as pending from events")
def a5_queue_depth(spark, sf):
    return table(spark, sf, "events").agg(F.count_if(F.col("event_type") == "view").alias("pending"))


@query("""select count(*) as processed, count(*) filter (r = 0) as updated, count(*) filter (r = 1) as unchanged, count(*) filter (r = 2) as skipped, count(*) filter (r = 3) as failed, 0 as newly_discovered
from (select event_id % 4 as r from events)""")
def a6_tick_counters(spark, sf):
    name = F.element_at(F.array(*map(F.lit, ("updated", "unchanged", "skipped", "failed"))), (F.col("event_id") % 4 + 1).cast("int"))
    return crawl.tick_counts(table(spark, sf, "events").select(name.alias("result")))


@query("select doc_id % 50 as key, max_by(doc_id, {'n': length(text), 'd': doc_id}) as doc_id from documents group by 1 having doc_id % 50 > 0".replace("having doc_id % 50 > 0", "having key is not null"))
def a7_longest_per_key(spark, sf):
    rows = table(spark, sf, "documents").select((F.col("doc_id") % 50).cast("string").alias("key"), "doc_id", "text")
    return corpus.longest_per_key(rows, "key", "text", "doc_id").select(F.col("key").cast("long").alias("key"), "doc_id")


@query("select source, max_by(doc_id, {'n': length(text), 'd': -doc_id}) as doc_id from documents group by source")
def a10_longest_first_wins(spark, sf):
    return corpus.longest_per_key(table(spark, sf, "documents").select("source", "doc_id", "text"), "source", "text", "doc_id", later_wins=False).select("source", "doc_id")


@query("select p_brand, max_by(p_partkey, {'v': p_size, 'd': -p_partkey}) as p_partkey from part group by p_brand")
def a11_best_per_key(spark, sf):
    return corpus.best_per_key(table(spark, sf, "part"), ["p_brand"], F.col("p_size"), "p_partkey").select("p_brand", "p_partkey")


@query("select count(*) as labelled, count(*) filter (quality = 1) as good, count(*) filter (toxic = 1) as toxic, count(*) filter (quality = 1 and toxic = 1) as both from labels")
def a12_conditional_counts(spark, sf):
    q, t = F.col("quality") == 1, F.col("toxic") == 1
    return table(spark, sf, "labels").agg(F.count(F.lit(1)).alias("labelled"), F.count_if(q).alias("good"), F.count_if(t).alias("toxic"), F.count_if(q & t).alias("both"))


@query("""with first as (select conv_id, role, min(turn) as t from conversations group by all)
select conv_id, string_agg(role, ' · ' order by t, role) as roles from first group by conv_id""")
def a15_distinct_roles(spark, sf):
    first = table(spark, sf, "conversations").groupBy("conv_id", "role").agg(F.min("turn").alias("t"))
    return first.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t", "role"))), lambda s: s["role"]), " · ").alias("roles"))


@query("select min(page_id % 100) as first_page, max(page_id % 100) as last_page, count(distinct page_id % 100) as pages from pages")
def a18_page_range(spark, sf):
    return stats.page_range(table(spark, sf, "pages").select((F.col("page_id") % 100).alias("p")), "p")


@query("""with h as (select regexp_extract(lower(url), '^[a-z]+://([^/?#:]*)', 1) as host, regexp_extract(url, '://[^/]*/([a-z]*)', 1) as kind, length(html) as size from pages),
d as (select 'host' as dimension, host as value, size from h union all select 'domain', regexp_extract(host, '[^.]*\\.[^.]*$'), size from h union all select 'kind', kind, size from h)
select dimension, value, count(*) as pages, sum(size)::bigint as characters from d group by all""")
def a19_stats_by_host(spark, sf):
    host = crawl.host_of(F.col("url"))
    dimensions = {"host": host, "domain": F.regexp_extract(host, r"[^.]*\.[^.]*$", 0), "kind": F.regexp_extract("url", "://[^/]*/([a-z]*)", 1)}
    return stats.by_dimension(table(spark, sf, "pages"), dimensions, F.length("html"))


@query("""select min(w) as least, max(w) as most, median(w)::double as median, round(avg(w), 6) as mean, count(w) as n from (select len(list_filter(regexp_split_to_array(text, '[ \\n\\t]+'), lambda x: x <> '')) as w from documents)""")
def a20_word_stats(spark, sf):
    words = F.size(F.filter(F.split("text", "[ \n\t]+"), lambda x: x != ""))
    return stats.length_stats(table(spark, sf, "documents"), words).withColumn("mean", F.round("mean", 6))


@query("""with words as (select doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{L}]+')) as word from documents),
lexicon as (select distinct unnest(regexp_split_to_array(lower(text), '[^\\p{L}]+')) as word from benchmark),
kept as (select * from words where length(word) >= 2)
select doc_id, count(*) as words, count(l.word) as hits, count(l.word) / count(*) as rate from kept left join lexicon l using (word) group by doc_id""")
def a21_lexicon_hit_rate(spark, sf):
    lexicon = table(spark, sf, "benchmark").select(F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word")).distinct()
    return corpus.lexicon_hits(table(spark, sf, "documents"), lexicon, "doc_id", "text")


@query("""select label, list(x order by i) as embedding from (select label, i, round(avg(embedding[i]::double), 6) as x from embeddings, range(1, 65) t(i) group by label, i) group by label""")
def a22_mean_pool(spark, sf):
    rows = table(spark, sf, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("embedding"))
    return vectors.mean_pool(rows, "label", "embedding").withColumn("embedding", vectors.rounded(F.col("embedding")))


@query("select conv_id, count(*) as n, count(*) >= 3 as full from conversations group by conv_id")
def a24_user_quota(spark, sf):
    return state.over_quota(table(spark, sf, "conversations"), "conv_id", 3)


@query("""select coalesce(e.k, a.k) as k, coalesce(e.n, 0) as expected, coalesce(a.n, 0) as actual, coalesce(a.n, 0) - coalesce(e.n, 0) as difference
from (select doc_id % 20 as k, count(*) as n from documents group by 1) e full join (select doc_id % 23 as k, count(*) as n from labels group by 1) a on e.k = a.k""")
def a25_reconcile(spark, sf):
    return corpus.reconcile(table(spark, sf, "documents").select((F.col("doc_id") % 20).alias("k")), table(spark, sf, "labels").select((F.col("doc_id") % 23).alias("k")), "k")


# ---- filters and projections


@query("select doc_id from documents where lang = 'de'")
def p1_optional_filter(spark, sf):
    return retrieval.optional_equal(table(spark, sf, "documents"), "lang", "de").select("doc_id")


@query("select doc_id from documents where source in ('src1', 'src2')")
def p2_in_list(spark, sf):
    return table(spark, sf, "documents").filter(F.col("source").isin("src1", "src2")).select("doc_id")


@query("select doc_id from documents where text ilike '%The_on%'")
def p3_ilike(spark, sf):
    return table(spark, sf, "documents").filter(F.col("text").ilike("%The_on%")).select("doc_id")


@query("select doc_id, size from (select doc_id, len(text) as size, case when text ilike '%worthless%' then 0 else 1 end as tier from documents where lang = 'en') qualify tier = min(tier) over ()")
def p4_tiered_fallback(spark, sf):
    rows = table(spark, sf, "documents").filter("lang = 'en'").select("doc_id", F.length("text").alias("size"), F.when(F.col("text").ilike("%worthless%"), 0).otherwise(1).alias("tier"))
    best = rows.agg(F.min("tier").alias("best"))  # one row, so the tier is known without a window over all rows
    return rows.join(F.broadcast(best), F.col("tier") == F.col("best")).select("doc_id", "size")


@query(f"""with {CHUNKS}, {QUESTIONS},
terms as (select question_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(words), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> ''))) as token from questions),
index as (select distinct id, length(content) as size, unnest(regexp_split_to_array(lower(content), '[^\\p{{L}}\\p{{N}}]+')) as token from chunks),
hits as (select question_id, id, size, count(*) as hits from index join terms using (token) group by all),
need as (select question_id, count(*) as n from terms group by 1)
select question_id, id, hits, row_number() over (partition by question_id order by size, id) as rank from hits join need using (question_id) where hits = n qualify rank <= 30""")
def p5_fts_all_terms(spark, sf):
    asked = questions(spark, sf).select("question_id", F.col("words").alias("question"))
    return retrieval.fts_all_terms(asked, chunks(spark, sf), F.col("content")).withColumn("rank", F.col("rank").cast("long"))


@query(f"""with {CHUNKS}, {QUESTIONS},
terms as (select question_id, list_transform(list_filter(regexp_split_to_array(regexp_replace(words, '[^\\x{{0600}}-\\x{{06FF}}a-zA-Z0-9]', ' ', 'g'), ' +'), lambda x: length(x) >= 3)[1:5], lambda x: lower(x)) as terms from questions)
select question_id, id, row_number() over (partition by question_id order by id) as rank from terms, chunks
where len(list_filter(terms, lambda t: contains(lower(content), t) or contains(lower(source_title), t))) > 0 qualify rank <= 30""")
def p6_any_term(spark, sf):
    asked = questions(spark, sf).select("question_id", F.col("words").alias("question"))
    return retrieval.any_term(asked, chunks(spark, sf)).withColumn("rank", F.col("rank").cast("long"))


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/lexloom/{name}-{uuid.uuid4().hex}"


@query(ORACLE_SQL["p5_fts_all_terms"])
def p5_text_index(spark, sf):
    """p5 through the stored index, in two generations."""
    asked, path, rows = questions(spark, sf).select("question_id", F.col("words").alias("question")), _folder(spark, "texts"), chunks(spark, sf)
    for generation in (0, 1):
        text_index.index_texts(rows.filter(F.col("id") % 2 == generation), path, F.col("content"), generation)
    return text_index.all_terms(asked, path).withColumn("rank", F.col("rank").cast("long"))


@query(ORACLE_SQL["p6_any_term"])
def p6_word_index(spark, sf):
    """p6 through the stored index of words and their trigrams, in two generations."""
    asked, path, rows = questions(spark, sf).select("question_id", F.col("words").alias("question")), _folder(spark, "words"), chunks(spark, sf)
    for generation in (0, 1):
        text_index.index_words(rows.filter(F.col("id") % 2 == generation), path, generation)
    return text_index.any_term(asked, path).withColumn("rank", F.col("rank").cast("long"))


@query(f"with {CHUNKS} select coalesce(len(embedding) > 10, false) as embedded, coalesce(embedding is null or len(embedding) < 10, true) as missing, count(*) as n from chunks group by all")
def p7_p8_embedding_state(spark, sf):
    rows = chunks(spark, sf, True).select(vectors.is_embedded(F.col("embedding")).alias("embedded"), vectors.lacks_embedding(F.col("embedding")).alias("missing"))
    return rows.groupBy("embedded", "missing").agg(F.count(F.lit(1)).alias("n"))


@query("select doc_id from documents where coalesce(nullif(source, 'src3'), '') not in ('src1', 'src2')")
def p9_exclusion(spark, sf):
    return table(spark, sf, "documents").filter(~F.coalesce(F.nullif("source", F.lit("src3")), F.lit("")).isin("src1", "src2")).select("doc_id")


@query("select doc_id from documents where nullif(lang, 'en') is null")
def p10_tri_state(spark, sf):
    rows = table(spark, sf, "documents").withColumn("country", F.nullif("lang", F.lit("en")))
    return retrieval.tri_state(rows, "country", True, None).select("doc_id")


@query("select event_id from events where ts < timestamp '2024-01-20' - interval 24 hours")
def p11_age(spark, sf):
    return table(spark, sf, "events").filter(F.col("ts") < F.lit("2024-01-20").cast("timestamp") - F.expr("INTERVAL 24 HOURS")).select("event_id")


@query("""with h as (select page_id, regexp_extract(lower(url), '^[a-z]+://([^/?#:]*)', 1) as host from pages)
select page_id, host, host = 'example.org' or ends_with(host, '.example.org') as allowed from h""")
def p13_host_boundary(spark, sf):
    host = crawl.host_of(F.col("url"))
    return table(spark, sf, "pages").select("page_id", host.alias("host"), crawl.host_allowed(host, F.lit("Example.org.")).alias("allowed"))


_GATES = "case when len(words) not between 80 and 900 then 'word_count' when length(text) not between 200 and 4000 then 'length' when latin < 0.6 then 'foreign' end"


@query(f"""select coalesce({_GATES}, 'selected') as reason, count(*) as n from (select text, list_filter(regexp_split_to_array(text, '[ \\n\\t]+'), lambda x: x <> '') as words,
 length(regexp_replace(text, '[^a-zA-Z]', '', 'g')) / length(text) as latin from documents) group by 1""")
def p16_p21_gates(spark, sf):
    c = F.col("text")
    words = F.size(F.filter(F.split(c, "[ \n\t]+"), lambda x: x != ""))
    gates = [*corpus.size_gate(words, F.length(c)), ("foreign", corpus.is_foreign(c, 0.6, "[a-zA-Z]"))]
    return corpus.histogram(table(spark, sf, "documents").select(corpus.first_failing(gates).alias("reason")))


@query("""select doc_id, (length(text) - length(replace(text, '!!', ''))) / 2 >= 8 or length(regexp_replace(text, '[^a-z]', '', 'g')) < 80 as spam from documents""")
def p17_spam(spark, sf):
    return table(spark, sf, "documents").select("doc_id", corpus.is_spam(F.col("text"), repeated="!!", letter_class="[a-z]").alias("spam"))


@query("select doc_id, case when length(text) > 0 then length(regexp_replace(text, '[^a-zA-Z]', '', 'g')) / length(text) else 0 end as ratio from documents")
def p18_character_ratio(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.ratio_of(F.col("text"), "[a-zA-Z]").alias("ratio"))


@query("select doc_id, length(text) < 280 or (contains(text, 'rights reserved') and length(text) < 600) as junk from documents")
def p19_junk(spark, sf):
    return table(spark, sf, "documents").select("doc_id", corpus.is_junk(F.col("text"), "rights reserved").alias("junk"))


# ---- joins


@query(f"""with {CHUNKS}, q as (select embedding::double[] as v from embeddings where vec_id = 7),
top as (select id, round(list_cosine_similarity(embedding, v), 6) as semantic from chunks, q where len(embedding) > 10 order by semantic desc, id limit 30)
select id, semantic, length(content) as size from top join chunks using (id)""")
def j1_hydrate(spark, sf):
    rows = chunks(spark, sf, True)
    vector = table(spark, sf, "embeddings").filter("vec_id = 7").select(F.lit(0).alias("question_id"), F.col("embedding").cast("array<double>").alias("vector"))
    best = retrieval.nearest_by_cosine(vector, rows)
    return rows.select("id", F.length("content").alias("size")).join(F.broadcast(best.select("id", "semantic")), "id")


@query("select doc_id from documents where doc_id in (select doc_id from labels where toxic = 1)")
def j2_semi_join(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "labels").filter("toxic = 1"), "doc_id", "left_semi").select("doc_id")


@query("select doc_id from documents where doc_id not in (select doc_id from labels)")
def j3_anti_join(spark, sf):
    return corpus.without_existing(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), "doc_id")


@query("""with s as (select *, substr(trim(regexp_replace(text, '[ \\n\\t]+', ' ', 'g')), 1, 180) as sig from documents)
select doc_id from s where doc_id % 2 = 1 and sig not in (select sig from s where doc_id % 2 = 0)""")
def j5_known_signatures(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "text")
    return corpus.without_known_signatures(rows.filter("doc_id % 2 = 1"), rows.filter("doc_id % 2 = 0"), "text").select("doc_id")


@query("select vec_id, doc_id is not null as cached from embeddings left join (select distinct doc_id from labels) l on vec_id = doc_id")
def j11_cache_lookup(spark, sf):
    cache = table(spark, sf, "labels").select(F.col("doc_id").alias("vec_id"), F.lit(True).alias("hit")).distinct()
    return state.with_default(table(spark, sf, "embeddings").select("vec_id"), cache, "vec_id").select("vec_id", F.coalesce("hit", F.lit(False)).alias("cached"))


_ROBOTS = [("example.org", False, "/en/"), ("example.org", True, "/en/1"), ("example.org", False, "/es/7"), ("example.com", False, "/"), ("example.com", True, "/fr/")]


@query("""with rules(h, allow, p) as (values ('example.org', false, '/en/'), ('example.org', true, '/en/1'), ('example.org', false, '/es/7'), ('example.com', false, '/'), ('example.com', true, '/fr/')),
u as (select page_id, url, regexp_extract(regexp_extract(lower(url), '^[a-z]+://([^/?#:]*)', 1), '[a-z]+\\.[a-z]+$') as host, regexp_extract(url, '^[a-z]+://[^/?#]*([^#]*)', 1) as path from pages)
select page_id, coalesce((select allow from rules where h = host and starts_with(path, p) order by length(p) desc, allow desc limit 1), true) as allowed from u""")
def j14_robots(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url").withColumn("site", F.regexp_replace("url", r"://[^/?#]*?([a-z]+\.[a-z]+)(?=[/?#]|$)", "://$1"))
    rules = spark.createDataFrame(_ROBOTS, "host string, allow boolean, path string")
    return crawl.robots_allowed(pages, rules, "site").select("page_id", "allowed")


@query("""with names as (select distinct substr(p_name, 1, 4) as name from part)
select name, min_by(p_name, {'a': case when p_name = name then 0 else 1 end, 'b': length(p_name), 'c': p_name}) as title from names, part where contains(p_name, name) group by name""")
def j15_nearest_name(spark, sf):
    part = table(spark, sf, "part")
    names = part.select(F.substring("p_name", 1, 4).alias("name")).distinct()
    return corpus.nearest_name(names, part.select(F.col("p_name").alias("title")))


@query("""with files as (select conv_id, turn, text from conversations), m as (select conv_id, min(turn) as first_turn from conversations group by 1)
select f.conv_id, count(*) as files, any_value(first_turn) as first_turn from files f join m using (conv_id) group by f.conv_id""")
def j17_matter_files(spark, sf):
    c = table(spark, sf, "conversations")
    default = state.default_of(c.select("conv_id", "turn"), "conv_id", "turn", "turn").select("conv_id", F.col("turn").alias("first_turn"))
    return c.join(default, "conv_id").groupBy("conv_id").agg(F.count(F.lit(1)).alias("files"), F.first("first_turn").alias("first_turn"))


# ---- window logic


@query("select doc_id from documents qualify row_number() over (partition by source order by doc_id) <= 10")
def w1_cap_per_source(spark, sf):
    return corpus.cap(table(spark, sf, "documents").select("doc_id", "source"), "source", [F.col("doc_id")], 10).select("doc_id")


@query("select min(doc_id) as doc_id from documents group by substr(trim(regexp_replace(text, '[ \\n\\t]+', ' ', 'g')), 1, 180)")
def w2_first_per_signature(spark, sf):
    return corpus.first_per_signature(table(spark, sf, "documents").select("doc_id", "text"), "text", "doc_id").select("doc_id")


@query("""with r as (select doc_id, row_number() over (partition by lang order by doc_id) as rn, min(doc_id) over (partition by lang) as f from documents)
select doc_id, cast(row_number() over (order by rn, f) as integer) as place from r qualify place <= 100""")
def w3_interleave(spark, sf):
    return corpus.interleave(table(spark, sf, "documents").select("doc_id", "lang"), "lang", "doc_id", 100).select("doc_id", "place")


@query("""with s as (select source, count(*) as n, greatest(1, 100 // (select count(distinct source) from documents)) as want from documents group by source),
p as (select doc_id, n, want, row_number() over (partition by source order by doc_id) - 1 as i from documents join s using (source))
select doc_id from p where n <= want or exists (select 1 from range(0, 100) t(k) where k < least(n, want) and cast(floor(k * n / least(n, want)) as bigint) = i)""")
def w4_systematic_sample(spark, sf):
    return corpus.systematic_sample(table(spark, sf, "documents").select("doc_id", "source"), "source", "doc_id", 100).select("doc_id")


@query("""with p as (select *, row_number() over (partition by l_orderkey order by l_linenumber) as rn, count(*) over (partition by l_orderkey) as n from lineitem)
select l_orderkey, l_linenumber from p where case when l_orderkey % 2 = 0 then n <= 3 or rn = 1 or rn > n - 2 else rn <= 4 end""")
def w5_first_and_last(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    return corpus.first_and_last(rows, "l_orderkey", "l_linenumber", F.col("l_orderkey") % 2 == 0, 4, 3)


@query("""select event_id as url, user_id % 7 as source_id from events where event_type = 'view' order by user_id % 7, ts nulls last, event_id limit 15""")
def w6_queue_head(spark, sf):
    frontier = table(spark, sf, "events").select(F.col("event_id").alias("url"), (F.col("user_id") % 7).alias("source_id"), F.when(F.col("event_type") == "view", "pending").otherwise("done").alias("status"), F.col("ts").alias("discovered_at"))
    return crawl.take_pending(frontier).select("url", "source_id")


_LIMITED = """select event_id, user_id, time_bucket(interval '3600 seconds', ts, timestamp '1970-01-01') as window_start,
 count(*) over (partition by user_id, time_bucket(interval '3600 seconds', ts, timestamp '1970-01-01') order by ts, event_id rows unbounded preceding) as hits from events"""


@query(f"select event_id, hits, hits <= 2 as allowed, greatest(0, 2 - hits) as remaining, window_start from ({_LIMITED})")
def w7_t1_rate_limit(spark, sf):
    return state.rate_limit(table(spark, sf, "events"), "user_id", "ts", "event_id", 3600, 2).select("event_id", "hits", "allowed", "remaining", "window_start")


@query("select user_id, time_bucket(interval '60 seconds', ts, timestamp '1970-01-01') as window_start, count(*) as hits from events group by all")
def t1_window_counts(spark, sf):
    return state.window_counts(table(spark, sf, "events"), "user_id", "ts", 60)


@query("select event_id, greatest(1, ceil((epoch_us(time_bucket(interval '60 seconds', ts, timestamp '1970-01-01')) + 60000000 - epoch_us(ts)) / 1000000))::bigint as reset_in from events")
def x54_reset_in(spark, sf):
    return table(spark, sf, "events").select("event_id", T.resets_in(F.col("ts"), 60).alias("reset_in"))


@query("""with p as (select doc_id as file_id, doc_id % 20 as user_id, unnest(regexp_split_to_array(text, '\\n')) as para, unnest(range(0, len(regexp_split_to_array(text, '\\n')))) as place from documents),
h as (select * from p where contains(para, 'worthless') or contains(para, 'inesan')),
u as (select *, coalesce(sum(length(para)) over (partition by user_id order by file_id, place rows between unbounded preceding and 1 preceding), 0) as used from h)
select user_id, file_id, place, substr(para, 1, cast(2500 - used as int)) as excerpt from u where used < 2500""")
def w9_v8_excerpts(spark, sf):
    files = table(spark, sf, "documents").select((F.col("doc_id") % 20).alias("user_id"), F.col("doc_id").alias("file_id"), F.lit("f").alias("filename"), F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("content"), F.lit(0).alias("created_at"))
    return retrieval.excerpts(F.lit("worthless inesan"), files).select("user_id", "file_id", F.col("place").cast("long").alias("place"), "excerpt")


@query("""with d as (select doc_id, length(text) as size, doc_id % 9 as rank, 1 + length(text) // 1650 as chunks from documents),
r as (select *, coalesce(sum(chunks) over (order by rank, size desc, doc_id rows between unbounded preceding and 1 preceding), 0) as before from d)
select doc_id, chunks from r where rank < 5 or before < 1000""")
def w10_admission(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.length("text").alias("size"), (F.col("doc_id") % 9).alias("rank"), F.expr("1 + length(text) div 1650").alias("chunks"))
    return corpus.admit(rows, "rank", "size", "chunks", "doc_id", 1000).select("doc_id", "chunks")


@query("select conv_id, min(turn) as turn from conversations group by conv_id")
def w11_default_matter(spark, sf):
    return state.default_of(table(spark, sf, "conversations").select("conv_id", "turn"), "conv_id", "turn", "turn")


# ---- sorting and top-k


@query(f"""with {CHUNKS}, {QUESTIONS} select question_id, id from questions join chunks on article_number = cast(question_id % 97 as varchar)
qualify row_number() over (partition by question_id order by case source_type when 'statute' then 0 when 'advisory_opinion' then 1 else 2 end, id) <= 80""")
def v1_exact_lookup(spark, sf):
    return retrieval.exact_lookup(questions(spark, sf), chunks(spark, sf)).select("question_id", "id")


@query(f"""with {CHUNKS}, {QUESTIONS} select question_id, id, round(list_cosine_similarity(embedding, vector), 6) as semantic from questions, chunks where len(embedding) > 10
qualify row_number() over (partition by question_id order by semantic desc, id) <= 30""")
def v3_nearest(spark, sf):
    return retrieval.nearest_by_cosine(questions(spark, sf), chunks(spark, sf, True)).select("question_id", "id", "semantic")


def _vector_index(spark, sf) -> str:
    """An index of all embedded chunks in a new folder: built on the even ids, the odd ones appended."""
    path = _folder(spark, "vectors")
    rows = chunks(spark, sf, True).select("id", "embedding")
    dims = rows.filter(vectors.is_embedded(F.col("embedding"))).agg(F.max(F.size("embedding"))).first()[0]
    vector_index.build(rows.filter("id % 2 = 0"), path, dims)
    vector_index.append(rows.filter("id % 2 = 1"), path, 1)
    return path


@query(f"""with {CHUNKS}, {QUESTIONS} select question_id, id, round(list_cosine_similarity(embedding, vector), 6) as semantic from questions, chunks where len(embedding) > 10
qualify row_number() over (partition by question_id order by semantic desc, id) <= 30""")
def v3_vector_index(spark, sf):
    """The nearest rows through the stored index, in the mode that proves that no nearer one was missed."""
    return vector_index.search(questions(spark, sf), _vector_index(spark, sf), exact=True).select("question_id", "id", "semantic")


@query()
def o3_index_recall(spark, sf):
    """How many of each question's 30 nearest rows the index finds with as many probes as a sample of it asks for."""
    asked, path = questions(spark, sf), _vector_index(spark, sf)
    found = vector_index.search(asked, path, probes=vector_index.probes_for(spark, path)).select("question_id", "id")
    wanted = retrieval.nearest_by_cosine(asked, chunks(spark, sf, True)).select("question_id", "id", F.lit(1).alias("wanted"))
    both = wanted.join(found.withColumn("found", F.lit(1)), ["question_id", "id"], "left")
    return both.groupBy("question_id").agg(F.count("wanted").alias("wanted"), F.count("found").alias("found"))


@query(f"""with {CHUNKS}, rows as (select *, contains(lower(content), 'worthless') as hit from chunks where len(embedding) > 10),
first as (select * from rows where hit order by id limit 1500), rest as (select * from rows where id not in (select id from first) order by id limit 4000),
pool as (select * from (select *, 0 as turn from first union all select *, 1 as turn from rest) order by turn, id limit 4000),
best as (select id, content, round(list_cosine_similarity(embedding, (select embedding::double[] from embeddings where vec_id = 7)), 6) as semantic from pool order by semantic desc, id limit 30)
select id, semantic, length(content) as size from best""")
def v4_bounded_rerank(spark, sf):
    vector = table(spark, sf, "embeddings").filter("vec_id = 7").select(F.col("embedding").cast("array<double>")).first()[0]
    found = retrieval.bounded_rerank(0, chunks(spark, sf, True), vector, F.contains(F.lower("content"), F.lit("worthless")))
    return found.select("id", "semantic", F.length("content").alias("size"))


@query(f"""with {CHUNKS}, {QUESTIONS}, rows as (select * from chunks where len(embedding) > 10),
terms as (select question_id, list_transform(list_filter(regexp_split_to_array(regexp_replace(words, '[^\\x{{0600}}-\\x{{06FF}}a-zA-Z0-9]', ' ', 'g'), ' +'), lambda x: length(x) >= 3)[1:5], lambda x: lower(x)) as terms from questions),
hits as (select question_id, id from terms, rows where len(list_filter(terms, lambda t: contains(lower(content), t) or contains(lower(source_title), t))) > 0 qualify row_number() over (partition by question_id order by id) <= 1500),
pool as (select q.question_id, r.id, r.embedding, q.vector from questions q cross join rows r left join hits h on h.question_id = q.question_id and h.id = r.id
  qualify row_number() over (partition by q.question_id order by case when h.id is null then 1 else 0 end, r.id) <= 4000)
select question_id, id, round(list_cosine_similarity(embedding, vector), 6) as semantic from pool qualify row_number() over (partition by question_id order by round(list_cosine_similarity(embedding, vector), 6) desc, id) <= 30""")
def v4_bounded_rerank_all(spark, sf):
    """Every question's bounded rerank in one plan."""
    asked = questions(spark, sf).select("question_id", F.col("words").alias("question"), "vector")
    return retrieval.bounded_rerank_all(asked, chunks(spark, sf, True)).select("question_id", "id", "semantic")


_HAY = "lower(source_title || chr(10) || content)"


_EXACT_AND_NEAR = """exact as (select question_id, id, 'exact_article' as match_kind, 0.0::double as semantic, row_number() over (partition by question_id order by case source_type when 'statute' then 0 when 'advisory_opinion' then 1 else 2 end, id) as pos
  from questions join chunks on article_number = cast(question_id % 97 as varchar) qualify pos <= 80),
vec as (select question_id, id, 'vector' as match_kind, round(list_cosine_similarity(embedding, vector), 6) as semantic, 2000000 + row_number() over (partition by question_id order by round(list_cosine_similarity(embedding, vector), 6) desc, id) as pos
  from questions, chunks where len(embedding) > 10 qualify pos <= 2000030)"""
_FUSED = """toks as (select question_id, list_filter(regexp_split_to_array(question, '[^\\x{0600}-\\x{06FF}a-zA-Z0-9]+'), lambda t: length(t) >= 3) as toks from questions),
scored as (select c.*, article_number = cast(question_id % 97 as varchar) as is_exact,
  round(case when article_number = cast(question_id % 97 as varchar) then 0.72 else 0 end * 1.35 + semantic * 0.55
   + case when len(toks) > 0 then len(list_filter(toks, lambda t: contains(source_title || chr(10) || trim(regexp_replace(content, '[ \\n\\t]+', ' ', 'g')), t))) / len(toks) else 0 end * 0.25
   + case source_type when 'statute' then 90 when 'advisory_opinion' then 40 when 'case_law' then 35 else 88 end / 100 * 0.12 + case when source_url like 'http%' then 0.08 else 0 end, 6) as score
  from cand c join chunks using (id) join toks using (question_id)),
one as (select *, min(pos) over (partition by question_id, id) as first_pos from scored qualify row_number() over (partition by question_id, id order by score desc, pos) = 1),
kept as (select *, case when is_exact then 'exact_article' when match_kind = 'exact_article' then 'fts' else match_kind end as kind from one)
select question_id, id, kind as match_kind, score, row_number() over (partition by question_id order by score desc, first_pos) as rank from kept where kind in ('exact_article', 'fts') or score > 0.18 qualify rank <= 8"""


@query(f"with {CHUNKS}, {QUESTIONS}, {_EXACT_AND_NEAR}, cand as (select * from exact union all select * from vec), {_FUSED}")
def v5_hybrid_rank(spark, sf):
    asked, rows = questions(spark, sf), chunks(spark, sf, True)
    exact = retrieval.exact_lookup(asked, rows.drop("embedding")).select("question_id", "id", F.lit("exact_article").alias("match_kind"), F.lit(0.0).alias("semantic"), F.col("rank").alias("pos"))
    near = retrieval.nearest_by_cosine(asked, rows).select("question_id", "id", F.lit("vector").alias("match_kind"), "semantic", (F.lit(2_000_000) + F.col("rank")).alias("pos"))
    both = exact.unionByName(near)
    hydrated = rows.drop("embedding").join(both.select("id").distinct(), "id", "left_semi").withColumn("hay", retrieval.haystack(F.col("source_title"), F.col("content")))
    found = hydrated.join(both, "id").join(F.broadcast(asked.select("question_id", "question")), "question_id")
    return retrieval.rank(found, places=6).select("question_id", "id", "match_kind", "score", F.col("rank").cast("long").alias("rank"))


_RETRIEVED = f"""with {CHUNKS}, {QUESTIONS}, {_EXACT_AND_NEAR},
terms as (select question_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(question), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> ''))) as token from questions),
searched as (select id, source_title || ' ' || article_number || ' ' || content as s from chunks),
held as (select distinct id, length(s) as size, unnest(regexp_split_to_array(lower(s), '[^\\p{{L}}\\p{{N}}]+')) as token from searched),
whole as (select question_id, id, size, count(*) as hits from held join terms using (token) group by all),
need as (select question_id, count(*) as n from terms group by 1),
every as (select question_id, id, row_number() over (partition by question_id order by size, id) as r from whole join need using (question_id) where hits = n qualify r <= 30),
loose as (select question_id, list_transform(list_filter(regexp_split_to_array(regexp_replace(question, '[^\\x{{0600}}-\\x{{06FF}}a-zA-Z0-9]', ' ', 'g'), ' +'), lambda x: length(x) >= 3)[1:5], lambda x: lower(x)) as terms
  from questions where question_id not in (select question_id from every)),
fallback as (select question_id, id, row_number() over (partition by question_id order by id) as r from loose, chunks where len(list_filter(terms, lambda t: contains(lower(content), t) or contains(lower(source_title), t))) > 0 qualify r <= 30),
cand as (select * from exact union all select question_id, id, 'fts', 0.0::double, 1000000 + r from (select * from every union all select * from fallback) union all select * from vec), {_FUSED}"""


@query(_RETRIEVED)
def v6_retrieve(spark, sf):
    """All three branches as one plan; questions without a full-text row fall back to any of their words."""
    return retrieval.retrieve(questions(spark, sf), chunks(spark, sf, True), places=6).select("question_id", "id", "match_kind", "score", F.col("rank").cast("long").alias("rank"))


# Mixed questions: plain words, an article of a law named in the question (two laws), an article without a vector.
_LAWS = ("قانون مدنی", "قانون تجارت")
_HINTS = ("قانون مدنی", "تجارت")  # what titles of these laws are told by


def law_chunks(spark, sf) -> DataFrame:
    """chunks of which two thirds belong to one of two laws."""
    third = F.col("id") % 3
    return chunks(spark, sf, True).withColumn("source_title", F.when(third == 0, _LAWS[0]).when(third == 1, _LAWS[1]).otherwise(F.col("source_title")))


def mixed_questions(spark, sf) -> DataFrame:
    kind, number = F.col("question_id") % 4, (F.col("question_id") % 97).cast("string")
    asked = F.when(kind == 0, F.col("words")).otherwise(F.concat(F.lit("ماده "), number, F.when(kind == 1, f" {_LAWS[0]} ").when(kind == 3, f" {_LAWS[1]} ").otherwise(" "), "words"))
    return questions(spark, sf).select("question_id", asked.alias("question"), F.when(kind != 2, F.col("vector")).alias("vector"))


_MIXED = f"""with {CHUNKS.replace("chunks as (", "plain_chunks as (", 1)}, {QUESTIONS.replace("questions as (", "plain_questions as (", 1)},
chunks as (select * replace (case id % 3 when 0 then '{_LAWS[0]}' when 1 then '{_LAWS[1]}' else source_title end as source_title) from plain_chunks),
questions as (select question_id, case when question_id % 4 > 0 then cast(question_id % 97 as varchar) end as number, case question_id % 4 when 1 then '{_HINTS[0]}' when 3 then '{_HINTS[1]}' else '' end as hint,
  case when question_id % 4 = 0 then words else 'ماده ' || (question_id % 97) || case question_id % 4 when 1 then ' {_LAWS[0]} ' when 3 then ' {_LAWS[1]} ' else ' ' end || words end as question,
  case when question_id % 4 <> 2 then vector end as vector from plain_questions),
exact as (select question_id, id, 'exact_article' as match_kind, 0.0::double as semantic, row_number() over (partition by question_id order by case source_type when 'statute' then 0 when 'advisory_opinion' then 1 else 2 end, id) as pos
  from (select *, case when hint <> '' and contains(source_title, hint) then 0 else 1 end as tier from questions join chunks on article_number = number qualify tier = min(tier) over (partition by question_id)) qualify pos <= 80),
vec as (select question_id, id, 'vector' as match_kind, round(list_cosine_similarity(embedding, vector), 6) as semantic, 2000000 + row_number() over (partition by question_id order by round(list_cosine_similarity(embedding, vector), 6) desc, id) as pos
  from questions, chunks where len(embedding) > 10 and vector is not null qualify pos <= 2000030),
{_RETRIEVED[_RETRIEVED.index("terms as ("):_RETRIEVED.index("toks as (")]}toks as (select question_id, list_filter(regexp_split_to_array(question, '[^\\x{{0600}}-\\x{{06FF}}a-zA-Z0-9]+'), lambda t: length(t) >= 3) as toks, number, hint from questions),
scored as (select c.*, source_title, article_number, number, hint, coalesce(article_number = number, false) as asked_for, contains(source_title, hint) as of_law,
  case when article_number = number then case when hint = '' then 0.72 when contains(source_title, hint) then 1.0 else 0.35 end else 0 end as exact,
  round(case when article_number = number then case when hint = '' then 0.72 when contains(source_title, hint) then 1.0 else 0.35 end else 0 end * 1.35::double + semantic * 0.55
   + case when len(toks) > 0 then len(list_filter(toks, lambda t: contains(source_title || chr(10) || trim(regexp_replace(content, '[ \\n\\t]+', ' ', 'g')), t))) / len(toks) else 0 end * 0.25
   + case source_type when 'statute' then 90 when 'advisory_opinion' then 40 when 'case_law' then 35 else 88 end / 100 * 0.12 + case when source_url like 'http%' then 0.08 else 0 end, 6) as score
  from cand c join chunks using (id) join toks using (question_id)),
one as (select *, min(pos) over (partition by question_id, id) as first_pos from scored qualify row_number() over (partition by question_id, id order by score desc, pos) = 1),
kept as (select *, case when exact >= 0.72 then 'exact_article' when match_kind = 'exact_article' then 'fts' else match_kind end as kind from one),
wanted as (select *, coalesce(bool_or(kind = 'exact_article' and hint <> '' and of_law) over (partition by question_id), false) as named from kept where kind in ('exact_article', 'fts') or score > 0.18),
ranked as (select question_id, id, kind as match_kind, score, row_number() over (partition by question_id order by score desc, first_pos) as rank from wanted where not (named and hint <> '' and asked_for and not of_law) qualify rank <= 8)"""


@query(f"{_MIXED} select * from ranked")
def v6_mixed(spark, sf):
    """Questions that some row answers with all its words, that name a law whose rows suppress the same article of others, and
    that have no vector."""
    ranked = retrieval.retrieve(mixed_questions(spark, sf), law_chunks(spark, sf), places=6)
    return ranked.select("question_id", "id", "match_kind", "score", F.col("rank").cast("long").alias("rank"))


@query(f"""{_MIXED}, first as (select question_id, article_number from ranked join chunks using (id) where rank = 1)
select question_id, list(id order by rank) as retrieved_ids, list(match_kind order by rank) as kinds, any_value([f.article_number]) as cited, ['999'] as unverified, 2::bigint as n_cited, 1::bigint as n_unverified,
  count(*) as retrieved, count(*) filter (match_kind = 'exact_article') as exact_article_hits, count(*) filter (match_kind = 'fts') as fts_hits, count(*) filter (match_kind = 'vector') as vector_hits,
  count(*) filter (source_url like 'http%') as public_urls, count(*) filter (c.article_number = '999') as unbacked_rows
from ranked join chunks c using (id) join first f using (question_id) group by question_id""")
def v10_ask(spark, sf):
    """Questions asked from end to end: retrieval, an answer that cites its first source and one that nobody retrieved, the
    verification of both, the evaluation, the audit row and the citations that users see."""

    def cite(ranked: DataFrame) -> DataFrame:
        first = ranked.filter("rank = 1")
        return first.select("question_id", F.concat(F.lit("به موجب ماده "), "article_number", F.lit(" و ماده 999")).alias("answer"))

    rows = law_chunks(spark, sf)
    told = api.ask(mixed_questions(spark, sf), rows, F.lit("2026-01-01").cast("timestamp"), cite)
    shown = told.citations.groupBy("question_id").agg(F.count("source_url").alias("public_urls"), F.count_if(~F.col("verified")).alias("unbacked_rows"))
    audit = told.audit.select("question_id", "retrieved_ids", F.transform("match_kinds", lambda m: m["kind"]).alias("kinds"), F.transform("cited", lambda c: c["number"]).alias("cited"), F.transform("unverified", lambda c: c["number"]).alias("unverified"))
    measured = told.evaluation.select("question_id", F.col("cited").alias("n_cited"), F.col("unverified").alias("n_unverified"), "retrieved", "exact_article_hits", "fts_hits", "vector_hits")
    return audit.join(measured, "question_id").join(shown, "question_id")


@query(ORACLE_SQL["v6_retrieve"])
def v6_indexed(spark, sf):
    """v6 over stored indexes of texts, words and vectors: no branch scans the texts."""
    path, rows = _folder(spark, "indexes"), chunks(spark, sf, True)
    text_index.build_indexes(rows, path, rows.agg(F.max(F.size("embedding"))).first()[0])
    ranked = retrieval.retrieve(questions(spark, sf), rows, places=6, branches=text_index.indexed(rows, path))
    return ranked.select("question_id", "id", "match_kind", "score", F.col("rank").cast("long").alias("rank"))


@query("""with q as (select vec_id as phrase_id, vec_id // 4 as request_id, embedding::double[] as v from embeddings),
near as (select request_id, phrase_id, vec_id as id, 1 - round(list_cosine_similarity(embedding::double[], v), 6) as distance from q, embeddings qualify row_number() over (partition by phrase_id order by round(list_cosine_similarity(embedding::double[], v), 6) desc, vec_id) <= 8),
best as (select request_id, id, min(distance) as distance from near group by all)
select request_id, id, round(distance, 6) as distance, row_number() over (partition by request_id order by distance, id) as rank from best qualify rank <= 10""")
def v7_o7_multi_query(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    asked = e.select(F.struct((F.col("vec_id") / 4).cast("long").alias("request_id"), F.col("vec_id").alias("phrase_id")).alias("question_id"), F.col("embedding").alias("vector"))
    near = retrieval.nearest_by_cosine(asked, e.withColumnRenamed("vec_id", "id"), 8)
    merged = retrieval.merge_by_distance(near.select("question_id.request_id", "id", (1 - F.col("semantic")).alias("distance")), "request_id", "id")
    return merged.select("request_id", "id", F.round("distance", 6).alias("distance"), F.col("rank").cast("long").alias("rank"))


@query("""with l as (select *, row_number() over (partition by conv_id order by turn desc) as rn from conversations)
select conv_id, turn, row_number() over (partition by conv_id order by rn desc) as place from l where rn <= 3""")
def o8_latest_reversed(spark, sf):
    return state.latest(table(spark, sf, "conversations").select("conv_id", "turn"), "conv_id", "turn", "turn", 3).select("conv_id", "turn", F.col("place").cast("long").alias("place"))


@query("select doc_id % 9 as rank, doc_id, length(text) as size from documents order by rank, size desc, doc_id limit 50")
def o10_by_rank_and_size(spark, sf):
    return table(spark, sf, "documents").select((F.col("doc_id") % 9).alias("rank"), "doc_id", F.length("text").alias("size")).orderBy("rank", F.desc("size"), "doc_id").limit(50)


# ---- set operations


@query("select doc_id as id, 'd' as origin from documents union all select item_id, 'b' from benchmark")
def u1_union(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.lit("d").alias("origin")).unionByName(table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.lit("b").alias("origin")))


@query("select doc_id as id, min(turn) as turn from (select doc_id, 0 as turn from labels where quality = 0 union all select doc_id, 1 from documents) group by doc_id")
def u2_union_by_priority(spark, sf):
    both = table(spark, sf, "labels").filter("quality = 0").select(F.col("doc_id").alias("id"), F.lit(0).alias("turn")).unionByName(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.lit(1).alias("turn")))
    return both.groupBy("id").agg(F.min("turn").alias("turn"))


@query("select doc_id from documents except select doc_id from labels")
def u6_difference(spark, sf):
    return table(spark, sf, "documents").select("doc_id").exceptAll(table(spark, sf, "labels").select("doc_id").distinct())


# ---- functions


@query("select doc_id, translate(translate(cast(doc_id as varchar), '0123456789', '۰۱۲۳۴۵۶۷۸۹'), '۰۱۲۳۴۵۶۷۸۹', '0123456789') as number, translate(cast(doc_id as varchar), '0123456789', '۰۱۲۳۴۵۶۷۸۹') as persian from documents")
def x1_digits(spark, sf):
    fa = T.persian_digits(F.col("doc_id").cast("string"))
    return table(spark, sf, "documents").select("doc_id", T.latin_digits(fa).alias("number"), fa.alias("persian"))


@query("select doc_id, sha256(trim(regexp_replace(text, '[ \\n\\t\\r]+', ' ', 'g'))) as hash, sha256(text) as raw_hash, substr(sha256(text), 1, 16) as short_hash from documents")
def x2_x15_normalised_hashes(spark, sf):
    c = F.col("text")
    return table(spark, sf, "documents").select("doc_id", F.sha2(T.normalize(c), 256).alias("hash"), T.content_hash(c).alias("raw_hash"), T.short_hash(c).alias("short_hash"))


@query(f"""with {QUESTIONS} select question_id, [{{'kind': 'article', 'number': cast(question_id % 97 as varchar), 'law_hint': ''}}] as refs from questions""")
def x5_article_refs(spark, sf):
    return questions(spark, sf).select("question_id", references.article_refs(F.col("question")).alias("refs"))


@query(f"with {QUESTIONS} select question_id, [cast(question_id % 97 as varchar), translate(cast(question_id % 97 as varchar), '0123456789', '۰۱۲۳۴۵۶۷۸۹'), (question_id % 97) || 'مکرر', (question_id % 97) || ' مکرر', translate(cast(question_id % 97 as varchar), '0123456789', '۰۱۲۳۴۵۶۷۸۹') || 'مکرر', translate(cast(question_id % 97 as varchar), '0123456789', '۰۱۲۳۴۵۶۷۸۹') || ' مکرر'] as spellings from questions")
def x6_match_values(spark, sf):
    return questions(spark, sf).select("question_id", references.match_values(references.article_refs(F.col("question"))[0]).alias("spellings"))


@query(f"""with {CHUNKS} select id, case source_type when 'statute' then 'binding' when 'convention' then 'binding_if_valid' when 'advisory_opinion' then 'advisory' else 'persuasive' end as binding,
 case source_type when 'statute' then 90 when 'convention' then 88 when 'advisory_opinion' then 40 else 35 end as rank from chunks""")
def x10_authority(spark, sf):
    a = authority.authority(F.col("source_type"), F.col("source_title"))
    return chunks(spark, sf).select("id", a["binding"].alias("binding"), a["rank"].alias("rank"))


@query(f"with {CHUNKS} select id, source_url like 'http%' as official from chunks")
def x11_official_url(spark, sf):
    return chunks(spark, sf).select("id", T.is_official_url(F.col("source_url")).alias("official"))


@query("""with n as (select doc_id, text, case when length(text) = 0 then 0 when length(text) <= 1100 then 1 else ceil((length(text) - 1100) / 950) + 1 end as n from documents),
c as (select doc_id, i as place, substr(text, cast(i * 950 + 1 as int), 1100) as piece from n, range(0, 1000) t(i) where i < n)
select doc_id, cast(place as int) as place, length(piece) as size, sha256(piece) as hash from c""")
def x17_w8_sliding_chunks(spark, sf):
    each = table(spark, sf, "documents").select("doc_id", F.posexplode(chunking.sliding_chunks(F.col("text"))).alias("place", "piece"))
    return each.select("doc_id", "place", F.length("piece").alias("size"), T.content_hash(F.col("piece")).alias("hash"))


@query()
def x18_pack_paragraphs(spark, sf):
    packed = chunking.pack_paragraphs(F.replace("text", F.lit("\n"), F.lit("\n\n")))
    return table(spark, sf, "documents").select("doc_id", F.posexplode(packed).alias("place", "piece")).select("doc_id", "place", F.length("piece").alias("size"))


@query()
def x19_x20_article_chunks(spark, sf):
    marked = F.regexp_replace("text", r"\n", "\nماده 7 - ")
    packed = chunking.pack_articles(chunking.split_articles(marked), F.col("source"), F.lit(None).cast("string"))
    return table(spark, sf, "documents").select("doc_id", F.posexplode(packed).alias("place", "c")).select("doc_id", "place", "c.number", F.length("c.body").alias("size"))


@query("select doc_id, regexp_extract(source, '([0-9]+)', 1) as digits, lower(trim(regexp_replace(regexp_replace(source || '_A-b(2).pdf', '\\([0-9]+\\)|\\.pdf', '', 'g'), '[_-]+', ' ', 'g'))) as name from documents")
def x28_source_name(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.regexp_extract("source", "([0-9]+)", 1).alias("digits"), T.source_name(F.concat("source", F.lit("_A-b(2).pdf"))).alias("name"))


@query("select page_id, nullif(regexp_extract(url, 'page=([0-9]+)', 1), '') as number from pages")
def x60_query_id(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.query_id(F.col("url"), "page").alias("number"))


@query("""with e as (select vec_id, embedding::double[] as v from embeddings)
select a.vec_id, round(list_cosine_similarity(a.v, b.v), 6) as cosine from e a, (select v from e where vec_id = 3) b""")
def x42_cosine(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    one = e.filter("vec_id = 3").select(F.col("v").alias("b"))
    return e.join(F.broadcast(one)).select("vec_id", F.round(vectors.cosine(F.col("v"), F.col("b")), 6).alias("cosine"))


@query("""with e as (select vec_id, embedding::double[] as v from embeddings), n as (select *, sqrt(list_sum(list_transform(v, lambda x: x * x))) as n from e)
select vec_id, list_transform(v, lambda x: case when round(x / n, 5) = 0 then 0.0::double else round(x / n, 5) end) as unit from n""")
def x43_l2_normalise(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return e.select("vec_id", vectors.rounded(vectors.l2_normalize(F.col("v")), 5).alias("unit"))


@query("select event_id, json_extract_string(props, '$.k')::bigint as k from events")
def x44_s10_json_properties(spark, sf):
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("select c_custkey, 'Dear ' || trim(c_name) || ', segment ' || c_mktsegment || ' ………………' as letter from customer")
def x45_fill_template(spark, sf):
    answers = F.create_map(F.lit("name"), F.concat(F.lit(" "), "c_name"), F.lit("segment"), F.col("c_mktsegment"), F.lit("blank"), F.lit(" "))
    return table(spark, sf, "customer").select("c_custkey", T.fill_template(F.lit("Dear {{name}}, segment {{segment}} {{blank}}"), answers).alias("letter"))


_FORMS = [(0, "fraud-complaint", "criminal"), (1, "claim-money", "civil"), (2, "damages", "civil")]
_KEYWORDS = [("claim-money", "worthless"), ("claim-money", "trash"), ("damages", "disgusting"), ("damages", "the"), ("fraud-complaint", "idiot")]
_BOOSTS = [("fraud-complaint", "stupid|idiot", 6), ("damages", "tra.?sh", 4)]


@query("""with rules(form_id, pattern, weight, place) as (values ('claim-money', 'worthless', 2, 1), ('claim-money', 'trash', 1, 1), ('damages', 'disgusting', 2, 2), ('damages', 'the', 1, 2), ('fraud-complaint', 'idiot', 1, 0), ('fraud-complaint', 'stupid|idiot', 6, 0), ('damages', 'tra.?sh', 4, 2)),
s as (select doc_id as story_id, form_id, place, sum(weight) as score from documents join rules on regexp_matches(text, pattern) group by all)
select story_id, form_id, score::bigint as score, row_number() over (partition by story_id order by score desc, place) as rank from s qualify rank <= 4""")
def x47_o9_form_scores(spark, sf):
    stories = table(spark, sf, "documents").select(F.col("doc_id").alias("story_id"), F.col("text").alias("story"))
    forms = spark.createDataFrame(_FORMS, "place int, form_id string, track string")
    scored = classify.scores(stories, spark.createDataFrame(_KEYWORDS, "form_id string, keyword string"), spark.createDataFrame(_BOOSTS, "form_id string, pattern string, weight int"))
    return classify.top_forms(scored, forms).select("story_id", "form_id", "score", F.col("rank").cast("long").alias("rank"))


@query("""with rules(form_id, pattern, weight, place) as (values ('claim-money', 'worthless', 2, 1), ('claim-money', 'trash', 1, 1), ('damages', 'disgusting', 2, 2), ('damages', 'the', 1, 2), ('fraud-complaint', 'idiot', 1, 0), ('fraud-complaint', 'stupid|idiot', 6, 0), ('damages', 'tra.?sh', 4, 2)),
s as (select doc_id, form_id, place, sum(weight) as score from documents join rules on regexp_matches(text, pattern) group by all),
b as (select doc_id, form_id, score from s qualify row_number() over (partition by doc_id order by score desc, place) = 1)
select doc_id as story_id, coalesce(form_id, 'claim-money') as form_id, case when score >= 6 then 'high' else 'medium' end as confidence from documents left join b using (doc_id)""")
def x48_classify(spark, sf):
    stories = table(spark, sf, "documents").select(F.col("doc_id").alias("story_id"), F.col("text").alias("story"), F.lit(None).cast("string").alias("form_id"), F.lit(False).alias("has_judgment"))
    forms = spark.createDataFrame(_FORMS, "place int, form_id string, track string")
    keywords, boosts = spark.createDataFrame(_KEYWORDS, "form_id string, keyword string"), spark.createDataFrame(_BOOSTS, "form_id string, pattern string, weight int")
    return classify.classify(stories, forms, keywords, boosts).select("story_id", "form_id", "confidence")


@query("select n_nationkey, case n_name when 'GERMANY' then 'DE' when 'FRANCE' then 'FR' when 'ROMANIA' then 'RO' when 'RUSSIA' then 'RU' when 'UNITED KINGDOM' then 'GB' end as code, case when n_nationkey % 2 = 0 then 'DE' else null end as iso from nation")
def x50_country(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", T.country(F.col("n_name")).alias("code"), T.country(F.when(F.col("n_nationkey") % 2 == 0, "deu").otherwise("xyz")).alias("iso"))


@query("""select conv_id as question_id, string_agg('[' || (turn + 1) || '] ' || role || ' — ' || (turn + 1) || chr(10) || left(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1200), chr(10) || chr(10) order by turn) as sources from conversations group by conv_id""")
def x53_source_lines(spark, sf):
    """Every turn as a source of its conversation's prompt, as long as a prompt quotes one."""
    turns = table(spark, sf, "conversations").select(F.col("conv_id").alias("question_id"), (F.col("turn") + 1).alias("rank"), F.col("role").alias("source_title"), (F.col("turn") + 1).cast("string").alias("article_number"), F.col("text").alias("content"))
    return citations.source_lines(turns).select("question_id", "sources")


@query("select doc_id, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(source || ' ' || (doc_id % 97) || ' ' || substr(text, 1, 40000)), '[^\\p{L}\\p{N}]+'), lambda x: x <> ''))) as tokens from documents")
def x61_search_tokens(spark, sf):
    searched = T.search_text(F.col("source"), (F.col("doc_id") % 97).cast("string"), F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.array_sort(T.search_tokens(searched)).alias("tokens"))


@query("""with a as (select doc_id as question_id, 'ماده ' || (doc_id % 5) || ' و ماده ۰' || (doc_id % 7) || ' و اصل ' || (doc_id % 3) as answer from documents),
cites as (select question_id, 'article' as kind, cast(question_id % 5 as varchar) as number from a union select question_id, 'article', cast(question_id % 7 as varchar) from a union select question_id, 'principle', cast(question_id % 3 as varchar) from a),
v as (select question_id, kind, number, number = cast(question_id % 5 as varchar) as verified from cites)
select question_id, kind, number, verified from v""")
def x35_j6_verify_citations(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("question_id"))
    n = lambda k: (F.col("question_id") % k).cast("string")
    answers = d.withColumn("answer", F.concat(F.lit("ماده "), n(5), F.lit(" و ماده ۰"), n(7), F.lit(" و اصل "), n(3)))
    rows = d.select("question_id", n(5).alias("article_number"), F.lit("t").alias("source_title"), F.lit("no number").alias("content"))
    return citations.verify(answers, rows).select("question_id", "kind", "number", "verified")


@query(f"""with {CHUNKS}, ranked as ({_RETRIEVED}) select question_id, count(*) as retrieved, count(*) filter (match_kind = 'exact_article') as exact_article_hits, count(*) filter (match_kind = 'fts') as fts_hits,
 count(*) filter (match_kind = 'vector') as vector_hits, count(*) filter (source_type in ('statute', 'convention')) as binding_sources, count(*) filter (source_type in ('advisory_opinion', 'case_law')) as advisory_sources
 from ranked join chunks using (id) group by 1""")
def v10_evaluation(spark, sf):
    ranked = retrieval.retrieve(questions(spark, sf), chunks(spark, sf, True), places=6)
    return citations.evaluate_retrieval(ranked)


# ---- anonymising, pages, crawl


@query("""select conv_id, turn, '{"persons":[{"role":"' || role || '"}],"description":' || to_json('…… said ' || replace(text, 'Name' || conv_id, '……')) || '}' as content, role as title from conversations""")
def x39_anonymise(spark, sf):
    """Case files made of conversations: names in persons are redacted in the description."""
    c = table(spark, sf, "conversations")
    person = F.struct(F.col("role").alias("role"), F.concat(F.lit("Name"), "conv_id").alias("fullName"))
    record = F.to_json(F.struct(F.array(person).alias("persons"), F.concat(F.lit("Name"), "conv_id", F.lit(" said "), "text").alias("description")))
    return c.select("conv_id", "turn", anonymize.anonymized()(record).alias("c")).select("conv_id", "turn", "c.content", "c.title")


@query()
def s12_extract_pages(spark, sf):
    page = crawl.extracted(F.col("html"))
    return table(spark, sf, "pages").select("page_id", page.alias("p")).select("page_id", "p.title", F.length("p.text").alias("size"), F.size("p.links").alias("links"))


@query("""with l as (select split_part(split_part(url, '://', 2), '/', 1) as host, page_id from pages),
n as (select host, unnest([host, host, 'other.invalid', 'sub.' || host]) as to_host, unnest(['/next/' || (page_id + 1), '/same', '/next/' || page_id, '/deep/' || page_id]) as path from l),
f as (select 'https://' || to_host || path as url, min(host) as source_id from n where to_host <> 'other.invalid' group by 1)
select url, source_id from f where url not in (select url from pages)""")
def x12_d7_discover_links(spark, sf):
    """Links put into every page: relative, absolute with a fragment, to a foreign host, to a host below, and unusable ones."""
    host = crawl.host_of(F.col("url"))
    body = F.concat(
        F.lit('<a href="/next/'), F.col("page_id") + 1, F.lit('#top">next</a><a href="https://'), host, F.lit('/same#a">same</a><a href="https://other.invalid/next/'), F.col("page_id"), F.lit('">far</a><a href="//sub.'), host,
        F.lit("/deep/"), F.col("page_id"), F.lit('">below</a><a href="mailto:x@y.z">mail</a><a href="javascript:void(0)">no</a>'),
    )
    pages = table(spark, sf, "pages").select(F.regexp_replace("url", "^http:", "https:").alias("url"), host.alias("source_id"), crawl.extracted(F.concat("html", body))["links"].alias("hrefs"))
    found = pages.select("source_id", crawl.absolute(F.col("hrefs"), F.col("url")).alias("links"))
    sources = table(spark, sf, "pages").select(host.alias("source_id")).distinct().withColumn("allowed_host", F.col("source_id"))
    return crawl.discovered(found, table(spark, sf, "pages").select("url"), sources)


@query("""with p as (select page_id, case when page_id % 11 = 0 then 'skipped' when page_id % 7 = 0 then 'failed' when length(html) < 200 then 'unchanged' when page_id % 3 = 0 then 'unchanged' else 'updated' end as result, page_id % 4 as attempts from pages)
select page_id, result, case result when 'skipped' then 'skipped' when 'failed' then case when attempts + 1 >= 3 then 'failed' else 'pending' end else 'done' end as status, case when result = 'failed' then attempts + 1 else attempts end as attempts from p""")
def d5_t4_t5_crawl_outcome(spark, sf):
    p = table(spark, sf, "pages").select("page_id", (F.col("page_id") % 11 != 0).alias("allowed"), (F.col("page_id") % 7 != 0).alias("ok"), F.lit(True).alias("is_html"), F.col("html").alias("text"), F.when(F.col("page_id") % 3 == 0, F.sha2("html", 256)).alias("old_hash"), (F.col("page_id") % 4).alias("attempts"))
    return crawl.outcome(p).select("page_id", "result", "status", "attempts")


@query("""with s as (select event_id from events where event_type = 'click' and ts < timestamp '2024-01-20' - interval 24 hours qualify row_number() over (partition by user_id % 5 order by ts nulls last, event_id) <= 3)
select event_id as url, case when s.event_id is not null then 'pending' when event_type = 'click' then 'done' else event_type end as status from events left join s using (event_id)""")
def d6_requeue(spark, sf):
    frontier = table(spark, sf, "events").select(F.col("event_id").alias("url"), (F.col("user_id") % 5).alias("source_id"), F.when(F.col("event_type") == "click", "done").otherwise(F.col("event_type")).alias("status"), F.col("ts").alias("last_crawled_at"))
    return crawl.requeue_stale(frontier, F.lit("2024-01-20").cast("timestamp")).select("url", "status")


# ---- writing


@query("select doc_id, text as content from documents where doc_id % 2 = 0 union all select doc_id, 'new' from (select distinct doc_id from labels) where doc_id % 2 = 1")
def d1_insert_ignore(spark, sf):
    old = table(spark, sf, "documents").filter("doc_id % 2 = 0").select("doc_id", F.col("text").alias("content"))
    return state.insert_ignore(old, table(spark, sf, "labels").select("doc_id", F.lit("new").alias("content")), "doc_id")


@query("""select coalesce(d.doc_id, l.doc_id) as doc_id, case when l.doc_id is not null then 'quality ' || l.quality else d.text end as content, coalesce(d.source, 'labels') as source
from (select * from documents where doc_id % 3 > 0) d full join (select doc_id, min(quality) as quality from labels group by 1) l on d.doc_id = l.doc_id""")
def d2_upsert(spark, sf):
    old = table(spark, sf, "documents").filter("doc_id % 3 > 0").select("doc_id", F.col("text").alias("content"), "source")
    new = table(spark, sf, "labels").groupBy("doc_id").agg(F.concat(F.lit("quality "), F.min("quality").cast("string")).alias("content")).withColumn("source", F.lit("labels"))
    return state.upsert(old, new, "doc_id", ["content"])


@query("select doc_id, source from documents where source not in ('src1', 'src4') union all select item_id, 'src1' from benchmark union all select item_id, 'src4' from benchmark")
def d4_scoped_replace(spark, sf):
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), F.explode(F.array(F.lit("src1"), F.lit("src4"))).alias("source"))
    return state.scoped_replace(table(spark, sf, "documents").select("doc_id", "source"), b, ["source"])


@query("select conv_id, turn from conversations where not (conv_id % 3 = 0 and turn = 0)")
def d10_delete_owned(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn")
    return state.delete_owned(rows, rows.filter("conv_id % 3 = 0 and turn = 0"), "turn", "conv_id")


@query("select event_id from events where ts >= timestamp '2024-01-20' - interval 1 hour")
def d11_expire(spark, sf):
    return state.expire(table(spark, sf, "events"), "ts", F.lit("2024-01-20").cast("timestamp")).select("event_id")


@query("""with r as (select user_id, coalesce(nullif(m, 3), 0) as matter_id from (select distinct user_id, user_id % 4 as m from events)), m as (select user_id, min(ts) as t, event_type from events group by user_id, event_type)
select user_id, min_by(event_type, {'t': t, 'e': event_type}) as resolved from m group by user_id""")
def w11_resolve_matter(spark, sf):
    e = table(spark, sf, "events")
    matters = e.groupBy("user_id", F.col("event_type").alias("matter_id")).agg(F.min("ts").alias("created_at"))
    return state.resolve_matter(e.select("user_id", F.lit("none").alias("matter_id")).distinct(), matters).select("user_id", "resolved")


@query("""with old as (select cast(user_id as varchar) as bucket_key, time_bucket(interval '3600 seconds', ts, timestamp '1970-01-01') as window_start from events where event_id % 2 = 0),
new as (select cast(user_id as varchar) as bucket_key, time_bucket(interval '3600 seconds', ts, timestamp '1970-01-01') as window_start from events where event_id % 2 = 1)
select bucket_key, window_start, count(*) as hits from (select * from old union all select * from new) group by all""")
def d3_increment(spark, sf):
    e = table(spark, sf, "events")
    old = state.window_counts(e.filter("event_id % 2 = 0"), "user_id", "ts", 3600).select(F.col("user_id").cast("string").alias("bucket_key"), "window_start", "hits")
    return state.increment(old, e.filter("event_id % 2 = 1"), "user_id", "ts", 3600)


@query("select doc_id, sha256(array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(lower(source || ' ' || (doc_id % 97) || ' ' || substr(text, 1, 40000)), '[^\\p{L}\\p{N}]+'), lambda x: x <> ''))), ' ')) as hash from documents")
def d12_search_backfill(spark, sf):
    rows = sinks.with_search_tokens(chunks(spark, sf))
    return rows.select(F.col("id").alias("doc_id"), F.sha2(F.array_join(F.array_sort("tokens"), " "), 256).alias("hash"))


@query("select doc_id as id, case when doc_id % 3 = 0 then 'old' else 'new' end as content from documents where doc_id % 3 = 0 or lang = 'en'")
def d21_merge_sources(spark, sf):
    d = table(spark, sf, "documents")
    old = d.filter("doc_id % 3 = 0").select(F.col("doc_id").alias("id"), F.lit("old").alias("content"))
    return sinks.merge_sources([d.filter("lang = 'en'").select(F.col("doc_id").alias("id"), F.lit("new").alias("content"))], old)


@query("select distinct url from pages where page_id % 7 = 0")
def d16_retry_urls(spark, sf):
    return sinks.retry_urls(table(spark, sf, "pages"), F.col("page_id") % 7 == 0)


@query("""with s as (select source as source_file, count(*) as chunks from documents group by 1), n as (select *, substr(source_file, 1, 4) as k from s),
b as (select min_by(source_file, {'c': -chunks, 'f': source_file}) as source_file from (select *, lower(replace(source_file, '_', ' ')) as k2 from n) group by k2)
select doc_id from documents where source in (select source_file from b)""")
def j9_best_file(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.col("source").alias("source_file"))
    return corpus.best_files(d, d.groupBy("source_file").agg(F.count(F.lit(1)).alias("chunks"))).select("doc_id")


@query("select doc_id, title from documents join (values ('src1', 'one'), ('src5', 'five')) k(source, title) using (source)")
def j10_keep_list(spark, sf):
    keep = spark.createDataFrame([("src1", "one"), ("src5", "five")], "source string, title string")
    return corpus.with_keep_list(table(spark, sf, "documents"), keep, "source").select("doc_id", "title")


@query("select count(*) as rows, count(l.doc_id) as matched, count(quality) as quality, count(nullif(toxic, 0)) as toxic from documents d left join labels l using (doc_id)")
def j13_coverage(spark, sf):
    meta = table(spark, sf, "labels").withColumn("toxic", F.nullif("toxic", F.lit(0)))
    return corpus.coverage(table(spark, sf, "documents"), meta, "doc_id", ["quality", "toxic"])


@query("select doc_id, doc_id in (select doc_id from labels where quality = 1) as owned from documents")
def a23_owner_exists(spark, sf):
    owned = table(spark, sf, "labels").filter("quality = 1").withColumn("owner", F.lit("u"))
    return state.owns(owned, table(spark, sf, "documents").select("doc_id", F.lit("u").alias("owner")), "doc_id", "owner").select("doc_id", "owned")


@query("select n_name, n_nationkey from nation")
def o13_collated(spark, sf):
    return corpus.collated(table(spark, sf, "nation").select("n_name", "n_nationkey"), "n_name")


@query("""with l as (select conv_id || '/' || turn as stream, unnest(regexp_split_to_array(text, '\\n')) as line, unnest(range(0, len(regexp_split_to_array(text, '\\n')))) as line_no from conversations)
select stream, line_no, line from l where trim(line) <> ''""")
def t7_reassemble_lines(spark, sf):
    """Every turn as a stream of pieces of 64 characters that know nothing of lines."""
    turns = table(spark, sf, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("stream"), "text")
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.length("text") - 1), F.lit(64))
    pieces = turns.select("stream", "text", F.explode(starts).alias("at")).select("stream", "at", F.expr("substring(text, at + 1, 64)").alias("piece"))
    return jobs.reassemble_lines(pieces, "stream", "at", "piece").select("stream", F.col("line_no").cast("long").alias("line_no"), "line")


@query("""with w as (select cast(user_id as varchar) as key, time_bucket(interval '3600 seconds', ts, timestamp '1970-01-01') as window_start, count(*) as hits from events group by all)
select key, window_start, hits, least(hits, 2) as allowed from w""")
def t1_stream_decisions(spark, sf):
    """The rate limit as a stream: all events read as micro-batches with state per key and window, until none is left."""
    events = table(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    place = f"{shared_dir(spark)}/lexloom/{uuid.uuid4().hex}"
    events.write.parquet(f"{place}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{place}/in")
    jobs.decide(stream, "user_id", "ts", 3600, 2, "60 days").writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start().awaitTermination()
    found = spark.read.schema(jobs.DECISION).parquet(f"{place}/out").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
    return found.groupBy("key", "window_start").agg(F.count(F.lit(1)).alias("hits"), F.count_if("allowed").alias("allowed"))


@query("select doc_id, doc_id % 3 = 0 or doc_id % 5 = 0 or not contains(text, 'the ') or length(replace(text, 'the ', 'theماده ')) > 6000 as unusable from documents")
def p20_usable_article(spark, sf):
    body = F.replace("text", F.lit("the "), F.lit("theماده "))
    unusable = corpus.is_unusable_article(body, F.when(F.col("doc_id") % 3 == 0, "مقدمه"), F.when(F.col("doc_id") % 5 == 0, "قدیم"), F.lit("قانون اساسی"))
    return table(spark, sf, "documents").select("doc_id", unusable.alias("unusable"))


@query("select part.p_partkey, case when regexp_matches(p_type, 'BRASS') then 'statute' when regexp_matches(p_type, 'STEEL') then null when regexp_matches(p_type, 'TIN') then 'opinion' end as class from part")
def x29_source_class(spark, sf):
    return table(spark, sf, "part").select("p_partkey", cleaning.source_class(F.col("p_type"), [("BRASS", "statute"), ("STEEL", None), ("TIN", "opinion")]).alias("class"))


@query("select doc_id, case when doc_id % 9 = 2 then 'case_law' else 'statute' end as source_type, (doc_id % 9)::int as rank from documents")
def x30_x31_document_kind(spark, sf):
    titles = F.array(*map(F.lit, ("قانون کار", "آیین‌نامه", "رای دادگاه", "اساسنامه", "دستورالعمل", "تصویب نامه", "مصوبه", "بخشنامه", "دیگر")))
    kind = cleaning.document_kind(F.element_at(titles, (F.col("doc_id") % 9 + 1).cast("int")))
    return table(spark, sf, "documents").select("doc_id", cleaning.source_type_of_kind(kind).alias("source_type"), cleaning.kind_rank(kind).alias("rank"))


@query("select doc_id, case when doc_id % 100 = 0 then null else doc_id % 100 end as number from documents")
def x26_number_words(spark, sf):
    from lexloom.functions import fixed

    words = {n: w for w, n in reversed([*fixed.ONES.items(), *fixed.TENS.items()])}
    spelled = F.create_map(*(F.lit(x) for n in range(100) for x in (n, words[n] if n in words else f"{words[n // 10 * 10]} و {words[n % 10]}")))
    return table(spark, sf, "documents").select("doc_id", T.words_to_number(F.element_at(spelled, (F.col("doc_id") % 100).cast("int"))).cast("long").alias("number"))


@query("select doc_id, (1300 + doc_id % 200) || '/' || (1 + doc_id % 12) as date, case when doc_id % 200 < 200 then cast(1300 + doc_id % 200 as varchar) end as year from documents")
def x27_dates(spark, sf):
    raw = F.concat(F.lit("مصوب: "), T.persian_digits((1300 + F.col("doc_id") % 200).cast("string")), F.lit("-"), (1 + F.col("doc_id") % 12).cast("string"))
    return table(spark, sf, "documents").select("doc_id", T.labelled_date(raw).alias("date"), T.year(raw).alias("year"))


@query("""with p as (select source, doc_id, regexp_split_to_array('HEADER' || chr(10) || text || chr(10) || 'FOOTER', '\\n') as l from documents),
e as (select source, doc_id, trim(unnest(l)) as line, unnest(range(0, len(l))) as i, len(l) as n from p),
c as (select source, line, count(distinct doc_id) as "on" from e where (i < 3 or i >= n - 3) and line <> '' group by all), s as (select source, count(distinct doc_id) as pages from documents group by 1)
select source, line, "on", pages from c join s using (source) where pages > 1 and "on" > 0.05 * pages""")
def x57_page_furniture(spark, sf):
    """Lines that stand at the edge of one in twenty pages of a source."""
    pages = table(spark, sf, "documents").select("source", "doc_id", F.concat(F.lit("HEADER\n"), "text", F.lit("\nFOOTER")).alias("page"))
    return corpus.repeated_page_lines(pages, "source", "doc_id", "page", share=0.05)


# ---- analytics over the star schema


@query("""select l_returnflag, l_linestatus, sum(l_quantity) as sum_qty, count(*) as n from lineitem where l_shipdate <= timestamp '1998-09-02' group by all""")
def star_pricing_summary(spark, sf):
    return table(spark, sf, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp")).groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.count(F.lit(1)).alias("n"))


@query("""select o_orderkey, o_orderdate, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey where c_mktsegment = 'BUILDING' group by all order by revenue desc, o_orderkey limit 10""")
def star_top_orders(spark, sf):
    c = table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select("c_custkey")
    joined = table(spark, sf, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    revenue = F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2)
    return joined.groupBy("o_orderkey", "o_orderdate").agg(revenue.alias("revenue")).orderBy(F.desc("revenue"), "o_orderkey").limit(10)



"""Registered queries of readers, flatteners and cleaners: tables are written by Spark in the formats that the sources have,
in a new folder, and read back by the library. Importing this module adds them to the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom import schemas
from lexloom.functions import cleaning, references
from lexloom.functions import text as T
from lexloom.plans.catalogue import _folder, query, table
from lexloom.sources import readers, sinks

#: Records of a nested list: an export's file, a law's articles. Bounded, so that no list grows with the table.
NESTED = 20
#: Lists that one file holds.
FILE_LISTS = 256


def _lists(rows: DataFrame, record, key: str, name: str, *more) -> DataFrame:
    """One row for NESTED records: an array of them, in order."""
    return rows.groupBy(F.floor(F.col(key) / NESTED).alias("part")).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), record.alias("r")))), lambda x: x["r"]).alias(name), *more)


def _json_values(rows: DataFrame, value, path: str) -> None:
    """Files of one JSON value each, a list of up to FILE_LISTS rows' values, so that files do not follow the rows' number.

    The file's readers take a list of values, or of lists' members, as that many values.
    """
    files = rows.select(F.floor(F.col("part") / FILE_LISTS).alias("file"), value.alias("value")).groupBy("file").agg(F.array_join(F.collect_list("value"), ",").alias("value"))
    files.select(F.concat(F.lit("["), "value", F.lit("]")).alias("value"), "file").repartition("file").write.partitionBy("file").text(path)


@query("select cast(doc_id as varchar) as id, text as content, sha256(text) as hash, source as source_title, cast(length(text) as int) as word_count, lang as domain from documents")
def s2_s3_jsonl(spark, sf):
    """Documents through gzipped JSON lines and through dataset parts."""
    path, rows = _folder(spark, "jsonl"), table(spark, sf, "documents")
    sinks.json_files(rows.select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("content"), F.col("source").alias("source_title")), f"{path}/chunks", "gzip")
    sinks.json_files(rows.select(F.col("doc_id").cast("string").alias("id"), "text", F.length("text").alias("word_count"), F.col("lang").alias("domain")), f"{path}/parts")
    chunks = readers.jsonl(spark, f"{path}/chunks").select("id", "content", "source_title")
    parts = readers.jsonl_parts(spark, f"{path}/parts").filter(F.endswith("part", F.lit(".json"))).select("id", T.content_hash(F.col("text")).alias("hash"), "word_count", "domain")
    return chunks.join(parts, "id").select("id", "content", "hash", "source_title", "word_count", "domain")


@query("select model, dim, cast(id as varchar) as id, embedding from (select 'unit' as model, len(embedding) as dim, vec_id as id, list_transform(embedding, lambda x: round(cast(x as double), 4) + 0.0::double) as embedding from embeddings)")
def s1_seed(spark, sf):
    """Embeddings through seed files {model, dim, chunks}."""
    path = _folder(spark, "seed")
    rows = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.round(x.cast("double"), 4)).alias("embedding"))
    files = _lists(rows, F.struct(F.col("vec_id").cast("string").alias("id"), "embedding"), "vec_id", "chunks", F.max(F.size("embedding")).alias("dim"))
    _json_values(files, F.to_json(F.struct(F.lit("unit").alias("model"), "dim", "chunks")), path)
    return readers.seed(spark, path).select("model", F.col("dim").cast("long").alias("dim"), "id", "embedding")


@query("""select case when page_id % 3 = 0 then 'http://loaded/' || page_id else url end as url, 'T ' || page_id as title, case when page_id % 2 = 0 then html else coalesce(left(html, 30), '') end as body, cast(200 + page_id % 4 as int) as http_status from pages""")
def s7_crawl_export(spark, sf):
    """Pages through crawl exports: lists of records, with either field as the longer body and the address in either place."""
    path, n = _folder(spark, "export"), F.col("page_id")
    record = F.struct(
        F.when(n % 3 == 0, F.lit("")).otherwise(F.col("url")).alias("url"), F.when(n % 2 == 0, F.col("html")).alias("markdown"), F.substring("html", 1, 30).alias("text"),
        F.struct(F.concat(F.lit(" T "), n.cast("string")).alias("title")).alias("metadata"), F.struct(F.concat(F.lit("http://loaded/"), n.cast("string")).alias("loadedUrl"), (200 + n % 4).alias("httpStatusCode")).alias("crawl"),
    )
    _json_values(_lists(table(spark, sf, "pages"), record, "page_id", "records"), F.regexp_replace(F.to_json("records"), r"^\[|\]$", ""), path)
    return readers.crawl_export(spark, path).select("url", "title", "body", "http_status")


@query(f"""with d as (select doc_id, text, lang, source, cast(doc_id // {NESTED} as varchar) as part from documents)
select 'law:' || doc_id as raw_id, text as content, 'statute' as source_type, case when doc_id // {NESTED} % 2 = 0 then 'Law ' || part || ' — Kind' else 'Law ' || part end as source_title, cast(doc_id as varchar) as article_number, null as law_date from d where doc_id % 5 = 0
union all select 'con:' || doc_id, text, 'convention', 'Treaty ' || part, null, null from d where doc_id % 5 = 1
union all select 'opin:' || doc_id, text, 'advisory_opinion', 'Year ' || part, case when doc_id % 2 = 0 then 'نظریه ' || doc_id end, null from d where doc_id % 5 = 2
union all select 'ara:' || doc_id, text, 'case_law', case when doc_id % 2 = 0 then 'Court' else 'رأی وحدت رویه' end, cast(doc_id as varchar), nullif(lang, 'en') from d where doc_id % 5 = 3
union all select 'term:' || doc_id, case when doc_id % 2 = 0 then source || ': ' || text else source end, 'terminology', trim('اصطلاح‌نامه حقوقی — حرف ' || lang), null, null from d where doc_id % 5 = 4""")
def s10_banks(spark, sf):
    """Documents through the five nested banks, one file a list."""
    path, rows = _folder(spark, "banks"), table(spark, sf, "documents").withColumn("id", F.col("doc_id").cast("string"))
    even, part = F.col("doc_id") % 2 == 0, F.floor(F.col("doc_id") / NESTED)

    def write(bank: str, remainder: int, record, value) -> None:
        _json_values(_lists(rows.filter(F.col("doc_id") % 5 == remainder), record, "doc_id", "records"), F.to_json(value), f"{path}/{bank}")

    label = lambda word: F.concat(F.lit(word), F.col("part").cast("string"))
    content = F.col("text").alias("content")
    write("laws", 0, F.struct(F.col("id").alias("item_id"), content, F.concat(F.lit(" "), "id", F.lit(" bis")).alias("article_label")), F.struct(F.array(F.struct(label("Law ").alias("law_title"), F.when(F.col("part") % 2 == 0, "Kind").otherwise("").alias("category"), F.col("records").alias("articles"))).alias("laws")))
    write("conventions", 1, F.struct(F.col("id").alias("item_id"), content), F.struct(F.array(F.struct(label("Treaty ").alias("title"), F.col("records").alias("articles"))).alias("conventions")))
    write("opinions", 2, F.struct(F.col("id").alias("opinion_id"), content, F.when(even, F.col("id")).alias("shomarenazarie")), F.struct(F.array(F.struct(label("Year ").alias("year_title"), F.col("records").alias("opinions"))).alias("years")))
    write("verdicts", 3, F.struct(F.col("id").alias("verdict_id"), content, F.when(even, "Court").otherwise("").alias("group"), F.col("id").alias("vote_no"), F.nullif("lang", F.lit("en")).alias("date")), F.struct(F.col("records").alias("verdicts")))
    write("terms", 4, F.struct(F.col("id").alias("term_id"), F.col("source").alias("word"), F.when(even, F.col("text")).alias("content"), F.col("lang").alias("letter")), F.struct(F.col("records").alias("terms")))
    return readers.banks(spark, {name: f"{path}/{name}" for name in readers.BANKS})


@query(r"""with m as (select doc_id, '# ' || source || chr(10) || '**' || text || '**' || chr(10) || '| a | b |' || chr(10) || '![x](y) [word ' || doc_id || '](http://u)<BR/>end&nbsp;' || chr(10) || 'Share this page' || text as raw from documents)
select doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(source || chr(10) || replace(replace(text, '**', ''), '__', '') || chr(10) || chr(10) || chr(10) || ' word ' || doc_id || chr(10) || 'end ', '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^[ \n\t|]+|[ \n\t|]+$', '', 'g'), '(?m)^#+\s*', '', 'g') as clean
from documents join m using (doc_id) where not regexp_matches(text, '(?m)^#|\||\\|&nbsp;|<|\[|^\s')""")
def x21_strip_chrome(spark, sf):
    """Documents inside a page's furniture, with what is no plain text left out of the comparison."""
    rows = table(spark, sf, "documents").filter(~F.col("text").rlike(r"(?m)^#|\||\\|&nbsp;|<|\[|^\s"))
    raw = F.concat(F.lit("# "), "source", F.lit("\n**"), "text", F.lit("**\n| a | b |\n![x](y) [word "), F.col("doc_id").cast("string"), F.lit("](http://u)<BR/>end&nbsp;\nShare this page"), "text")
    return rows.select("doc_id", cleaning.strip_chrome(raw, tail="Share this page").alias("clean"))


@query(r"""select doc_id, trim(regexp_replace(regexp_replace(replace(regexp_replace(text || chr(10) || 'www.Example.com', '(?i)www\.example\.com', ' ', 'g'), chr(0), ' '), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(9) || chr(13)) as clean from documents""")
def x22_clean_scan(spark, sf):
    return table(spark, sf, "documents").select("doc_id", cleaning.clean_scan(F.concat("text", F.lit("\nwww.Example.com")), r"www\.example\.com").alias("clean"))


@query(r"""select p_partkey, cast(p_size as varchar) as number, left(trim(regexp_replace(p_name, '[^0-9A-Za-z_]+', '-', 'g'), '-'), 50) as slug, left('part-' || regexp_replace(p_brand || '-' || p_type, '[^A-Za-z0-9_-]+', '-', 'g'), 80) as id,
  regexp_replace(p_type || '.*(x)', '([.*+?^${}()|\[\]\\])', '\\\1', 'g') as pattern, p_name || 'ab' as without, 'Page ' || p_partkey as title, ['one ' || p_partkey, 'two'] as phrases from part""")
def x33_x59_names(spark, sf):
    """Numbers, names, identifiers, patterns, hex file names and phrases of parts."""
    key = F.col("p_partkey").cast("string")
    hexed = F.concat(F.lit("file-0a1b-"), F.lower(F.hex(F.lit("Page").cast("binary"))), F.lit("-"), F.lower(F.hex(key.cast("binary"))), F.lit(".pdf"))
    told = F.when(F.length(key) >= 2, T.hex_file_name(hexed)).otherwise(F.concat(F.lit("Page "), key))  # fewer than four digits are no hex
    return table(spark, sf, "part").select(
        "p_partkey", T.leading_number(F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit("x"), "p_name")).alias("number"), T.slug(F.col("p_name")).alias("slug"), T.stable_id("part", F.col("p_brand"), F.col("p_type")).alias("id"),
        T.escape_pattern(F.concat("p_type", F.lit(".*(x)"))).alias("pattern"), T.without_nulls(F.concat("p_name", F.lit("a\x00b"))).alias("without"), told.alias("title"), T.phrases(F.concat(F.lit("1. \"one "), key, F.lit("\"\n\n- two\n"))).alias("phrases"),
    )


@query("""select doc_id, cast(doc_id % 900 + 1 as varchar) as of_scan, cast(doc_id % 90 + 1 as varchar) as of_row, 'قانون ' || source as title, cast(doc_id % 900 + 1 as varchar) as article_number, '1390/01/02' as law_date, 'statute-like' as kind,
  'قانون ' || source as heading, 'قانون ' || source || ' مصوب' as scan_title from documents""")
def x24_x25_x32_scan_fields(spark, sf):
    """Article numbers, titles and breadcrumbs of scanned and crawled documents."""
    n, small = (F.col("doc_id") % 900 + 1).cast("string"), (F.col("doc_id") % 90 + 1).cast("string")
    name = F.concat(F.lit("قانون "), "source")
    scan = F.concat(F.lit("متن ماده "), T.persian_digits(n), F.lit(" - "), "text")
    crumbs = cleaning.breadcrumb(F.concat(F.lit("# خانه > "), name, F.lit(" > ماده "), T.persian_digits(n), F.lit("\nمصوب ۱۳۹۰/۰۱/۰۲\n"), "text"))
    return table(spark, sf, "documents").select(
        "doc_id", cleaning.article_of_scan(scan).alias("of_scan"), cleaning.article_of_row(F.concat(F.lit("اصل "), T.persian_digits(small), F.lit(" : "), "text"), F.lit("")).alias("of_row"),
        crumbs["title"].alias("title"), crumbs["article_number"].alias("article_number"), crumbs["law_date"].alias("law_date"), crumbs["kind"].alias("kind"), cleaning.heading_title(F.concat(F.lit("# "), name, F.lit(" | پایگاه\n"), "text"), F.lit("x"), r"\| پایگاه").alias("heading"),
        cleaning.title_of_scan(F.col("text"), F.concat(name, F.lit(" مصوب - سایت x")), F.lit("file")).alias("scan_title"),
    )


@query("""select doc_id, case when doc_id % 5 = 0 then '9' when doc_id % 3 = 1 then cast(doc_id % 50 + 1 as varchar) when doc_id % 3 = 2 then cast(doc_id % 7 + 1 as varchar) end as number from documents""")
def x13_infer_article(spark, sf):
    """The stored article number, or for rows without one that in their title or content."""
    n, m = (F.col("doc_id") % 50 + 1).cast("string"), (F.col("doc_id") % 7 + 1).cast("string")
    content = F.when(F.col("doc_id") % 3 == 1, F.concat(F.lit("ماده "), T.persian_digits(n), F.lit(" - x"))).when(F.col("doc_id") % 3 == 2, F.concat(F.lit("اصل "), m, F.lit(" x"))).otherwise(F.lit("x"))
    return table(spark, sf, "documents").select("doc_id", references.infer_article(F.when(F.col("doc_id") % 5 == 0, " 9 ").otherwise(" "), F.col("source"), content).alias("number"))

"""The jobs as registered queries: each runs twice into a new folder under spark.checkpoint.dir and returns what stands there."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from jobs import ingest_documents, refresh_pages
from lexloom.functions import fixed as V
from lexloom.session import shared_dir


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/jobs/{name}-{uuid.uuid4().hex}"


def job1_ingest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents through the ingestion stream; the second run finds nothing new."""
    place = _folder(spark, "ingest")
    for _ in range(2):
        chunks = ingest_documents.ingest(spark, f"{sf_dir}/documents.parquet", f"{place}/corpus", f"{place}/checkpoint")
    return chunks.select("doc_id", "place", "content", "lang")


#: White space as the engine collapses it.
_SPACE = r"[\s\x{000B}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"


def _sliding(n: str, size: int = 1100, overlap: int = 150) -> str:
    """Places of the chunks of a text of so many characters."""
    return f"unnest(range(cast(case when {n} <= {size} then 1 else ceil(({n} - {size}) / {size - overlap}.0) + 1 end as bigint)))"


JOB1_SQL = f"""
with passed as (select doc_id, text, coalesce(nullif(trim(lang), ''), 'unknown') as lang, trim(regexp_replace(text, '{_SPACE}', ' ', 'g')) as plain
  from documents where doc_id is not null and length(coalesce(text, '')) >= 200),
one as (select * from passed qualify row_number() over (partition by doc_id order by sha256(plain)) = 1),
kept as (select * from one qualify row_number() over (partition by plain order by doc_id) = 1),
placed as (select doc_id, text, lang, {_sliding("length(text)")} as place from kept)
select doc_id, cast(place as integer) as place, substr(text, place * 950 + 1, 1100) as content, lang from placed
"""


def job2_refresh_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages through the refresh; the second run finds nothing above the mark."""
    place = _folder(spark, "pages")
    for _ in range(2):
        chunks = refresh_pages.refresh(spark, f"{sf_dir}/pages.parquet", place)
    return chunks.drop("part", "slice")


def _job2_sql() -> str:
    def plain(c: str) -> str:
        for entity, sign in V.ENTITIES:
            c = f"replace({c}, '{entity}', '{sign.replace(chr(39), chr(39) * 2)}')"
        c = rf"regexp_replace(regexp_replace({c}, '[ \t\r\f]+', ' ', 'g'), ' ?\n ?', chr(10), 'g')"
        return rf"regexp_replace(regexp_replace({c}, '\n{{3,}}', chr(10) || chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g')"

    body = "regexp_replace(html, '(?s)<!--.*?-->', '', 'g')"
    for tag in V.SILENT_TAGS:
        body = rf"regexp_replace({body}, '(?is)<{tag}\b[^>]*>.*?</{tag}\s*>', '', 'g')"
    body = rf"regexp_replace({body}, '(?i)<(?:br|/(?:{'|'.join(V.BLOCK_TAGS)}))\b[^>]*>', chr(10), 'g')"
    body = plain(f"regexp_replace({body}, '<[^>]*>', '', 'g')")
    title = plain("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")
    return rf"""
with parsed as (select page_id, regexp_replace(url, '#.*$', '') as url, left(trim(regexp_replace({title}, '{_SPACE}', ' ', 'g')), 300) as title, {body} as text
  from pages where page_id is not null and url is not null and html is not null),
hashed as (select *, regexp_replace(regexp_replace(lower(trim(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)', 1))), '\.$', ''), ':[0-9]+$', '') as site,
  sha256(title || chr(10) || text) as text_hash from parsed where length(text) >= 200),
latest as (select * from hashed qualify row_number() over (partition by url order by page_id desc, text_hash desc) = 1),
placed as (select *, {_sliding("length(text)")} as place from latest)
select 'page-' || left(sha256(url), 16) || '-' || place as id, url, site, title, cast(place as integer) as place, substr(text, place * 950 + 1, 1100) as content, text_hash from placed
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (job1_ingest_documents, job2_refresh_pages)}
ORACLE_SQL: dict[str, str] = {"job1_ingest_documents": JOB1_SQL, "job2_refresh_pages": _job2_sql()}

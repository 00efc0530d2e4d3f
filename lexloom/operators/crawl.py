"""The incremental crawl: frontier, robots rules, extraction, change detection, all as tables."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

from lexloom.functions.chunking import sliding_chunks
from lexloom.functions.text import content_hash, short_hash

DROPPED = {"script", "style", "nav", "header", "footer", "noscript", "iframe", "svg"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
PAGE = StructType([StructField("title", StringType()), StructField("text", StringType()), StructField("links", ArrayType(StringType()))])


class _Page(HTMLParser):
    """Text of the body, the first title and all link targets; elements in DROPPED leave nothing, links included."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title: str | None = None
        self.inside: list[str] = []
        self.words: list[str] = []
        self.head: list[str] = []
        self.links: list[str] = []
        self.dropped, self.in_title, self.in_head = 0, False, False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID:
            return
        if tag in DROPPED:
            self.dropped += 1
            self.inside.append(tag)
        if self.dropped:
            return
        if tag == "head":
            self.in_head = True
        elif tag == "body":
            self.in_head = False
        elif tag == "title":
            self.in_title = True
        elif tag == "a" and (href := dict(attrs).get("href")):
            self.links.append(href)

    def handle_endtag(self, tag: str) -> None:
        if tag in DROPPED and tag in self.inside:
            while self.inside.pop() != tag:
                pass
            self.dropped = len(self.inside)
        elif tag == "title":
            self.in_title = False
        elif tag == "head":
            self.in_head = False

    def handle_data(self, data: str) -> None:
        if self.in_title and not self.dropped:
            self.head.append(data)
        elif not self.dropped and not self.in_head:
            self.words.append(data)


def parse_page(html: str | None) -> tuple[str, str, list[str]]:
    """(title, text, links) of a page: blanks collapse, three newlines or more become two, a title has 300 characters at most."""
    page = _Page()
    page.feed(html or "")
    page.close()
    text = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", "".join(page.words))).strip()
    return "".join(page.head).strip()[:300], text, page.links


def extracted(html: Column) -> Column:
    """struct<title, text, links> by an Arrow UDF on the standard library's parser."""

    @F.pandas_udf(PAGE)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            yield pd.DataFrame([parse_page(x) for x in s], columns=["title", "text", "links"])

    return run(html)


def absolute_url(href: str, base: str) -> str | None:
    """The link resolved against its page, without fragment; null unless http or https."""
    try:
        url = urldefrag(urljoin(base, href.strip())).url
        parts = urlsplit(url)
        return (url if parts.path else url + "/") if parts.scheme in ("http", "https") and parts.hostname else None
    except ValueError:
        return None


def absolute(hrefs: Column, base: Column) -> Column:
    """An array of links resolved against their page, null ones dropped."""

    @F.pandas_udf(ArrayType(StringType()))
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for links, bases in batches:
            yield pd.Series([[u for h in (ls if ls is not None else []) if (u := absolute_url(h, b or ""))] for ls, b in zip(links, bases, strict=True)])

    return run(hrefs, base)


def fetched(pages: DataFrame, get: Callable[[str], tuple[int, str, bytes]], kinds: tuple[str, ...] = ("text/html", "application/xhtml")) -> DataFrame:
    """pages (url, ...) with ok, is_html and html. get(url) gives status, content type and body, and raises on time-out;
    an error or a status of 400 and more is not ok, another content type is not HTML. One narrow pass."""
    schema = StructType([*pages.schema.fields, StructField("ok", BooleanType()), StructField("is_html", BooleanType()), StructField("html", StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            rows = []
            for url in frame["url"]:
                try:
                    status, kind, body = get(url)
                    ok, html = status < 400, kind.lower().startswith(kinds)
                    rows.append((ok, html, body.decode("utf-8", "replace") if ok and html else None))
                except Exception:  # whatever the site or the network does is a failed page, to be tried again
                    rows.append((False, False, None))
            yield frame.assign(**{n: [r[i] for r in rows] for i, n in enumerate(("ok", "is_html", "html"))})

    return pages.mapInPandas(run, schema)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)", 1))


def bare_host(host: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(host)), r"\.$", ""), r":[0-9]+$", "")


def host_allowed(host: Column, allowed: Column) -> Column:
    """The allowed host itself or a real subdomain; empty ones never."""
    h, a = bare_host(host), bare_host(allowed)
    return F.coalesce((h != "") & (a != "") & ((h == a) | F.endswith(h, F.concat(F.lit("."), a))), F.lit(False))


def robots_rules(files: DataFrame, agent: str) -> DataFrame:
    """(host, allow, path) of robots.txt files (host, body) that hold for an agent: its own groups, and * groups that none
    of its own precedes.

    The file is folded line by line, as groups depend on order; rows are the rules.
    """
    line = F.transform(F.split("body", r"\r?\n"), lambda l: F.trim(F.split_part(l, F.lit("#"), F.lit(1))))  # noqa: E731, E741
    pairs = F.transform(F.filter(line, lambda l: l != ""), lambda l: F.struct(F.lower(F.trim(F.split_part(l, F.lit(":"), F.lit(1)))).alias("k"), F.trim(F.regexp_replace(l, "^[^:]*:?", "")).alias("v")))  # noqa: E741
    start = F.struct(F.lit(False).alias("on"), F.lit(False).alias("own"), F.array().cast("array<struct<allow:boolean,path:string>>").alias("rules"))

    def step(s: Column, x: Column) -> Column:
        ua = F.lower(x["v"])
        own = (ua != "*") & F.contains(F.lit(agent.lower()), ua)
        names = x["k"] == "user-agent"
        on = F.when(names, own | ((ua == "*") & ~s["own"])).otherwise(s["on"])
        rule = s["on"] & x["k"].isin("allow", "disallow") & (x["v"] != "")
        rules = F.when(rule, F.concat(s["rules"], F.array(F.struct((x["k"] == "allow").alias("allow"), x["v"].alias("path"))))).otherwise(s["rules"])
        return F.struct(on.alias("on"), (s["own"] | (names & own)).alias("own"), rules.alias("rules"))

    return files.select("host", F.explode(F.aggregate(pairs, start, step, lambda s: s["rules"])).alias("r")).select("host", "r.allow", "r.path")


def robots_allowed(urls: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """urls with `allowed`: the longest rule whose path starts the url's decides, an equally long allow before a disallow.

    Rules meet urls on their host; only those that fit reach the aggregation, which is per url and partial.
    """
    path = F.regexp_replace(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^#]*)", 1), "^$", "/")
    each = urls.select(url).distinct().withColumns({"__host": host_of(F.col(url)), "__path": path})
    r = rules.select(F.col("host").alias("__rh"), "allow", F.col("path").alias("__rp"))
    hits = each.join(r, (F.col("__host") == F.col("__rh")) & F.startswith(F.col("__path"), F.col("__rp")))
    best = hits.groupBy(F.col(url).alias("__url")).agg(F.max_by("allow", F.struct(F.length("__rp"), F.col("allow"))).alias("__ok"))
    return urls.join(best, F.col(url) == F.col("__url"), "left").withColumn("allowed", F.coalesce("__ok", F.lit(True))).drop("__url", "__ok")


def requeue_stale(frontier: DataFrame, as_of: Column, per_source: int = 3, age: str = "24 hours") -> DataFrame:
    """The frontier with the oldest `per_source` done pages of each source that are older than `age` pending again."""
    stale = frontier.filter((F.col("status") == "done") & (F.col("last_crawled_at") < as_of - F.expr(f"INTERVAL {age}")))
    head = stale.withColumn("__rn", F.row_number().over(Window.partitionBy("source_id").orderBy(F.asc_nulls_last("last_crawled_at"), "url"))).filter(F.col("__rn") <= per_source)
    again = head.select(F.col("url").alias("__url"))
    return frontier.join(again, F.col("url") == F.col("__url"), "left").withColumn("status", F.when(F.col("__url").isNotNull(), F.lit("pending")).otherwise(F.col("status"))).drop("__url")


def take_pending(frontier: DataFrame, limit: int = 15) -> DataFrame:
    """The next pages: sources in order of their id, each by time of discovery, `limit` in all."""
    return frontier.filter("status = 'pending'").orderBy("source_id", F.asc_nulls_last("discovered_at"), "url").limit(limit)


def discovered(pages: DataFrame, frontier: DataFrame, sources: DataFrame, per_page: int = 40) -> DataFrame:
    """(url, source_id) of new links: the first `per_page` of each page, on the source's host, not in the frontier yet.

    pages: source_id, links (absolute). sources: source_id, allowed_host (a registry; the optimizer broadcasts it if it is small).
    """
    links = pages.select("source_id", F.explode(F.slice("links", 1, per_page)).alias("url"))
    kept = links.join(sources.select("source_id", "allowed_host"), "source_id").filter(host_allowed(host_of(F.col("url")), F.col("allowed_host")))
    return kept.groupBy("url").agg(F.min("source_id").alias("source_id")).join(frontier.select("url"), "url", "left_anti")


def outcome(pages: DataFrame, least: int = 200) -> DataFrame:
    """Fetched pages (url, ok, is_html, allowed, text, old_hash, attempts) with hash, result, status and attempts after them.

    A short text or an unchanged hash counts as unchanged and done; a failure is retried until the third.
    """
    new = content_hash(F.coalesce("text", F.lit("")))
    failed = ~F.coalesce("ok", F.lit(False))
    result = F.when(~F.col("allowed"), "skipped").when(failed, "failed").when(~F.col("is_html"), "skipped").when((F.length("text") < least) | (new == F.col("old_hash")), "unchanged").otherwise("updated")
    status = F.when(F.col("result") == "skipped", "skipped").when(F.col("result") == "failed", F.when(F.col("attempts") + 1 >= 3, "failed").otherwise("pending")).otherwise("done")
    found = pages.withColumn("result", result)
    return found.withColumns({"hash": F.when(F.col("result").isin("unchanged", "updated"), new).otherwise(F.col("old_hash")), "status": status, "attempts": F.when(F.col("result") == "failed", F.col("attempts") + 1).otherwise(F.col("attempts"))})


def tick_counts(results: DataFrame, new_links: int = 0) -> DataFrame:
    of = lambda r: F.count_if(F.col("result") == r)
    return results.agg(F.count(F.lit(1)).alias("processed"), *(of(r).alias(r) for r in ("updated", "unchanged", "skipped", "failed"))).withColumn("newly_discovered", F.lit(new_links))


def page_chunks(pages: DataFrame, size: int = 1100, overlap: int = 150) -> DataFrame:
    """Chunks of changed pages: id from the url's hash and the place, with place and content."""
    each = pages.select("url", F.posexplode(sliding_chunks(F.col("text"), size, overlap)).alias("place", "content"))
    return each.withColumn("id", F.concat(F.lit("page-"), short_hash(F.col("url")), F.lit("-"), F.col("place").cast("string")))


def status_counts(frontier: DataFrame) -> DataFrame:
    return frontier.groupBy("source_id", "status").agg(F.count(F.lit(1)).alias("n"))

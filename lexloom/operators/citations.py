"""Verifying the citations of answers against what was retrieved, and evaluating both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions.authority import authority
from lexloom.functions.references import cited_numbers, quote, supports
from lexloom.functions.text import is_official_url, latin_digits, text

BINDING = ["binding", "binding_if_valid", "binding_on_courts"]
OTHER_FORCE = ["advisory", "persuasive", "doctrine"]


def verify(answers: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Every citation of every answer with whether one of the question's retrieved rows supports it.

    answers: question_id, answer. retrieved: question_id, article_number, source_title, content. The join is on the
    question, so an answer meets its own few rows.
    """
    cites = answers.select("question_id", F.posexplode(cited_numbers(F.col("answer"))).alias("place", "cite"))
    rows = retrieved.select("question_id", F.struct("article_number", "source_title", "content").alias("row"))
    backed = supports(F.col("cite"), F.col("row.article_number"), F.col("row.source_title"), F.col("row.content"))
    found = cites.join(rows, "question_id", "left").groupBy("question_id", "place", "cite").agg(F.max(F.coalesce(backed, F.lit(False))).alias("verified"))
    return found.select("question_id", "place", F.col("cite.raw").alias("raw"), F.col("cite.number").alias("number"), F.col("cite.kind").alias("kind"), "verified")


def evaluate_answers(verified: DataFrame) -> DataFrame:
    """Per question: cited, verified, unverified."""
    return verified.groupBy("question_id").agg(F.count(F.lit(1)).alias("cited"), F.count_if("verified").alias("verified"), F.count_if(~F.col("verified")).alias("unverified"))


def evaluate_retrieval(ranked: DataFrame) -> DataFrame:
    """Per question: how many rows, of which kind of match and of which binding force."""
    force = authority(F.col("source_type"), F.col("source_title"))["binding"]
    kind = lambda k: F.count_if(F.col("match_kind") == k)
    return ranked.withColumn("__force", force).groupBy("question_id").agg(
        F.count(F.lit(1)).alias("retrieved"), kind("exact_article").alias("exact_article_hits"), kind("fts").alias("fts_hits"), kind("vector").alias("vector_hits"),
        F.count_if(F.col("__force").isin(BINDING)).alias("binding_sources"), F.count_if(F.col("__force").isin(OTHER_FORCE)).alias("advisory_sources"),
    )


def public_citations(ranked: DataFrame, verified: DataFrame) -> DataFrame:
    """What users see of retrieved rows: no address that is not http, a quote, the binding force, and whether the row's
    article number is not among the unverified ones (a row that is not cited counts as verified)."""
    missing = verified.filter(~F.col("verified")).groupBy("question_id").agg(F.collect_set("number").alias("__missing"))
    art = latin_digits(text("article_number"))
    none = F.coalesce(F.col("__missing"), F.array().cast("array<string>"))
    force = authority(F.col("source_type"), F.col("source_title"))
    return ranked.join(missing, "question_id", "left").select(
        "question_id", "id", "source_type", "source_title", "article_number", F.when(is_official_url(F.col("source_url")), F.col("source_url")).alias("source_url"),
        force["binding"].alias("binding"), quote(F.col("content"), F.col("article_number")).alias("quote"), "match_kind",
        F.when(art != "", ~F.array_contains(none, art)).otherwise(F.size(none) == 0).alias("verified"),
    )


def audit_rows(ranked: DataFrame, verified: DataFrame, as_of: Column) -> DataFrame:
    """One row per question for the audit log: retrieved ids, match kinds with scores to four places, citations."""
    lists = ranked.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id", F.col("match_kind").alias("kind"), F.round("score", 4).alias("score")))).alias("__rows"))
    cites = verified.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("place", "raw", "number", "kind", "verified"))).alias("__cites"))
    pick = lambda keep: F.transform(F.filter(F.coalesce("__cites", F.array()), keep), lambda c: F.struct(c["raw"], c["number"], c["kind"]))
    joined = lists.join(cites, "question_id", "left").withColumn("__cites", F.coalesce("__cites", F.array().cast("array<struct<place:int,raw:string,number:string,kind:string,verified:boolean>>")))
    return joined.select("question_id", F.transform("__rows", lambda r: r["id"]).alias("retrieved_ids"), F.transform("__rows", lambda r: F.struct(r["id"], r["kind"], r["score"])).alias("match_kinds"), pick(lambda c: c["verified"]).alias("cited"), pick(lambda c: ~c["verified"]).alias("unverified"), as_of.alias("created_at"))


def source_lines(ranked: DataFrame, longest: int = 1200) -> DataFrame:
    """The numbered sources of a prompt, one text per question."""
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), text("source_title"), F.when(text("article_number") != "", F.concat(F.lit(" — "), text("article_number"))).otherwise(F.lit("")), F.lit("\n"), quote(F.col("content"), F.col("article_number"), longest))
    return ranked.groupBy("question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda s: s["line"]), "\n\n").alias("sources"))


def prompt(system: Column, question: Column, sources: Column, matter: Column | None = None) -> Column:
    """System rules, question, sources and, if there is one, the matter's excerpt as one text."""
    return F.concat_ws("\n\n", *(c for c in (system, question, sources, matter) if c is not None))

"""The application's entry points as functions over batches of requests."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions.text import fill_template, text
from lexloom.operators import citations, classify, retrieval, stats
from lexloom.session import materialize

#: Bounds of what users send.
QUESTION_LENGTH, STORY_LENGTH = (4, 2000), (8, 8000)
SOURCE_TYPES = ("all", "statute", "advisory_opinion", "case_law", "convention", "terminology")


def validate(question: Column, bounds: tuple[int, int] = QUESTION_LENGTH) -> Column:
    """The trimmed text; one out of bounds fails."""
    q = F.trim(text(question))
    return F.when(F.length(q).between(*bounds), q).otherwise(F.raise_error(F.lit(f"text must have {bounds[0]} to {bounds[1]} characters")))


@dataclass
class Answers:
    sources: DataFrame
    answers: DataFrame
    citations: DataFrame
    evaluation: DataFrame
    audit: DataFrame


def fallback_answer(ranked: DataFrame) -> DataFrame:
    """An answer without a model: the numbered sources."""
    return citations.source_lines(ranked, 420).withColumnRenamed("sources", "answer")


def ask(questions: DataFrame, chunks: DataFrame, as_of: Column, generate: Callable[[DataFrame], DataFrame] | None = None, source_type: str = "all", limit: int = retrieval.TOP) -> Answers:
    """Grounded answers for a batch: questions (question_id, question, optional vector) over chunks.

    generate: from the ranked rows to (question_id, answer); without it the fallback answers. The ranking, a few rows a
    question, is written once; all parts read it.
    """
    if source_type not in SOURCE_TYPES:
        raise ValueError(f"unknown source type {source_type}")
    ranked = materialize(retrieval.retrieve(questions, retrieval.optional_equal(chunks, "source_type", source_type), limit))
    answers = (generate or fallback_answer)(ranked)
    verified = citations.verify(answers, ranked)
    evaluation = citations.evaluate_retrieval(ranked).join(citations.evaluate_answers(verified), "question_id", "left").na.fill(0)
    return Answers(ranked, answers, citations.public_citations(ranked, verified), evaluation, citations.audit_rows(ranked, verified, as_of))


def draft(stories: DataFrame, forms: DataFrame, keywords: DataFrame, boosts: DataFrame, answers: str = "answers") -> DataFrame:
    """Stories (story_id, story, form_id, has_judgment, answers map) with their class and the filled template of its form;
    a refused topic gets none."""
    told = classify.classify(stories, forms, keywords, boosts)
    joined = told.join(stories.select("story_id", answers), "story_id").join(forms.select("form_id", "template"), "form_id", "left")
    return joined.withColumn("draft", F.when(~F.col("refused"), fill_template(F.col("template"), F.col(answers)))).drop("template", answers)


def draft_query(title: Column, articles: Column, story: Column, longest: int = 400) -> Column:
    """The retrieval question of a draft."""
    return F.concat_ws(" — ", title, F.array_join(articles, " "), F.substring(story, 1, longest))


def residency_search(phrases: DataFrame, documents: DataFrame, jurisdiction: str | None = None, country_given: bool = False, country: str | None = None, each: int = 8, limit: int = 10) -> DataFrame:
    """Nearest documents of several rewritten phrases (request_id, phrase_id, vector) of each request, merged by document."""
    rows = retrieval.tri_state(retrieval.optional_equal(documents, "jurisdiction", jurisdiction), "country", country_given, country)
    asked = phrases.select(F.struct("request_id", "phrase_id").alias("question_id"), "vector")
    near = retrieval.nearest_by_cosine(asked, rows, each)
    return retrieval.merge_by_distance(near.select(F.col("question_id.request_id").alias("request_id"), "id", (1 - F.col("semantic")).alias("distance")), "request_id", "id", limit)


def corpus_stats(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    return stats.totals(chunks), stats.by_type(chunks)

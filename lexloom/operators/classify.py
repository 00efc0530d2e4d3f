"""Classifying a narrative to a form by tables of keywords and weighted patterns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from lexloom.functions import fixed as V
from lexloom.functions.text import contains_any, let, normalize, normalize_letters, text
from lexloom.session import broadcast_if_small

#: Rule tables are short lists that people write; beyond this they are not broadcast.
MAX_RULES = 20_000


def _rules(rules: DataFrame) -> DataFrame:
    return broadcast_if_small(rules, MAX_RULES)


def required(pattern: str) -> list[str] | None:
    """Strings of two characters or more of which every match of a pattern holds one; None where that cannot be told.

    Only alternatives without groups, classes and escapes are read to the end, others up to the first of these.
    """
    if "(" in pattern and "|" in pattern:
        return None
    found = []
    for alternative in pattern.split("|"):
        runs, run, i = [], "", 0
        while i < len(alternative) and alternative[i] not in "([\\{":
            c, behind = alternative[i], alternative[i + 1 : i + 2]
            if c in ".^$*+?":
                runs.append(run)
                run = ""
            elif behind in ("?", "*", "{"):  # may be missing
                runs.append(run)
                run = ""
            else:
                run += c
            i += 1
        best = max([*runs, run], key=len)
        if len(best) < 2:
            return None
        found.append(best)
    return found


def _found(literals: dict[str, list[int]], always: list[int]) -> Callable:
    """(story_id, __s, rules) of stories (story_id, __s): the rules whose literals a story holds, in one pass over its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        known = ahocorasick.Automaton()
        for literal, rules in literals.items():
            known.add_word(literal, rules)
        if literals:
            known.make_automaton()
        for batch in batches:
            hits = [sorted({r for _, rules in known.iter(s) for r in rules} | set(always)) if literals else always for s in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hits, pa.list_(pa.int32()))], ["story_id", "__s", "rules"])

    return run


def scores(stories: DataFrame, keywords: DataFrame, boosts: DataFrame) -> DataFrame:
    """(story_id, form_id, score): keyword hits weigh min(4, max(1, length / 4)), pattern hits their weight.

    stories: story_id, story. keywords: form_id, keyword. boosts: form_id, pattern, weight. The keywords and a string that
    each pattern requires become one automaton, which every task runs once over its texts, however many rules there are;
    patterns are then matched where their string was found. Rule tables beyond MAX_RULES are joined instead.
    """
    told = stories.select("story_id", normalize_letters(text("story")).alias("__s") if "__s" not in stories.columns else "__s")
    words = keywords.select("form_id", normalize_letters(F.col("keyword")).alias("k")).filter(F.length("k") >= 2)
    weight = F.least(F.lit(4), F.greatest(F.lit(1), F.floor(F.length("k") / 4))).cast("int")
    rules = words.select("form_id", "k", F.lit(None).cast("string").alias("pattern"), weight.alias("w")).unionByName(boosts.filter("pattern is not null").select("form_id", F.lit(None).cast("string").alias("k"), "pattern", F.col("weight").cast("int").alias("w")))
    few = rules.limit(MAX_RULES + 1).collect()
    if len(few) > MAX_RULES:
        hits = told.join(words, F.contains("__s", F.col("k"))).select("story_id", "form_id", weight.alias("w"))
        more = told.join(boosts, F.regexp_like("__s", F.col("pattern"))).select("story_id", "form_id", F.col("weight").cast("int").alias("w"))
        return hits.unionByName(more).groupBy("story_id", "form_id").agg(F.sum("w").alias("score"))
    literals: dict[str, list[int]] = {}
    always = []
    for i, rule in enumerate(few):
        needed = [rule["k"]] if rule["k"] is not None else required(rule["pattern"])
        if needed is None:
            always.append(i)
        for literal in set(needed or ()):
            literals.setdefault(literal, []).append(i)
    schema = StructType([told.schema["story_id"], told.schema["__s"], StructField("rules", ArrayType(IntegerType()))])
    table = told.sparkSession.createDataFrame([(i, r["form_id"], r["pattern"], r["w"]) for i, r in enumerate(few)], "rule int, form_id string, pattern string, w int")
    each = told.mapInArrow(_found(literals, always), schema).select("story_id", "__s", F.explode("rules").alias("rule")).join(F.broadcast(table), "rule")
    matched = each.filter(F.col("pattern").isNull() | F.regexp_like("__s", F.col("pattern")))
    return matched.groupBy("story_id", "form_id").agg(F.sum("w").alias("score"))


def top_forms(scored: DataFrame, forms: DataFrame, n: int = 4) -> DataFrame:
    """Each story's best n forms, ties in the order of the forms table (column place)."""
    placed = scored.join(_rules(forms.select("form_id", "place")), "form_id")
    return placed.withColumn("rank", F.row_number().over(Window.partitionBy("story_id").orderBy(F.desc("score"), "place"))).filter(F.col("rank") <= n).drop("place")


def is_refused(story: Column) -> Column:
    return let(normalize(text(story)), lambda s: contains_any(s, V.REFUSED_STEMS) & s.rlike(V.REFUSED))


def classify(stories: DataFrame, forms: DataFrame, keywords: DataFrame, boosts: DataFrame, fallback: str = "claim-money", criminal_fallback: str = "fraud-complaint") -> DataFrame:
    """story_id, form_id, confidence, refused, has_judgment, alternatives.

    stories: story_id, story, form_id (chosen by the user, may be null), has_judgment. In turn: a refused topic gives the
    fallback without confidence; a known chosen form is taken; after a judgment a form for that stage leads; without any
    hit the fallback of the likelier track is taken; else the best form, with high confidence from a score of 6.
    """
    stories = stories.withColumn("__s", normalize_letters(text("story")))
    s = F.col("__s")
    told = stories.withColumns({"__judged": F.coalesce("has_judgment", F.lit(False)) | contains_any(s, V.JUDGMENT), "__refused": is_refused(F.col("story")), "__crime": contains_any(s, V.CRIMINAL_HINT)})
    criminal = contains_any(s, V.CRIMINAL_AFTER_JUDGMENT)
    forced = F.when(contains_any(s, V.BARRED), "bar-prosecution").when(contains_any(s, V.BY_DEFAULT), F.when(criminal, "criminal-default").otherwise("objection-default")).otherwise(F.when(criminal, "criminal-appeal").otherwise("civil-appeal"))
    ranked = top_forms(scores(stories, keywords, boosts), forms, 5).groupBy("story_id").agg(F.array_sort(F.collect_list(F.struct("rank", "form_id", "score"))).alias("__ranked"))
    known = _rules(forms.select(F.col("form_id").alias("__known")))
    joined = told.withColumn("__forced", forced).join(ranked, "story_id", "left").join(known, F.col("form_id") == F.col("__known"), "left")
    best = F.try_element_at("__ranked", F.lit(1))
    force = F.col("__judged") & (best.isNull() | ~best["form_id"].isin(V.POST_JUDGMENT_FORMS))
    chosen = F.col("__known").isNotNull()
    form = F.when(F.col("__refused"), fallback).when(chosen, F.col("form_id")).when(force, F.col("__forced")).when(best.isNull(), F.when(F.col("__crime"), criminal_fallback).otherwise(fallback)).otherwise(best["form_id"])
    confidence = F.when(F.col("__refused"), "none").when(chosen | force, "high").when(best.isNull(), "medium").when(best["score"] >= 6, "high").otherwise("medium")
    others = F.slice(F.filter(F.transform(F.coalesce("__ranked", F.array().cast("array<struct<rank:int,form_id:string,score:bigint>>")), lambda r: r["form_id"]), lambda x: x != form), 1, 3)
    alternatives = F.when(F.col("__refused") | chosen | (best.isNull() & ~force), F.array().cast("array<string>")).otherwise(others)
    return joined.select("story_id", form.alias("form_id"), confidence.alias("confidence"), F.col("__refused").alias("refused"), F.col("__judged").alias("has_judgment"), alternatives.alias("alternatives"))


def procedure(classified: DataFrame, forms: DataFrame, steps: DataFrame) -> DataFrame:
    """Each story's steps: those of the first rule in `steps` (place, track, form_id, has_judgment; null fits all) that fits."""
    tracked = classified.join(_rules(forms.select("form_id", "track")), "form_id", "left")
    rules = _rules(steps.select("place", F.col("track").alias("__t"), F.col("form_id").alias("__f"), F.col("has_judgment").alias("__j"), "steps"))
    fits = lambda c, v: F.col(c).isNull() | (F.col(c) == F.col(v))
    found = tracked.join(rules, fits("__t", "track") & fits("__f", "form_id") & fits("__j", "has_judgment"), "left")
    return found.groupBy("story_id", tracked["form_id"]).agg(F.min_by("steps", "place").alias("steps"))

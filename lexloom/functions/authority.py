"""Binding force of a source."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexloom.functions import fixed as V
from lexloom.functions.text import text


def authority(source_type: Column, title: Column) -> Column:
    """struct<branch, binding, rank> of a source: by type, and by title where that decides."""
    t = F.translate(text(title), "يك", "یک")
    statute = source_type == "statute"
    unified = reduce(lambda a, b: a | b, (F.contains(t, F.lit(x)) for x in V.UNIFIED_RULING_TITLES))
    of = lambda name: F.struct(F.lit(name).alias("branch"), F.lit(V.AUTHORITY[name][0]).alias("binding"), F.lit(V.AUTHORITY[name][1]).alias("rank"))
    return (
        F.when(statute & F.contains(t, F.lit(V.CONSTITUTION)), of("constitution"))
        .when(source_type == "convention", of("convention"))
        .when(statute & t.rlike(V.REGULATION_PATTERN), of("regulation"))
        .when(statute, of("statute"))
        .when(source_type == "advisory_opinion", of("advisory_opinion"))
        .when(source_type == "terminology", of("terminology"))
        .when(unified, of("unified_ruling"))
        .when(source_type == "case_law", of("case_law"))
        .otherwise(of("other"))
    )


def authority_weight(source_type: Column, title: Column) -> Column:
    return authority(source_type, title)["rank"] / 100


# Kinds of sources as users see them.
SOURCE_LABELS = {"statute": "قانون", "advisory_opinion": "نظریه مشورتی", "case_law": "رویه قضایی", "convention": "معاهده", "terminology": "اصطلاح‌نامه"}


def source_label(source_type: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in SOURCE_LABELS.items() for x in pair))
    return F.coalesce(F.try_element_at(table, source_type), source_type)

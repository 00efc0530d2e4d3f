"""Repair of lam-alef, which text layers of scans give back in the wrong order, by a lexicon."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.session import broadcast_if_small, materialize

#: How the ligature comes out of a broken text layer, and how it is written.
BROKEN, WHOLE = "ال", "لا"
#: Borders between runs of letters and what stands between them; splitting there loses nothing.
BORDER = r"(?<=\p{L})(?=\P{L})|(?<=\P{L})(?=\p{L})"
#: How many letters of a word have their readings written out (12 hold six pairs, so 64 at most); the rest is compared.
HEAD = 12
#: Rows and bytes up to which the fixes are broadcast.
BROADCAST_FIXES = 200_000


def fixes(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(word, fixed): doubtful words, and what is written for them, or null.

    words: a column word, repeats allowed. lexicon: word and n, how often it was seen. Doubtful is a word that holds the
    broken pair and is not in the lexicon. Of the readings with any of its pairs turned, the one that the lexicon has is
    taken; of several the most frequent. Readings that are equally frequent leave the word as it is: nothing is guessed.
    """
    known = lexicon.filter("word is not null").groupBy("word").agg(F.sum("n").alias("n"))
    doubtful = words.filter(F.contains("word", F.lit(BROKEN))).select("word").distinct().join(known, "word", "left_anti")
    readings = doubtful.select("word", F.explode(_readings(F.split(F.left("word", F.lit(HEAD)), BROKEN))).alias("head"))
    keyed = readings.select("word", _key(F.concat("head", F.expr(f"substring(word, {HEAD + 1})"))).alias("__key"))
    read = known.filter(F.contains("word", F.lit(WHOLE))).select(F.col("word").alias("reading"), "n", _key(F.col("word")).alias("__key"))
    found = keyed.join(read, "__key").filter(_only_pairs_turned(F.col("word"), F.col("reading")))
    best = found.groupBy("word").agg(F.max_by("reading", F.struct("n", "reading")).alias("__last"), F.min_by("reading", F.struct(-F.col("n"), F.col("reading"))).alias("__first"))
    return doubtful.join(best.select("word", F.when(F.col("__first") == F.col("__last"), F.col("__first")).alias("fixed")), "word", "left")


def _readings(parts: Column) -> Column:
    """All strings that the parts make, each joint written either way."""
    joint = lambda acc, part: F.flatten(F.transform(acc, lambda s: F.array(F.concat(s, F.lit(BROKEN), part), F.concat(s, F.lit(WHOLE), part))))
    return F.aggregate(F.slice(parts, 2, F.size(parts)), F.array(F.element_at(parts, 1)), joint)


def _key(word: Column) -> Column:
    """The word, with lam and alef told apart in its head alone: a pair that is turned anywhere after it keeps the key.

    The head's last letter may be half of a pair that goes on after it, so it is not told apart either.
    """
    return F.concat(F.left(word, F.lit(HEAD - 1)), F.translate(F.substring(word, HEAD, 2**31 - 1), BROKEN[1], BROKEN[0]))


def _only_pairs_turned(word: Column, reading: Column) -> Column:
    """Whether a reading of the same key differs from the word in turned pairs alone, wherever and however many."""
    differing = F.zip_with(F.split(word, ""), F.split(reading, ""), lambda a, b: F.when(a == b, "=").otherwise(a))
    return F.translate(F.replace(F.array_join(differing, ""), F.lit(BROKEN), F.lit("")), "=", "") == ""


def repaired(documents: DataFrame, lexicon: DataFrame, content: str) -> DataFrame:
    """documents with `content` repaired, and how many words were `repaired` and how many stayed `doubtful`.

    The repair depends on the text alone, so each different text is repaired once; texts without the pair (null and empty
    ones too) pass by with zeros. Only what lies between a text's borders is moved, so the rest of it stays as it is.
    """
    key = F.sha2(F.col(content), 256)
    texts = documents.filter(F.contains(content, F.lit(BROKEN))).select(key.alias("__key"), F.col(content).alias("__text")).dropDuplicates(["__key"])
    pieces = texts.select("__key", F.posexplode(F.split("__text", BORDER)).alias("__i", "word"))
    told = broadcast_if_small(materialize(fixes(pieces, lexicon).withColumn("__doubtful", F.lit(1))), BROADCAST_FIXES)  # counted and joined: made once
    joined = pieces.join(told, "word", "left").select("__key", F.struct("__i", F.coalesce("fixed", "word").alias("s")).alias("__piece"), "fixed", "__doubtful")
    whole = joined.groupBy("__key").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("__piece")), lambda p: p["s"]), "").alias("__fixed"),
        F.count("fixed").alias("repaired"), (F.count("__doubtful") - F.count("fixed")).alias("doubtful"),
    )
    back = documents.withColumn("__key", key).join(whole, "__key", "left")
    return back.select(*(F.coalesce("__fixed", F.col(content)).alias(content) if c == content else F.col(f"`{c}`") for c in documents.columns), F.coalesce("repaired", F.lit(0)).alias("repaired"), F.coalesce("doubtful", F.lit(0)).alias("doubtful"))

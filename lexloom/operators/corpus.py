"""Building a corpus: gates with reasons, duplicates, caps, interleaving, sampling, admission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions import fixed as V
from lexloom.functions.text import ratio_of, signature, source_name, text, trigrams
from lexloom.session import materialize

def first_failing(gates: list[tuple[str, Column]]) -> Column:
    """The name of the first gate that a row fails, else null. A gate's condition is true for rows that fail."""
    chain = F.lit(None).cast("string")
    for name, fails in reversed(gates):
        chain = F.when(F.coalesce(fails, F.lit(False)), F.lit(name)).otherwise(chain)
    return chain


def histogram(rows: DataFrame, reason: str = "reason") -> DataFrame:
    """Rows per reason; the sum over all is the number of rows put in."""
    return rows.groupBy(F.coalesce(reason, F.lit("selected")).alias(reason)).agg(F.count(F.lit(1)).alias("n"))


def size_gate(words: Column, length: Column, words_between: tuple[int, int] = (80, 900), length_between: tuple[int, int] = (200, 4000)) -> list[tuple[str, Column]]:
    return [("word_count", ~words.between(*words_between)), ("length", ~length.between(*length_between))]


def is_spam(c: Column, pattern: str | None = None, repeated: str = "w w", times: int = 8, letters: int = 80, letter_class: str = r"[؀-ۿ]") -> Column:
    """Text that matches a pattern, repeats a junk string, or has too few letters of the script."""
    found = (F.regexp_count(c, F.lit(repeated)) >= times) | (F.regexp_count(c, F.lit(letter_class)) < letters)
    return found | c.rlike(pattern) if pattern else found


def is_foreign(c: Column, share: float = 0.35, letter_class: str = r"[؀-ۿ]") -> Column:
    return ratio_of(c, letter_class) < share


def is_junk(c: Column, banner: str | None = None, least: int = 280, banner_least: int = 600) -> Column:
    """Text that is too short, or a download banner that is not long either."""
    short = F.length(c) < least
    return short | (c.rlike(banner) & (F.length(c) < banner_least)) if banner else short


def is_unusable_article(content: Column, section: Column, title: Column, code: Column, longest: int = 6000) -> Column:
    """A constitution's preamble, a title marked as old, a body without article or principle, or one too long."""
    preamble = F.contains(text(section), F.lit("مقدمه")) & (code == "قانون " + V.CONSTITUTION)
    return preamble | F.contains(text(title), F.lit("قدیم")) | ~text(content).rlike(rf"({V.ARTICLE}|{V.PRINCIPLE})\s") | (F.length(content) > longest)


def numbered(rows: DataFrame, order: list[Column], name: str = "seq") -> DataFrame:
    """A sequence column where none came with the rows: their rank in `order` by range partitions, not in one task.

    Rows are range-partitioned by `order`; a partition's number leads and the rank within it follows.
    """
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return dealt.withColumn(name, F.monotonically_increasing_id())


def longest_per_key(rows: DataFrame, key: str, content: str, seq: str, later_wins: bool = True) -> DataFrame:
    """One row per key: the longest content; of equals the later one (or the earlier). Null keys are dropped.

    max_by aggregates partially, so a key with very many rows costs one row per task.
    """
    place = F.col(seq) if later_wins else -F.col(seq)
    best = F.max_by(F.struct(*rows.columns), F.struct(F.length(text(content)), place))
    return rows.filter(F.col(key).isNotNull() & (F.col(key) != "")).groupBy(key).agg(best.alias("__row")).select("__row.*")


def first_per_key(rows: DataFrame, key: Column, seq: str) -> DataFrame:
    """The first row of each key, by partial aggregation."""
    return rows.withColumn("__key", key).groupBy("__key").agg(F.min_by(F.struct(*rows.columns), seq).alias("__row")).select("__row.*")


def first_per_signature(rows: DataFrame, content: str, seq: str, longest: int = 180) -> DataFrame:
    return first_per_key(rows, signature(F.col(content), longest), seq)


def best_per_key(rows: DataFrame, key: list[str], value: Column, seq: str) -> DataFrame:
    """The row with the largest value per key; of equals the first."""
    best = F.max_by(F.struct(*rows.columns), F.struct(value, -F.col(seq)))
    return rows.groupBy(*key).agg(best.alias("__row")).select("__row.*")


def without_existing(rows: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not there yet."""
    return rows.join(existing.select(key).distinct(), key, "left_anti")


def without_known_signatures(rows: DataFrame, existing: DataFrame, content: str, longest: int = 180) -> DataFrame:
    known = existing.select(signature(F.col(content), longest).alias("__sig")).distinct()
    return rows.withColumn("__sig", signature(F.col(content), longest)).join(known, "__sig", "left_anti").drop("__sig")


def cap(rows: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group (a window group limit, so a hot group sends n rows a task)."""
    return rows.withColumn("__rn", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("__rn") <= n).drop("__rn")


def interleave(rows: DataFrame, group: str, seq: str, limit: int) -> DataFrame:
    """Rows in turn from all groups, groups in order of their first row: `place` from 1, `limit` rows at most."""
    within = F.row_number().over(Window.partitionBy(group).orderBy(seq))
    first = rows.groupBy(group).agg(F.min(seq).alias("__first"))
    dealt = rows.withColumn("__rn", within).filter(F.col("__rn") <= limit).join(first, group).orderBy("__rn", "__first").limit(limit)
    return dealt.withColumn("place", F.row_number().over(Window.orderBy("__rn", "__first")).cast("int")).drop("__rn", "__first")


def systematic_sample(rows: DataFrame, section: str, seq: str, quota: int) -> DataFrame:
    """Evenly spaced rows of each section: quota / number of sections, 1 at least. A row's place in its section comes from
    running counts over ranges, so a section that holds most rows is many tasks' work."""
    sections = rows.groupBy(section).agg(F.count(F.lit(1)).alias("__n"))
    shares = sections.crossJoin(F.broadcast(sections.agg(F.greatest(F.lit(1), F.floor(F.lit(quota) / F.count(F.lit(1)))).alias("__want"))))
    placed = running_before(rows, [F.col(seq)], F.lit(1), "__i", section).join(shares, section)
    want = F.least("__n", "__want")
    # row i is taken if some k has floor(k * n / want) = i
    k = F.ceil(F.col("__i") * want / F.col("__n"))
    taken = (F.col("__n") <= F.col("__want")) | ((k < want) & (F.floor(k * F.col("__n") / want) == F.col("__i")))
    return placed.filter(taken).drop("__i", "__n", "__want")


def with_pins(sample: DataFrame, pool: DataFrame, pinned: Column, key: Column) -> DataFrame:
    """The sample and, in front, the pool's pinned rows that it lacks."""
    have = sample.select(key.alias("__key")).distinct()
    pins = pool.filter(pinned).withColumn("__key", key).join(have, "__key", "left_anti").drop("__key")
    return pins.withColumn("pinned", F.lit(True)).unionByName(sample.withColumn("pinned", F.lit(False)))


def first_and_last(rows: DataFrame, document: str, order: str, ruling: Column, n: int = 6, ruling_n: int = 3) -> DataFrame:
    """A document's first n chunks; a ruling's first one and its last ruling_n - 1, or all if there are ruling_n at most.

    Window group limits from either end pass on a few chunks a document and task, so a document of very many chunks is no
    task's whole. Ties in `order` fall by the row's hash.
    """
    row = rows.select(F.struct("*").alias("__row"), F.col(document).alias("__d"), F.col(order).alias("__o"), F.xxhash64("*").alias("__h"), F.coalesce(ruling, F.lit(False)).alias("__ruling"))
    ahead, behind = Window.partitionBy("__d").orderBy("__o", "__h"), Window.partitionBy("__d").orderBy(F.desc("__o"), F.desc("__h"))
    head = row.withColumn("__rn", F.row_number().over(ahead)).filter(F.col("__rn") <= max(n, ruling_n + 1))
    head = head.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy("__d")))
    firsts = head.filter(F.when(F.col("__ruling"), (F.col("__rn") == 1) | (F.col("__n") <= ruling_n)).otherwise(F.col("__rn") <= n))
    long = head.filter((F.col("__rn") == 1) & (F.col("__n") > ruling_n)).select(F.col("__d").alias("__long"))
    lasts = row.filter("__ruling").withColumn("__rn", F.row_number().over(behind)).filter(F.col("__rn") <= ruling_n - 1)
    lasts = lasts.join(long, F.col("__d").eqNullSafe(F.col("__long")), "left_semi")
    return firsts.select("__row.*").unionByName(lasts.select("__row.*"))


def running_before(rows: DataFrame, order: list[Column], value: str | Column, name: str = "before", group: str | None = None) -> DataFrame:
    """The sum of value over all rows (of the group) before this one in `order`.

    Two passes: rows are range-partitioned by group and `order`; each range's totals are summed, and within a range a
    window runs. So neither all rows nor a large group are one task's work. The ranges are written, as both passes must
    see the same ones. Only a group that goes on from the range before has a base: one a range at most, which is what is
    broadcast. `order` must be unique (within the group) for a defined result.
    """
    keys = [group] if group else []
    dealt = materialize(rows.withColumn("__value", F.col(value) if isinstance(value, str) else value).repartitionByRange(*keys, *order).withColumn("__range", F.spark_partition_id()))
    totals = dealt.groupBy("__range", *keys).agg(F.sum("__value").alias("__sum"))
    before = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.withColumn("__base", F.sum("__sum").over(before)).filter("__base is not null").select(F.col("__range").alias("__r"), *(F.col(k).alias("__group") for k in keys), "__base")
    within = F.coalesce(F.sum("__value").over(Window.partitionBy("__range", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    same = F.col("__range") == F.col("__r")
    joined = dealt.withColumn("__within", within).join(F.broadcast(bases), same & F.col(group).eqNullSafe(F.col("__group")) if group else same, "left")
    return joined.withColumn(name, F.col("__within") + F.coalesce("__base", F.lit(0))).select(*rows.columns, name)


def admit(documents: DataFrame, rank: str, size: str, chunks: str, key: str, target: int = 4200, optional_from: int = 5) -> DataFrame:
    """Documents by (rank, size descending) until `target` chunks; past it only ranks below optional_from still enter."""
    placed = running_before(documents, [F.col(rank), F.desc(size), F.col(key)], chunks)
    return placed.filter((F.col(rank) < optional_from) | (F.col("before") < target)).drop("before")


def containing(texts: DataFrame, text_col: str, patterns: DataFrame, pattern_col: str) -> DataFrame:
    """(text, pattern): the distinct texts (titles, names) with the distinct patterns that they contain; empty patterns are none.

    A pattern meets the texts that hold its rarest trigram, by an equi-join, and is looked for in these; one under three
    characters meets those that hold its first character.
    """
    rows = texts.select(F.col(text_col).alias("text")).filter("text is not null").distinct()
    asked = patterns.select(F.col(pattern_col).alias("pattern")).filter(F.length("pattern") > 0).distinct()
    held = rows.select("text", F.explode(trigrams(F.col("text"))).alias("gram"))
    counts = held.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    grams = asked.filter(F.length("pattern") >= 3).select("pattern", F.explode(trigrams(F.col("pattern"))).alias("gram"))
    rarest = grams.join(counts, "gram", "left").groupBy("pattern").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("gram"))
    letters = rows.select("text", F.explode(F.array_distinct(F.split("text", ""))).alias("gram"))
    short = asked.filter(F.length("pattern") < 3).select("pattern", F.substring("pattern", 1, 1).alias("gram"))
    met = held.join(rarest, "gram").unionByName(letters.join(short, "gram"))
    return met.filter(F.contains("text", F.col("pattern"))).select("text", "pattern")


def nearest_name(requests: DataFrame, titles: DataFrame, name: str = "name", title: str = "title") -> DataFrame:
    """For each requested name its title: the exact one, else the shortest that contains it (ties: the first by letters)."""
    found = containing(titles, title, requests, name)
    return found.groupBy(F.col("pattern").alias(name)).agg(F.min_by("text", F.struct((F.col("text") != F.col("pattern")).cast("int"), F.length("text"), F.col("text"))).alias(title))


def best_files(records: DataFrame, sources: DataFrame, file: str = "source_file", count: str = "chunks") -> DataFrame:
    """Records of the best file of each source: sources (file, count) whose normalised names agree are one source, and
    the file with most chunks (of equals the first by name) stands for it."""
    named = sources.withColumn("__source", source_name(F.col(file)))
    best = named.groupBy("__source").agg(F.min_by(file, F.struct(-F.col(count), F.col(file))).alias("__best"))
    return records.join(best.select(F.col("__best").alias(file)), file, "left_semi")


def with_keep_list(records: DataFrame, keep: DataFrame, key: str) -> DataFrame:
    """Records on a keep-list, with its columns; the optimizer broadcasts the list if it is small."""
    return records.join(keep, key)


def coverage(rows: DataFrame, metadata: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """How many rows find their metadata by key, and how many have each of its columns."""
    known = metadata.select(key, *columns).dropDuplicates([key]).withColumn("__found", F.lit(1))
    joined = rows.select(key).join(known, key, "left")
    return joined.agg(F.count(F.lit(1)).alias("rows"), F.count("__found").alias("matched"), *(F.count(c).alias(c) for c in columns))


def collated(rows: DataFrame, column: str, locale: str = "fa") -> DataFrame:
    """Rows in a language's alphabetical order."""
    return rows.orderBy(F.collate(F.col(column), locale), column)


def repeated_page_lines(pages: DataFrame, document: str, page: str, content: str, share: float = 0.5, edge: int = 3) -> DataFrame:
    """Headers and footers: lines among a page's first or last `edge` that stand on more than `share` of a document's pages."""
    cut = pages.select(document, page, F.split(content, "\n").alias("lines")).withColumn("n", F.size("lines"))
    lines = cut.select(document, page, "n", F.posexplode("lines").alias("i", "line")).filter((F.col("i") < edge) | (F.col("i") >= F.col("n") - edge))
    each = lines.filter(F.trim("line") != "").select(document, page, F.trim("line").alias("line")).distinct().groupBy(document, "line").agg(F.count(F.lit(1)).alias("on"))
    total = pages.groupBy(document).agg(F.count_distinct(page).alias("pages"))
    return each.join(total, document).filter((F.col("pages") > 1) & (F.col("on") > share * F.col("pages")))


def lexicon_hits(documents: DataFrame, lexicon: DataFrame, key: str, content: str, least: int = 2) -> DataFrame:
    """Per document: words, words in the lexicon (column word) and their share."""
    words = documents.select(key, F.explode_outer(F.split(F.lower(content), r"[^\p{L}]+")).alias("word")).filter(F.length("word") >= least)
    marked = words.join(lexicon.select("word", F.lit(1).alias("__hit")).distinct(), "word", "left")
    return marked.groupBy(key).agg(F.count(F.lit(1)).alias("words"), F.count("__hit").alias("hits")).withColumn("rate", F.col("hits") / F.col("words"))


def preflight_class(rate: Column, bounds: list[tuple[float, str]]) -> Column:
    """The label of the first bound (from the highest) that the rate reaches, the last label below all."""
    chain = F.lit(bounds[-1][1])
    for bound, label in reversed(bounds[:-1]):
        chain = F.when(rate >= bound, F.lit(label)).otherwise(chain)
    return chain


def reconcile(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Expected and actual counts side by side; what is on one side only counts 0 on the other."""
    e, a = expected.groupBy(key).agg(F.count(F.lit(1)).alias("expected")), actual.groupBy(key).agg(F.count(F.lit(1)).alias("actual"))
    both = e.join(a, key, "full_outer").na.fill(0, ["expected", "actual"])
    return both.withColumn("difference", F.col("actual") - F.col("expected"))

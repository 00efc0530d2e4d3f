"""Hybrid retrieval: exact article lookup, full-text match and vector search, fused into one ranking per question.

A question is a row; a batch of questions is one plan. Question tables are small by nature and are broadcast only while
they are (BROADCAST_QUESTIONS); beyond that the joins are left to the optimizer.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from lexloom.functions import fixed as V
from lexloom.functions.authority import authority_weight
from lexloom.functions.references import article_refs, article_score, match_values
from lexloom.functions.text import TOKEN_BREAK, is_official_url, latin_digits, normalize, search_tokens, text, tokens
from lexloom.functions.vectors import cosine, is_embedded
from lexloom.operators.corpus import running_before
from lexloom.session import broadcast_if_small, materialize

BROADCAST_QUESTIONS = 2000
#: Scores that a task holds at once.
TILE = 1 << 20
EXACT_LIMIT, FTS_LIMIT, VECTOR_LIMIT, LEXICAL_POOL, POOL, TOP = 80, 30, 30, 1500, 4000, 8


def small(questions: DataFrame, limit: int = BROADCAST_QUESTIONS) -> DataFrame:
    """The questions, broadcast if there are few and they are short."""
    return broadcast_if_small(questions, limit)


def optional_equal(rows: DataFrame, column: str, value: str | None, every: str = "all") -> DataFrame:
    """Rows with a value in a column; `every` or None: all rows."""
    return rows if value in (None, every) else rows.filter(F.col(column) == value)


def tri_state(rows: DataFrame, column: str, given: bool, value: str | None = None) -> DataFrame:
    """Not given: all rows; given as None: rows without a value; else rows with that value."""
    if not given:
        return rows
    return rows.filter(F.col(column).isNull() if value is None else F.col(column) == value)


def top(rows: DataFrame, per: str, order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group (a window group limit: each task passes on n rows a group at most), with their rank."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(per).orderBy(*order))).filter(F.col("rank") <= n)


def exact_lookup(questions: DataFrame, chunks: DataFrame, limit: int = EXACT_LIMIT) -> DataFrame:
    """Rows whose article number is one asked for: question_id, id and the chunk, by kind of source, then id.

    If the question names a law and some rows' titles contain its hint, only those stay. Equi-join on the number's
    spellings, so its cost follows the matches.
    """
    refs = questions.select("question_id", F.explode(article_refs(F.col("question"))).alias("ref"))
    values = refs.select("question_id", F.col("ref.law_hint").alias("hint"), F.explode(match_values(F.col("ref"))).alias("value")).distinct()
    asked = values.groupBy("question_id", "value").agg(F.collect_set("hint").alias("hints"))
    found = chunks.join(small(asked), chunks["article_number"] == asked["value"])
    hit = F.exists("hints", lambda h: (h != "") & F.contains(F.lower(text("source_title")), F.lower(h)))
    tier = found.withColumn("tier", F.when(hit, 0).otherwise(1))
    tier = tier.withColumn("best", F.min("tier").over(Window.partitionBy("question_id"))).filter("tier = best")
    kind = F.when(F.col("source_type") == "statute", 0).when(F.col("source_type") == "advisory_opinion", 1).otherwise(2)
    return top(tier, "question_id", [kind, F.col("id")], limit).drop("value", "hints", "tier", "best")


def fts_all_terms(questions: DataFrame, chunks: DataFrame, content: Column, limit: int = FTS_LIMIT) -> DataFrame:
    """(question_id, id, hits): rows that hold every word of the question, those with the most distinct words in few first.

    Each task counts a document's distinct matching words (partial aggregation); only whole matches go on.
    """
    asked = questions.select("question_id", search_tokens(F.col("question")).alias("terms"))
    terms = asked.select("question_id", F.size("terms").alias("n"), F.explode("terms").alias("token"))
    index = chunks.select(F.col("id"), F.explode_outer(search_tokens(content)).alias("token"))  # a plain explode infers a filter that would cut the text twice
    hits = index.join(small(terms), "token").groupBy("question_id", "id").agg(F.count(F.lit(1)).alias("hits"), F.first("n").alias("n")).filter("hits = n")
    # sizes are joined to the few matches; beside the explode they would be made again for every token
    sized = hits.join(chunks.select("id", F.length(content).alias("size")), "id")
    return top(sized, "question_id", [F.col("size"), F.col("id")], limit).select("question_id", "id", "hits", "rank")


def first_words(question: Column, terms: int = 5) -> Column:
    """The distinct first words of three letters or more, in lower case: what the fallback looks for."""
    words = F.slice(F.filter(F.split(F.regexp_replace(question, r"[^؀-ۿa-zA-Z0-9\s]", " "), r"\s+"), lambda t: F.length(t) >= 3), 1, terms)
    return F.array_distinct(F.transform(words, F.lower))


def any_term(questions: DataFrame, chunks: DataFrame, limit: int = FTS_LIMIT, terms: int = 5) -> DataFrame:
    """The fallback: rows whose content or title contains one of the question's first words of three letters or more.

    The batch's distinct words become one automaton, so a text is read once, however many questions there are; a task
    passes on the first `limit` ids of each word, as no question takes more.
    """
    asked = questions.select("question_id", F.explode(first_words(F.col("question"), terms)).alias("term"))
    rows = chunks.select("id", F.lower(text("source_title")).alias("title"), F.lower(text("content")).alias("content"))
    found = rows.mapInArrow(_holders([r[0] for r in asked.select("term").distinct().collect()], limit), StructType([chunks.schema["id"], StructField("term", StringType())]))
    least = top(found.distinct(), "term", [F.col("id")], limit).drop("rank")
    return top(least.join(small(asked), "term").select("question_id", "id").distinct(), "question_id", [F.col("id")], limit).select("question_id", "id", "rank")


def _holders(terms: list[str], limit: int) -> Callable:
    """(id, term) of rows (id, title, content) that contain a term, at most `limit` with the least ids a term and batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        known = ahocorasick.Automaton()
        for term in terms:
            known.add_word(term, term)
        if terms:
            known.make_automaton()
        for batch in batches:
            ids, held = batch.column(0), {}
            order = pc.sort_indices(ids).to_pylist()
            titles, contents = (batch.column(i) for i in (1, 2))
            for row in order if terms else ():
                # a term that has its rows in this batch already can be found again to no effect
                for term in {t for column in (titles, contents) for _, t in known.iter(column[row].as_py() or "")}:
                    at = held.setdefault(term, [])
                    if len(at) < limit:
                        at.append(row)
            taken = pa.array([row for at in held.values() for row in at], pa.int64())
            yield pa.RecordBatch.from_arrays([ids.take(taken), pa.array([t for t, at in held.items() for _ in at], pa.string())], ["id", "term"])

    return run


def nearest_by_cosine(questions: DataFrame, chunks: DataFrame, limit: int = VECTOR_LIMIT, places: int = 6) -> DataFrame:
    """(question_id, id, semantic, rank): exact cosine top-k of each question's vector over all embedded rows.

    Questions travel to the rows as one matrix: a task multiplies each Arrow batch with it, TILE scores at a time, and passes
    on the best `limit` rows a question, so neither its memory nor what is shuffled follows the corpus. More than BROADCAST_QUESTIONS go in blocks of about
    that many, one pass each, so that no task holds more. Ranks follow the rounded score, ties the id. Vectors of another
    length count as -1.
    """
    n = questions.count()
    if n <= BROADCAST_QUESTIONS:
        return _nearest(questions, chunks, limit, places)
    blocks = -(-n // BROADCAST_QUESTIONS)
    part = F.pmod(F.xxhash64(F.col("question_id")), F.lit(blocks))
    return functools.reduce(DataFrame.unionByName, (_nearest(questions.filter(part == i), chunks, limit, places) for i in range(blocks)))


def _nearest(questions: DataFrame, chunks: DataFrame, limit: int, places: int) -> DataFrame:
    """nearest_by_cosine for one block of questions."""
    rows = chunks.filter(is_embedded(F.col("embedding"))).select("id", "embedding")
    asked = questions.select("question_id", F.col("vector").cast("array<double>").alias("__q"))
    few = asked.collect()
    by_size: dict[int, list[int]] = {}
    for i, r in enumerate(few):
        by_size.setdefault(len(r["__q"] or ()), []).append(i)
    units = {n: np.array([few[i]["__q"] for i in places_], float).reshape(len(places_), n) for n, places_ in by_size.items()}
    units = {n: m / np.where((size := np.linalg.norm(m, axis=1, keepdims=True)) > 0, size, 1) for n, m in units.items()}
    zero, of = {n: ~m.any(axis=1) for n, m in units.items()}, {n: np.array(places_) for n, places_ in by_size.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vectors = batch.column(0), batch.column(1)
            sizes = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
            of_size = {}
            for n in np.unique(sizes):
                if int(n) in units:
                    at = np.flatnonzero(sizes == n)
                    m = np.nan_to_num(vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)).reshape(len(at), int(n))
                    length = np.linalg.norm(m, axis=1)
                    of_size[int(n)] = at, m / np.where(length > 0, length, 1)[:, None], length == 0
            order = np.argsort(np.argsort(ids.to_numpy(zero_copy_only=False), kind="stable"), kind="stable")
            step = max(1, TILE // max(1, batch.num_rows))
            for start in range(0, len(few), step):
                found = np.full((min(step, len(few) - start), batch.num_rows), -1.0)
                for n, (at, m, nought) in of_size.items():
                    mine = np.flatnonzero((of[n] >= start) & (of[n] < start + step))
                    score = units[n][mine] @ m.T
                    score[:, nought] = -1
                    score[zero[n][mine]] = -1
                    found[np.ix_(of[n][mine] - start, at)] = score
                np.round(found, places, out=found)
                best = [np.lexsort((order, -f))[:limit] if batch.num_rows <= 4 * limit else _first(f, order, limit) for f in found]
                q, r = np.repeat(np.arange(len(best)), [len(b) for b in best]), np.concatenate(best)
                yield pa.RecordBatch.from_arrays([pa.array((start + q).astype(np.int32)), ids.take(pa.array(r)), pa.array(found[q, r], pa.float64())], ["__i", "id", "semantic"])

    if not few:
        return asked.join(rows.select("id"), F.lit(False)).select("question_id", "id", F.lit(0.0).alias("semantic"), F.lit(1).alias("rank"))
    names = asked.sparkSession.createDataFrame([(i, r["question_id"]) for i, r in enumerate(few)], StructType([StructField("__i", IntegerType()), asked.schema["question_id"]]))
    schema = StructType([StructField("__i", IntegerType()), StructField("id", chunks.schema["id"].dataType), StructField("semantic", DoubleType())])
    best = top(rows.mapInArrow(run, schema), "__i", [F.desc("semantic"), F.col("id")], limit)
    return best.join(F.broadcast(names), "__i").select("question_id", "id", "semantic", "rank")


def _first(score: np.ndarray, order: np.ndarray, n: int) -> np.ndarray:
    """Indices of the n best of many: all that reach the n-th score, then by score and order."""
    bar = -np.partition(-score, n - 1)[n - 1]
    able = np.flatnonzero(score >= bar)
    return able[np.lexsort((order[able], -score[able]))[:n]]


def bounded_rerank(question_id: int, chunks: DataFrame, vector: list[float], lexical: Column, pool: int = LEXICAL_POOL, total: int = POOL, limit: int = VECTOR_LIMIT, places: int = 6) -> DataFrame:
    """Where no vector index may scan all: the first `pool` rows that match `lexical`, filled up to `total` by id, reranked
    by cosine. Only ids and vectors are sorted; contents are joined to the `limit` winners."""
    rows = chunks.filter(is_embedded(F.col("embedding"))).select("id", "embedding", lexical.alias("hit"))
    first = rows.filter("hit").orderBy("id").limit(pool)
    rest = rows.join(first.select("id"), "id", "left_anti").orderBy("id").limit(total)
    both = first.select("id", "embedding", F.lit(0).alias("turn")).unionByName(rest.select("id", "embedding", F.lit(1).alias("turn")))
    best = both.orderBy("turn", "id").limit(total).withColumn("semantic", F.round(cosine(F.col("embedding"), F.array(*map(F.lit, vector))), places))
    best = best.orderBy(F.desc("semantic"), "id").limit(limit).select("id", "semantic", F.lit(question_id).alias("question_id"))
    return chunks.drop("embedding").join(F.broadcast(best), "id")


def bounded_rerank_all(questions: DataFrame, chunks: DataFrame, pool: int = LEXICAL_POOL, total: int = POOL, limit: int = VECTOR_LIMIT, places: int = 6) -> DataFrame:
    """(question_id, id, semantic, rank): bounded rerank for a batch of questions (question_id, question, vector).

    A question's candidates are the first `pool` rows that hold one of its first words, filled up to `total` by id; the
    first `total` ids of all hold whatever the fill can take. So a question has `total` candidates at most, whatever the
    corpus; only ids meet, and vectors are joined to them.
    """
    rows = chunks.filter(is_embedded(F.col("embedding")))
    hits = materialize(any_term(questions, rows, pool).select("question_id", "id"))
    fill = rows.select("id").orderBy("id").limit(total)
    rest = questions.select("question_id").join(F.broadcast(fill)).join(hits, ["question_id", "id"], "left_anti")
    both = hits.withColumn("turn", F.lit(0)).unionByName(rest.withColumn("turn", F.lit(1)))
    chosen = top(both, "question_id", [F.col("turn"), F.col("id")], total).select("question_id", "id")
    scored = chosen.join(rows.select("id", "embedding"), "id").join(small(questions.select("question_id", "vector")), "question_id")
    near = scored.select("question_id", "id", F.round(cosine(F.col("embedding"), F.col("vector")), places).alias("semantic"))
    return top(near, "question_id", [F.desc("semantic"), F.col("id")], limit)


def haystack(title: Column, content: Column) -> Column:
    """What lexical overlap looks into."""
    return F.concat_ws("\n", normalize(text(title)), normalize(text(content)))


def lexical_overlap(words: Column, hay: Column) -> Column:
    """Share of a question's words (repeats count) that a haystack contains."""
    return F.when(F.size(words) > 0, F.size(F.filter(words, lambda t: F.contains(hay, t))) / F.size(words)).otherwise(F.lit(0.0))


def fused_score(exact: Column, semantic: Column, lexical: Column, weight: Column, official: Column) -> Column:
    return exact * V.W_EXACT + semantic * V.W_SEMANTIC + lexical * V.W_LEXICAL + weight * V.W_AUTHORITY + F.when(official, F.lit(V.W_OFFICIAL)).otherwise(F.lit(0.0))


def rank(candidates: DataFrame, limit: int = TOP, places: int | None = None) -> DataFrame:
    """The final ranking of candidates: question_id, question, id, content, source_type, source_title, article_number,
    source_url, semantic, match_kind, pos (place in exact, full-text, vector order).

    Of an id's rows the one with the larger score stays (ties: the earlier), at the place of the first. Exact and
    full-text rows stay, others above KEEP_SCORE. If an exact row's title names the law asked for, rows with the same
    article of another law go. Then the best `limit` by score, ties by place.
    """
    if "hay" not in candidates.columns:
        candidates = candidates.withColumn("hay", haystack(F.col("source_title"), F.col("content")))
    asked = candidates.select("question_id", "question").distinct().withColumns({"refs": article_refs(F.col("question")), "words": tokens(F.col("question"))}).drop("question")
    scored = candidates.join(asked, "question_id").withColumn("exact", article_score(F.col("refs"), F.col("article_number"), F.col("source_title")))
    score = fused_score(F.col("exact"), F.coalesce(F.col("semantic"), F.lit(0.0)), lexical_overlap(F.col("words"), F.col("hay")), authority_weight(F.col("source_type"), F.col("source_title")), is_official_url(F.col("source_url")))
    kind = F.when(F.col("exact") >= V.EXACT_PLAIN, "exact_article").when(F.col("match_kind") == "exact_article", "fts").otherwise(F.col("match_kind"))
    scored = scored.withColumns({"score": score if places is None else F.round(score, places), "match_kind": kind})
    same = Window.partitionBy("question_id", "id")
    one = scored.withColumns({"first_pos": F.min("pos").over(same), "turn": F.row_number().over(same.orderBy(F.desc("score"), "pos"))}).filter("turn = 1")
    kept = one.filter(F.col("match_kind").isin("exact_article", "fts") | (F.col("score") > V.KEEP_SCORE))
    title, art = normalize(text("source_title")), latin_digits(text("article_number"))
    hinted = F.filter("refs", lambda r: r["law_hint"] != "")
    names = (F.col("match_kind") == "exact_article") & F.exists(hinted, lambda r: F.contains(title, r["law_hint"]))
    other = (F.length(art) <= 6) & F.exists(hinted, lambda r: ((art == r["number"]) | (art == F.concat(r["number"], F.lit(V.REPEATED)))) & ~F.contains(title, r["law_hint"]))
    kept = kept.withColumn("named", F.max(F.coalesce(names, F.lit(False))).over(Window.partitionBy("question_id"))).filter(~(F.col("named") & F.coalesce(other, F.lit(False))))
    return top(kept, "question_id", [F.desc("score"), F.col("first_pos")], limit).drop("refs", "words", "hay", "first_pos", "turn", "named")


@dataclass
class Branches:
    """How candidates are found, each from the questions alone: (question_id, id, rank), the vector branch also semantic."""

    exact: Callable[[DataFrame], DataFrame]
    all_terms: Callable[[DataFrame], DataFrame]
    any_term: Callable[[DataFrame], DataFrame]
    nearest: Callable[[DataFrame], DataFrame]


def scans(chunks: DataFrame) -> Branches:
    """Branches that read the chunks themselves."""
    searched = F.concat_ws(" ", text("source_title"), text("article_number"), text("content"))
    return Branches(lambda q: exact_lookup(q, chunks), lambda q: fts_all_terms(q, chunks, searched), lambda q: any_term(q, chunks), lambda q: nearest_by_cosine(q, chunks))


def retrieve(questions: DataFrame, chunks: DataFrame, limit: int = TOP, places: int | None = None, branches: Branches | None = None) -> DataFrame:
    """Hybrid retrieval of a batch: questions (question_id, question and, where vectors are at hand, vector) over chunks.

    A question that no row answers with all its words gets the rows that hold any of its first ones. Without a vector
    column, or for a question whose vector is null (a model that failed), the vector branch adds nothing. Candidates are
    ids; contents are joined to them once. branches: stored indexes in place of scans (`indexed`).
    """
    by, kept = branches or scans(chunks), materialize if branches else (lambda rows: rows)  # what indexes give is small and has a long lineage
    all_terms = kept(by.all_terms(questions))
    answered = all_terms.select("question_id").distinct()
    fallback = by.any_term(questions.join(answered, "question_id", "left_anti") if branches else questions).join(answered, "question_id", "left_anti")
    hits = {0: ("exact_article", by.exact(questions)), 1: ("fts", all_terms.select("question_id", "id", "rank").unionByName(fallback.select("question_id", "id", "rank")))}
    if "vector" in questions.columns:
        hits[2] = ("vector", by.nearest(questions.filter("vector is not null")))
    found = kept(functools.reduce(
        DataFrame.unionByName,
        (rows.select("question_id", "id", F.lit(kind).alias("match_kind"), (F.col("semantic") if kind == "vector" else F.lit(0.0)).alias("semantic"), (F.lit(branch * 1_000_000) + F.col("rank")).alias("pos")) for branch, (kind, rows) in hits.items()),
    ))
    # a row found for many questions is normalised once
    rows = chunks.drop("embedding").join(found.select("id").distinct(), "id", "left_semi").withColumn("hay", haystack(F.col("source_title"), F.col("content")))
    return rank(rows.join(found, "id").join(small(questions.select("question_id", "question")), "question_id"), limit, places)


def merge_by_distance(rows: DataFrame, group: str, key: str, limit: int = 10) -> DataFrame:
    """Rows of several rewritten questions as one list: of each key the row with the least distance, then the nearest."""
    best = rows.groupBy(group, key).agg(F.min("distance").alias("distance"))
    return top(best, group, [F.col("distance"), F.col(key)], limit)


def excerpts(question: Column, files: DataFrame, budget: int = 2500) -> DataFrame:
    """Paragraphs of a user's files (user_id, file_id, filename, content, created_at; newest first) that hold a word of
    the question, until `budget` characters are used; the last one is cut."""
    words = F.filter(F.split(normalize(question), TOKEN_BREAK), lambda t: F.length(t) >= 3)
    each = files.withColumn("__words", words).select("user_id", "file_id", "filename", "created_at", "__words", F.posexplode(F.split("content", r"\n{2,}")).alias("place", "para"))
    # bound by a lambda, a paragraph is normalised once, not once a word
    hits = each.filter(F.exists(F.array(normalize(F.col("para"))), lambda p: F.exists("__words", lambda t: F.contains(p, t)))).drop("__words")
    used = running_before(hits, [F.desc("created_at"), F.col("file_id"), F.col("place")], F.length("para"), "used", "user_id")
    return used.filter(F.col("used") < budget).select("user_id", "file_id", "filename", "place", F.expr(f"substring(para, 1, cast({budget} - used as int))").alias("excerpt"))

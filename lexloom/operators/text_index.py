"""A stored full-text index: postings in blocks, clustered by token, in the order in which results are ranked.

A folder of Parquet tables:

* `blocks`, by generation and bucket of tokens: a token, up to BLOCK (size, id) postings in order, and their bounds.
* `grams`, by generation and bucket of trigrams: which words hold a trigram. Only an index of words has it.

Everything is built and searched by joins and aggregations. A question reads the buckets of its own tokens, and of their
lists the head only, unless that holds too few matches. Rows are appended as a new generation; nothing is rebuilt.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from lexloom.functions.text import search_tokens, text, trigrams
from lexloom.operators import vector_index
from lexloom.operators.retrieval import FTS_LIMIT, Branches, exact_lookup, first_words, small, top
from lexloom.session import broadcast_if_small, materialize

#: Postings of a block; folders that tokens are dealt to.
BLOCK, BUCKETS = 128, 32
#: How many times the rows wanted are read of the rarest list before all of it is.
HEAD = 8


def runs(c: Column) -> Column:
    """The distinct words that a word of a question can be part of: runs of the letters that questions keep, in lower case."""
    return F.array_distinct(F.array_remove(F.split(F.lower(c), r"[^؀-ۿa-z0-9]+"), ""))


def _bucket(token: str) -> Column:
    return F.pmod(F.crc32(F.col(token).cast("binary")), F.lit(BUCKETS)).cast("int")


def _write(rows: DataFrame, path: str, generation: int, *order: str) -> None:
    """Rows by bucket, in order within a file; a generation that comes again takes its own place."""
    dealt = rows.withColumn("generation", F.lit(generation)).hint("rebalance", "bucket").sortWithinPartitions("generation", "bucket", *order)
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("generation", "bucket").parquet(path)


def append(rows: DataFrame, path: str, tokens: Column, size: Column, generation: int = 0, substrings: bool = False) -> None:
    """Index rows (id, ...) by their array of tokens as one generation; ids must be new. size leads the order of results.

    Texts are cut once: their tokens are written, as finding the ranges reads them too. Postings are sorted by range over
    all tasks, so a token that a third of the rows hold is many tasks' work; a block never crosses a task. substrings: also
    keep which words hold which trigrams; the words are those of the blocks.
    """
    cut = materialize(rows.select("id", size.cast("long").alias("size"), tokens.alias("tokens")))
    postings = cut.select("id", "size", F.explode("tokens").alias("token"))
    placed = postings.repartitionByRange("token", "size", "id").sortWithinPartitions("token", "size", "id")
    posting = StructType([StructField("size", LongType()), rows.schema["id"]])
    shape = StructType([StructField("token", StringType()), StructField("postings", ArrayType(posting)), StructField("n", LongType()), StructField("low", posting), StructField("high", posting)])
    blocks = placed.select("token", "size", "id").mapInArrow(_blocks, shape)
    _write(blocks.withColumn("bucket", _bucket("token")), f"{path}/blocks", generation, "token", "low")
    stored = _read(rows.sparkSession, f"{path}/blocks") if substrings else None
    if stored is not None:
        words = stored.filter(F.col("generation") == generation).select("token").distinct()
        grams = words.select(F.explode(trigrams(F.col("token"))).alias("gram"), F.col("token").alias("word"))
        _write(grams.withColumn("bucket", _bucket("gram")), f"{path}/grams", generation, "gram")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of sorted rows (token, size, id): up to BLOCK of one token that follow each other in a batch."""
    for batch in batches:
        token, rows = batch.column(0), batch.num_rows
        if not rows:
            continue
        turns = np.flatnonzero(pc.not_equal(token.slice(1), token.slice(0, rows - 1)).to_numpy(zero_copy_only=False)) + 1
        starts = np.r_[0, turns]
        place = np.arange(rows) - np.repeat(starts, np.diff(np.r_[starts, rows]))
        low = np.flatnonzero(place % BLOCK == 0)
        ends = np.r_[low[1:], rows]
        posting = pa.StructArray.from_arrays(batch.columns[1:], ["size", "id"])
        held = pa.ListArray.from_arrays(pa.array(np.r_[low, rows], pa.int32()), posting)
        yield pa.RecordBatch.from_arrays([token.take(pa.array(low)), held, pa.array(ends - low), posting.take(pa.array(low)), posting.take(pa.array(ends - 1))], ["token", "postings", "n", "low", "high"])


def index_texts(chunks: DataFrame, path: str, content: Column, generation: int = 0) -> None:
    """What all_terms searches: every word of a text, shorter texts first."""
    append(chunks, path, search_tokens(content), F.length(content), generation)


def index_words(chunks: DataFrame, path: str, generation: int = 0) -> None:
    """What any_term searches: the words of title and content, in order of the id."""
    append(chunks, path, runs(F.concat_ws("\n", "source_title", "content")), F.lit(0), generation, substrings=True)


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:  # no row has had a token yet
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def _asked(blocks: DataFrame, terms: DataFrame, token: str = "token") -> DataFrame:
    """Blocks of the terms' tokens, in the terms' buckets only: these are distinct, BUCKETS at most, and prune partitions."""
    known = terms.withColumn("bucket", _bucket(token))
    near = blocks.join(F.broadcast(known.select("bucket").filter("bucket >= 0").distinct()), "bucket", "left_semi")
    return near.join(small(known), ["bucket", token]).drop("bucket", "generation")


def all_terms(questions: DataFrame, path: str, limit: int = FTS_LIMIT) -> DataFrame:
    """(question_id, id, hits, rank): rows that hold every word of the question, shorter texts first, ties by id.

    All lists have the order of the results. So of each question's rarest list the head is taken, about HEAD * limit
    postings, and of the others what does not lie behind it; if `limit` rows match there, nothing behind can enter. Only
    questions for which fewer match read their lists whole.
    """
    spark = questions.sparkSession
    blocks = _read(spark, f"{path}/blocks")
    terms = materialize(questions.select("question_id", search_tokens(F.col("question")).alias("terms")).select("question_id", F.size("terms").alias("words"), F.explode("terms").alias("token")))
    if blocks is None:
        return terms.limit(0).select("question_id", F.lit(None).cast("long").alias("id"), F.lit(0).cast("long").alias("hits"), F.lit(0).alias("rank"))
    sizes = _asked(blocks.select("bucket", "generation", "token", "n"), terms).groupBy("question_id", "words", "token").agg(F.sum("n").alias("n"))
    able = materialize(sizes.groupBy("question_id", "words").agg(F.count(F.lit(1)).alias("lists"), F.min_by("token", F.struct("n", "token")).alias("token"), F.min("n").alias("n")).filter("lists = words"))
    # the head of the rarest list: as many blocks as must hold enough, and the place where these end
    heads = _asked(blocks.select("bucket", "generation", "token", "low", "high", F.col("n").alias("held")), able)
    before = F.coalesce(F.sum("held").over(Window.partitionBy("question_id").orderBy("low").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = top(heads, "question_id", [F.col("low")], HEAD * limit).withColumn("before", before).filter(F.col("before") < HEAD * limit)
    cut = materialize(first.groupBy("question_id").agg(F.max("high").alias("cut"), F.sum("held").alias("read"), F.max("n").alias("n")))
    near = materialize(top(_matches(blocks, terms.join(cut.select("question_id", "cut"), "question_id")), "question_id", [F.col("size"), F.col("id")], limit).drop("rank"))
    enough = near.groupBy("question_id").agg(F.count(F.lit(1)).alias("found")).filter(F.col("found") >= limit)
    whole = cut.filter("read = n").select("question_id")  # the head was all of it: nothing is behind
    done = materialize(enough.select("question_id").union(whole).distinct())
    rest = able.select("question_id").join(done, "question_id", "left_anti").withColumn("cut", F.lit(None).cast(cut.schema["cut"].dataType))
    far = _matches(blocks, terms.join(rest, "question_id"))
    found = near.join(done, "question_id", "left_semi").unionByName(far)
    return top(found, "question_id", [F.col("size"), F.col("id")], limit).select("question_id", "id", "hits", "rank")


def _matches(blocks: DataFrame, terms: DataFrame) -> DataFrame:
    """(question_id, size, id, hits) of postings up to the question's cut (null: all) that are in the lists of all its words."""
    asked = _asked(blocks.select("bucket", "generation", "token", "postings", "low"), terms)
    held = asked.filter(F.col("cut").isNull() | (F.col("low") <= F.col("cut"))).select("question_id", "words", "cut", F.explode("postings").alias("p"))
    within = held.filter(F.col("cut").isNull() | (F.col("p") <= F.col("cut"))).select("question_id", "words", "p.size", "p.id")
    return within.groupBy("question_id", "size", "id").agg(F.count(F.lit(1)).alias("hits"), F.first("words").alias("words")).filter("hits = words").drop("words")


def any_term(questions: DataFrame, path: str, limit: int = FTS_LIMIT, terms: int = 5) -> DataFrame:
    """(question_id, id, rank): rows whose title or content contains one of the question's first words, by id.

    A word of a question holds no separator, so it is contained in a text if it is contained in one of the text's words.
    Trigrams find these words by an equi-join, verified on the word itself; then only the first blocks of their lists are
    read, as no word gives more than `limit` rows. Neither texts nor words pass through the driver.
    """
    spark = questions.sparkSession
    asked = questions.select("question_id", F.explode(first_words(F.col("question"), terms)).alias("term"))
    blocks, grams = _read(spark, f"{path}/blocks"), _read(spark, f"{path}/grams")
    if blocks is None or grams is None:
        return asked.limit(0).select("question_id", F.lit(None).cast("long").alias("id"), F.lit(0).alias("rank"))
    parts = asked.select("term").distinct().select("term", trigrams(F.col("term")).alias("grams")).select("term", F.size("grams").alias("parts"), F.explode("grams").alias("gram"))
    hits = _asked(grams, materialize(parts), "gram").groupBy("term", "word").agg(F.count_distinct("gram").alias("hits"), F.first("parts").alias("parts"))
    words = materialize(hits.filter((F.col("hits") == F.col("parts")) & F.contains("word", F.col("term"))).select("term", F.col("word").alias("token")))
    lists = _asked(blocks.select("bucket", "generation", "token", "low", F.slice("postings", 1, limit).alias("postings")), words)
    heads = lists.withColumn("turn", F.row_number().over(Window.partitionBy("term", "token").orderBy("low"))).filter(F.col("turn") <= limit)
    ids = heads.select("term", F.explode("postings").alias("p")).select("term", "p.id").distinct()
    least = top(ids, "term", [F.col("id")], limit).drop("rank")
    found = least.join(broadcast_if_small(asked, 2000), "term").select("question_id", "id").distinct()
    return top(found, "question_id", [F.col("id")], limit).select("question_id", "id", "rank")


def build_indexes(chunks: DataFrame, path: str, dims: int, generation: int = 0) -> None:
    """All that `indexed` reads, for chunks (id, content, source_title, article_number, embedding). The first generation
    also fits the vectors' model; later ones append."""
    index_texts(chunks, f"{path}/texts", F.concat_ws(" ", text("source_title"), text("article_number"), text("content")), generation)
    index_words(chunks, f"{path}/words", generation)
    if generation == 0:
        vector_index.build(chunks, f"{path}/vectors", dims)
    else:
        vector_index.append(chunks, f"{path}/vectors", generation)


def indexed(chunks: DataFrame, path: str, exact_vectors: bool = True, probes: int = 8) -> Branches:
    """Branches of `retrieval.retrieve` over stored indexes; the article lookup is an equi-join and reads its columns only."""
    return Branches(
        lambda q: exact_lookup(q, chunks), lambda q: all_terms(q, f"{path}/texts"), lambda q: any_term(q, f"{path}/words"), lambda q: vector_index.search(q, f"{path}/vectors", probes=probes, exact=exact_vectors)
    )

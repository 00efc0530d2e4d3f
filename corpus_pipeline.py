"""From raw documents to packed sequences: five stages, each applying one operator to all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import decontaminate, language_id, packing, simhash, substring_dedup
from lexloom.llm.common import materialize
from lexloom.session import spread


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language can be told; those whose text is null or has no letter go.

    Languages are learned from the rows' own lang. If none has one, nothing can be told, and every text with a letter
    stays. Rows are judged one by one: ties, repeated rows and null ids need no rule. An empty table gives no rows.
    """
    model = language_id.fit(docs, F.lit(True))
    if model is None:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    told = language_id.predict(docs, model, label="__lang", score="__score")
    return told.filter(F.col("__lang") != language_id.UNDETERMINED).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates: five-word shingles, a similarity of 0.8 or more.

    The smallest id stays; null ids come last, of several the one whose text has the least hash. Of rows equal in id and
    text one stays. Null, empty and blank texts are duplicates of each other. An empty table gives no rows.
    """
    return simhash.drop_near_duplicates(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep every document, its text without passages of 100 bytes or more that came earlier.

    Earlier is a smaller id (null ids last) or the same document further left. A text that is all repeated becomes
    empty; null and empty texts stay as they are; rows equal in id and text get the same result.
    """
    return substring_dedup.dedupe(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that hold no benchmark item: under 0.8 of the distinct five-word shingles of each.

    Null and empty texts hold none and stay; items with a null id are ignored; repeated rows go or stay together.
    """
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens. Every row is packed, repeated ones and null ids too; null and empty texts are one end token."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), ranks=public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeated_passages),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("packing", pack),
]

#: SQL cannot express tokenizers, tries or rolling hashes; tests/llm/test_pipeline.py compares each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written as Parquet and read again by the next."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialize(docs)
    return docs

"""Stored indexes against the scans that they stand for."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexloom.operators import retrieval, text_index, vector_index

EMBEDDED = "id long, embedding array<double>"


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 32))
    x = centres[rng.integers(0, 40, 4000)] + 0.35 * rng.normal(size=(4000, 32))
    x[3900:3950] = x[3900]  # ties
    return x


@pytest.fixture(scope="module")
def chunks(spark, vectors):
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, EMBEDDED).repartition(4).persist()


@pytest.fixture(scope="module")
def asked(spark, vectors):
    rng = np.random.default_rng(9)
    rows = [(i, [float(c) for c in vectors[37 * i] + 0.1 * rng.normal(size=32)]) for i in range(60)] + [(60, [float(c) for c in vectors[3900]]), (61, [float(c) for c in rng.normal(size=32)])]
    return spark.createDataFrame(rows, "question_id long, vector array<double>")


@pytest.fixture(scope="module")
def index(spark, chunks, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "vectors")
    vector_index.build(chunks.filter("id < 3000"), path, 32, lists=50, entries=32)
    vector_index.append(chunks.filter("id >= 3000"), path, 1)
    return path


def pairs(found):
    return {(r.question_id, r.id) for r in found.collect()}


def test_exact_search_equals_the_scan(chunks, asked, index, monkeypatch):
    monkeypatch.setattr(vector_index, "SLICE", 40)
    monkeypatch.setattr(vector_index, "QUESTION_BLOCK", 20)
    want = sorted(map(tuple, retrieval.nearest_by_cosine(asked, chunks).select("question_id", "id", "semantic", "rank").collect()))
    assert sorted(map(tuple, vector_index.search(asked, index, exact=True).collect())) == want


def test_scores_are_held_in_tiles(chunks, asked, monkeypatch):
    want = sorted(map(tuple, retrieval.nearest_by_cosine(asked, chunks).collect()))
    monkeypatch.setattr(retrieval, "TILE", 5000)
    assert sorted(map(tuple, retrieval.nearest_by_cosine(asked, chunks).collect())) == want


def test_a_cell_gives_the_best_rows_and_those_whose_rounding_is_unsure():
    score = np.array([0.9, 0.5, 0.50000049999999, 0.7, 0.5, 0.1])
    found = vector_index._share(np.arange(6), score, np.array([5, 4, 3, 2, 1, 0]), 3, 6)
    assert found.tolist() == [0, 2, 3, 4]  # of the two at 0.5 the one first in order; the third may round up
    assert len(vector_index._share(np.arange(5000), np.full(5000, 0.25), np.arange(5000), 30, 6)) == 30


def test_blocks_hold_one_token_in_order():
    token = ["a"] * 130 + ["b"] + ["c"] * 128
    batch = pa.RecordBatch.from_arrays([pa.array(token), pa.array(range(259), pa.int64()), pa.array(range(1000, 1259), pa.int64())], ["token", "size", "id"])
    found = pa.Table.from_batches(text_index._blocks(iter([batch]))).to_pylist()
    assert [(r["token"], r["n"]) for r in found] == [("a", 128), ("a", 2), ("b", 1), ("c", 128)]
    assert [p["id"] for r in found for p in r["postings"]] == list(range(1000, 1259))
    assert all((r["low"], r["high"]) == (r["postings"][0], r["postings"][-1]) for r in found)


def test_few_probes_find_nearly_all_and_read_few_lists(spark, chunks, asked, index):
    want = pairs(retrieval.nearest_by_cosine(asked.filter("question_id < 61"), chunks))
    found = vector_index.search(asked.filter("question_id < 61"), index, probes=6)
    assert len(want & pairs(found)) >= 0.95 * len(want)
    assert vector_index.probes_for(spark, index, recall=0.95) <= 8
    few = vector_index.search(asked.filter("question_id = 3"), index, probes=2)
    assert few.count() == 30


def test_codes_that_tell_little_hide_no_near_rows(spark, tmp_path):
    rng = np.random.default_rng(6)  # directions at random: of all rows, the best codes hold about half of the nearest
    rows = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(rng.normal(size=(6000, 64)))], EMBEDDED).repartition(4).persist()
    path = str(tmp_path / "random")
    vector_index.build(rows, path, 64)
    few = rows.filter("id % 200 = 0").selectExpr("id as question_id", "embedding as vector")
    want = pairs(retrieval.nearest_by_cosine(few, rows))
    found = vector_index.search(few, path, probes=vector_index.probes_for(spark, path))
    assert len(want & pairs(found)) >= 0.95 * len(want)


def test_probes_are_chosen_by_one_search(spark, chunks, index, monkeypatch):
    scored, calls = vector_index._scored, []
    monkeypatch.setattr(vector_index, "_scored", lambda *a, **k: calls.append(a[5]) or scored(*a, **k))
    assert vector_index.probes_for(spark, index, recall=1.1) == 50 and calls == [50]  # no number reaches it
    few = spark.read.parquet(f"{index}/entries").selectExpr("id as question_id", "embedding as vector", "pmod(xxhash64(id, 23), bigint(1) << 40) as turn").filter(f"turn < {int((1 << 40) * 64 / 4000) + 1}")
    want, probes = pairs(retrieval.nearest_by_cosine(few, chunks)), vector_index.probes_for(spark, index, recall=0.9)
    assert len(want & pairs(vector_index.search(few, index, probes=probes))) >= 0.9 * len(want)
    assert probes == 4 or len(want & pairs(vector_index.search(few, index, probes=probes // 2))) < 0.9 * len(want)


def test_a_cell_gives_few_rows_a_question(spark, asked, index):
    model = vector_index.load(spark, index)
    entries, slices, radius = vector_index._stored(spark, index, model)
    found = vector_index._scored(asked.withColumn("bar", F.lit(None).cast("double")), entries, model, slices, radius, 50, 100_000, 5)
    assert found.groupBy("question_id", "list").count().agg(F.max("count")).first()[0] <= 6  # five, and where rounding is unsure


def test_wide_vectors_are_cut_into_smaller_slices(spark, index, monkeypatch):
    monkeypatch.setattr(vector_index, "SLICE_COMPONENTS", 32 * 10)
    sizes = {r.list: r.n for r in spark.read.parquet(f"{index}/lists").groupBy("list").agg(F.sum("n").alias("n")).collect()}
    slices = vector_index._stored(spark, index, vector_index.load(spark, index))[1]
    assert {i: int(slices[i]) for i in sizes} == {i: -(-n // 10) for i, n in sizes.items()}


def test_lists_that_no_question_probes_are_not_read(spark, index):
    entries = spark.read.parquet(f"{index}/entries")
    wanted = spark.createDataFrame([(1,)], "list int").write.mode("overwrite").parquet(f"{index}/wanted")
    wanted = spark.read.parquet(f"{index}/wanted").filter("list >= 0").distinct()
    plan = entries.select("id", "list").join(F.broadcast(wanted), "list", "left_semi")._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan


def test_appending_again_changes_nothing(spark, chunks, asked, index):
    before = sorted(map(tuple, vector_index.search(asked, index, exact=True).collect()))
    vector_index.append(chunks.filter("id >= 3000"), index, 1)
    assert sorted(map(tuple, vector_index.search(asked, index, exact=True).collect())) == before
    assert spark.read.parquet(f"{index}/entries").count() == 4000


def test_index_of_bad_vectors_and_of_none(spark, asked, tmp_path):
    bad = [(1, None), (2, []), (3, [0.0] * 32), (4, [1.0] * 31), (5, [float("nan")] * 32)]
    vector_index.build(spark.createDataFrame(bad, EMBEDDED), str(tmp_path / "none"), 32)
    assert vector_index.search(asked, str(tmp_path / "none")).count() == 0
    vector_index.build(spark.createDataFrame([*bad, (6, [1.0] * 32), (7, [1e-200] * 31 + [2e-200])], EMBEDDED), str(tmp_path / "few"), 32)
    found = vector_index.search(spark.createDataFrame([(1, [2.0] * 32), (2, None), (3, [1.0]), (4, [0.0] * 32)], "question_id int, vector array<double>"), str(tmp_path / "few"), exact=True)
    assert [(r.question_id, r.id, r.rank) for r in found.orderBy("rank").collect()][0] == (1, 6, 1)


TEXT = "id long, source_title string, article_number string, content string"


@pytest.fixture(scope="module")
def texts(spark):
    rng = np.random.default_rng(4)
    words = [f"{a}{b}{c}" for a in "kmr" for b in ("ona", "İz", "éta", "ul") for c in ("", "se", "ndo", "12")] + ["قانون", "قانون‌گذار", "ماده", "Straße"]
    rows = []
    for i in range(900):
        picked = rng.choice(words, size=int(rng.integers(1, 60)))
        rows.append((i, f"Law {i % 7}" if i % 3 else None, str(i), " ".join(["common", *picked]) if i % 2 else f"{'-'.join(picked)} Common."))
    rows += [(900, None, None, None), (901, "", "1", ""), (902, "t", "1", "..."), (903, "t", "2", "x" * 30_000 + " konase"), (904, "konase", "3", "title only")]
    return spark.createDataFrame(rows, TEXT).repartition(3).persist()


@pytest.fixture(scope="module")
def questions(spark):
    asked = ["common", "kona law", "konase mulndo common", "قانون ماده", "kona, retase & mul12", "no such word here", "", "ona", "se 12", "Common COMMON", "İz", "straße", "ndo abc common", "konase title", "xxx"]
    return spark.createDataFrame(list(enumerate(asked)), "question_id long, question string")


@pytest.fixture(scope="module")
def stored(spark, texts, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("texts"))
    for generation, part in enumerate(("id < 500", "id >= 500")):
        text_index.index_texts(texts.filter(part), f"{path}/texts", F.col("content"), generation)
        text_index.index_words(texts.filter(part), f"{path}/words", generation)
    return path


def listed(found):
    return sorted((r.question_id, r.rank, r.id) for r in found.collect())


@pytest.mark.parametrize("limit", [3, 30])
def test_index_gives_the_rows_of_the_scan(texts, questions, stored, limit, monkeypatch):
    monkeypatch.setattr(text_index, "HEAD", 2)
    want = listed(retrieval.fts_all_terms(questions, texts, F.col("content"), limit))
    assert listed(text_index.all_terms(questions, f"{stored}/texts", limit)) == want and {q for q, _, _ in want} >= {0, 2, 3, 9, 11}
    want = listed(retrieval.any_term(questions, texts, limit))
    assert listed(text_index.any_term(questions, f"{stored}/words", limit)) == want and {q for q, _, _ in want} >= {0, 1, 7, 13}


def test_blocks_are_in_order_and_a_common_token_lies_in_many(spark, stored):
    blocks = spark.read.parquet(f"{stored}/texts/blocks").filter("token = 'common'").collect()
    assert sum(b.n for b in blocks) == 900 and len(blocks) >= 900 / text_index.BLOCK
    for b in blocks:
        assert [tuple(p) for p in b.postings] == sorted(tuple(p) for p in b.postings) and tuple(b.low) == tuple(b.postings[0]) and tuple(b.high) == tuple(b.postings[-1])


def test_a_question_reads_the_buckets_of_its_words(spark, questions, stored):
    blocks = spark.read.parquet(f"{stored}/texts/blocks")
    terms = text_index.materialize(questions.filter("question_id = 1").selectExpr("question_id", "explode(split(question, ' ')) as token"))
    plan = text_index._asked(blocks, terms)._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan


def test_index_of_no_rows(spark, texts, questions, tmp_path):
    text_index.index_texts(texts.limit(0), f"{tmp_path}/t", F.col("content"))
    text_index.index_words(texts.filter("id = 902").withColumn("source_title", F.lit(None).cast("string")), f"{tmp_path}/w")
    assert text_index.all_terms(questions, f"{tmp_path}/t").count() == 0 and text_index.any_term(questions, f"{tmp_path}/w").count() == 0
    assert text_index.all_terms(questions, f"{tmp_path}/nowhere").count() == 0

import importlib

import corpus_pipeline
from lexloom.llm import queries


def test_every_operator_is_registered():
    names = list(queries.QUERIES)
    assert [int(n[2:].split("_")[0]) for n in names if n.startswith("op")] == list(range(1, 13)) and "pipeline" in names
    assert set(queries.ORACLE_SQL) <= set(names)
    entry = importlib.import_module("__spark_entry__")
    assert set(names) <= set(entry.queries())


def test_stages(spark, corpus, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(corpus[25][1].split()[10:60]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    frame, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    assert len(corpus_pipeline.STAGES) == 5
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, frame, str(tmp_path))
        assert out.schema.names == frame.schema.names, name
        out.write.parquet(f"{tmp_path}/{name}")
        frame = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append([r.doc_id for r in frame.collect()])
    # document 9 repeats the second text of id 8
    language, near, repeats, leaks = kept
    assert not {400, 401, 402, 405} & set(language) and set(range(30)) <= set(language) and {403, 404, 500, 501, 502} <= set(language)
    assert set(range(30)) - {9} <= set(near) and not set(range(200, 206)) & set(near)
    assert repeats == near or sorted(map(str, repeats)) == sorted(map(str, near))
    assert set(repeats) - set(leaks) == {25}
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {p.doc_id for p in pieces} == set(leaks)


def brute_near_copies(rows, similarity=0.8):
    """The rows that stay: the first of each group that exact similarities of five-word shingles join; rows in order."""
    sets = []
    for _, text, _ in rows:
        words = (text or "").lower().split()
        sets.append({" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    root = list(range(len(rows)))

    def find(i):
        return i if root[i] == i else find(root[i])

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= similarity:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [row for i, row in enumerate(rows) if find(i) == i]


def test_each_stage_equals_brute_force(spark, corpus, docs, tmp_path):
    from pyspark.sql import functions as F

    from lexloom.llm import common, substring_dedup
    from tests.llm.test_dedup import brute_op3
    from tests.llm.test_operators import brute_contaminated

    docs.write.parquet(f"{tmp_path}/documents.parquet")
    items = [(1, " ".join(corpus[25][1].split()[10:60])), (2, " ".join(corpus[-1][1].split()[20_000:20_040])), (None, "a b c d e f"), (3, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    ordered = lambda frame: sorted((r[0], r[1], r[2]) for r in frame.select(F.coalesce("doc_id", F.lit(common.NO_ID)), F.coalesce("text", F.lit("")), common.keyed(frame)[1]).collect())
    by_key = lambda rows: sorted(rows, key=lambda x: (x[0], x[2]))
    given = ordered(frame)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, frame, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        if name == "packing":
            want = [(common.NO_ID if d is None else d, n) for d, n in ((r.doc_id, len(corpus_pipeline.packing.encoder(corpus_pipeline.public_tokenizers.path("byte_bpe_50k.json"), None)(r.text or "")) + 1) for r in frame.collect())]
            pieces = out.collect()
            assert sorted((common.NO_ID if x.doc_id is None else x.doc_id, x.doc_tokens) for x in pieces if x.start == 0) == sorted(want)
            assert sorted(1024 * x.sequence_id + x.offset for x in pieces) == sorted(set(1024 * x.sequence_id + x.offset for x in pieces)) and sum(x.length for x in pieces) == sum(n for _, n in want)
            break
        kept = ordered(out)
        if name == "language_id":
            assert kept == [x for x in given if any(map(str.isalpha, x[1]))]
        elif name == "simhash_near_dedup":
            assert kept == sorted(brute_near_copies(by_key(given))) and len(kept) < len(given) - 10
        elif name == "substring_dedup":
            told = brute_op3([(d, t) for d, t, _ in by_key(given)], substring_dedup.Chunker())
            assert sorted((d, len(t.encode())) for d, t, _ in kept if d != 501) == sorted((d, told[d, t][0] - told[d, t][1]) for d, t, _ in given if d != 501)
        else:
            bad = {d for d, _ in brute_contaminated([(d, t) for d, t, _ in given], items)}
            assert kept == [x for x in given if x[0] not in bad] and len(bad) == 2
        frame, given = out, kept


def test_stages_without_languages_or_rows(spark, docs, empty, tmp_path):
    from pyspark.sql import functions as F

    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    nothing = docs.withColumn("lang", F.lit(None).cast("string"))
    kept = corpus_pipeline.identify_language(spark, nothing, str(tmp_path))
    assert kept.count() == docs.filter(F.col("text").rlike(r"\p{L}")).count() > 60
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0

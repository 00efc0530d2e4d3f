import datetime as dt
import gzip
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from lexloom import api, schemas
from lexloom.operators import citations, classify, corpus, crawl, retrieval, state
from lexloom.sources import models, readers, sinks
from lexloom.streaming import jobs

ROW = "question_id int, question string, id string, content string, source_type string, source_title string, article_number string, source_url string, semantic double, match_kind string, pos int"


def ranked(spark, rows, question="ماده 10 قانون مدنی"):
    data = [(1, question, i, c, "statute", t, a, None, s, k, p) for p, (i, c, t, a, s, k) in enumerate(rows)]
    return [r.id for r in retrieval.rank(spark.createDataFrame(data, ROW)).orderBy("rank").collect()]


def test_rank_prefers_the_law_asked_for(spark):
    rows = [("a", "متن", "قانون تجارت", "10", 0.9, "exact_article"), ("b", "متن", "قانون مدنی", "10", 0.1, "exact_article"), ("c", "متن", "قانون مدنی", "11", 0.0, "vector")]
    assert ranked(spark, rows) == ["b", "c"]
    rows[0] = ("a", "متن", "قانون تجارت", "1234567", 0.9, "vector")
    assert ranked(spark, rows) == ["b", "a", "c"]


def test_rank_keeps_the_first_of_ties_at_its_place(spark):
    rows = [("a", "x", "t", None, 0.2, "fts"), ("b", "x", "t", None, 0.2, "fts"), ("a", "x", "t", None, 0.2, "vector")]
    assert ranked(spark, rows, "سوال") == ["a", "b"]
    rows[2] = ("a", "x", "t", None, 0.9, "vector")
    assert ranked(spark, rows, "سوال") == ["a", "b"]


CHUNK = [
    ("1", "ماده 10 قراردادهای خصوصی نافذ است", [1.0] + [0.0] * 11, "statute", "قانون مدنی", "10", "https://x.y/1"),
    ("2", "ماده 10 تاجر کسی است", [0.0, 1.0] + [0.0] * 10, "statute", "قانون تجارت", "10", None),
    ("3", "قراردادهای خصوصی در رأی", [0.9, 0.1] + [0.0] * 10, "case_law", "رأی", None, "file"),
]


def test_ask_from_question_to_audit(spark):
    chunks = spark.createDataFrame(CHUNK, "id string, content string, embedding array<double>, source_type string, source_title string, article_number string, source_url string")
    questions = spark.createDataFrame([(1, "ماده 10 قانون مدنی", [1.0] + [0.0] * 11), (2, "قراردادهای خصوصی", [0.0, 1.0] + [0.0] * 10)], "question_id int, question string, vector array<double>")
    told = api.ask(questions, chunks, F.lit("2024-01-01").cast("timestamp"), lambda r: r.groupBy("question_id").agg(F.lit("ماده 10 و ماده 99").alias("answer")))
    sources = {(r.question_id, r["rank"]): (r.id, r.match_kind) for r in told.sources.collect()}
    assert sources[1, 1] == ("1", "exact_article") and ("2", "exact_article") not in [v for k, v in sources.items() if k[0] == 1]
    assert sources[2, 1] == ("2", "vector") and {sources[2, 2], sources[2, 3]} == {("1", "fts"), ("3", "vector")}
    evaluation = {r.question_id: r for r in told.evaluation.collect()}
    assert (evaluation[1].cited, evaluation[1].verified, evaluation[1].unverified) == (2, 1, 1)
    cites = {(r.question_id, r.id): r for r in told.citations.collect()}
    assert cites[1, "1"].source_url == "https://x.y/1" and cites[1, "1"].verified and cites[1, "3"].source_url is None
    audit = told.audit.filter("question_id = 1").first()
    assert audit.retrieved_ids[0] == "1" and [c.number for c in audit.unverified] == ["99"]
    assert api.ask(questions.drop("vector"), chunks, F.lit(None).cast("timestamp")).sources.count() >= 2


def test_any_word_and_the_fallback(spark):
    rows = [(f"{i:03d}", f"text {i} {'alpha' if i % 2 else 'Beta'} {'gamma' if i == 99 else ''}", None, "statute", "Delta" if i == 98 else "t", None, None) for i in range(100)]
    chunks = spark.createDataFrame(rows, "id string, content string, embedding array<double>, source_type string, source_title string, article_number string, source_url string").repartition(4)
    asked = [(1, "ALPHA?"), (2, "bet, gamma"), (3, "delta of xx"), (4, "zz"), (5, None), (6, "one two three four five beta")]
    questions = spark.createDataFrame(asked, "question_id int, question string")
    found = retrieval.any_term(questions, chunks).orderBy("question_id", "rank").collect()
    want = {1: [r[0] for r in rows if "alpha" in r[1]][:30], 2: [r[0] for r in rows if "Beta" in r[1] or "gamma" in r[1]][:30], 3: ["098"]}
    assert {q: [r.id for r in found if r.question_id == q] for q in {r.question_id for r in found}} == want
    told = {(r.question_id, r.id) for r in retrieval.retrieve(questions, chunks).collect()}
    assert {i for q, i in told if q == 2} <= set(want[2]) and {i for q, i in told if q == 3} == {"098"}
    assert retrieval.any_term(questions.limit(0), chunks).count() == 0


def test_nearest_in_blocks_of_questions(spark, monkeypatch):
    import random

    rng = random.Random(5)
    rows = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(16)]) for i in range(60)], "id int, embedding array<double>")
    asked = rows.select(F.col("id").alias("question_id"), F.col("embedding").alias("vector"))
    one = {tuple(r) for r in retrieval.nearest_by_cosine(asked, rows, 5).collect()}
    monkeypatch.setattr(retrieval, "BROADCAST_QUESTIONS", 7)
    assert {tuple(r) for r in retrieval.nearest_by_cosine(asked, rows, 5).collect()} == one and len(one) == 300


def test_tiers_and_states(spark):
    rows = spark.createDataFrame([(1, None), (2, "DE"), (3, "FR")], "id int, country string")
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(retrieval.tri_state(rows, "country", False)) == [1, 2, 3] and ids(retrieval.tri_state(rows, "country", True)) == [1] and ids(retrieval.tri_state(rows, "country", True, "DE")) == [2]
    assert ids(retrieval.optional_equal(rows, "country", "all")) == [1, 2, 3]


def test_bounded_rerank_and_residency(spark):
    chunks = spark.createDataFrame([(i, "hit" if i % 3 == 0 else "no", [float(i % 5)] + [1.0] * 11) for i in range(40)], "id int, content string, embedding array<double>")
    found = retrieval.bounded_rerank(1, chunks, [1.0] + [0.0] * 11, F.col("content") == "hit", 5, 9, 4)
    assert {r.id for r in found.collect()} <= {0, 3, 6, 9, 12, 1, 2, 4, 5} and found.count() == 4
    docs = chunks.withColumns({"jurisdiction": F.lit("EU"), "country": F.when(F.col("id") % 2 == 0, "DE")})
    phrases = spark.createDataFrame([(1, 1, [1.0] + [0.0] * 11), (1, 2, [0.0] + [1.0] * 11)], "request_id int, phrase_id int, vector array<double>")
    rows = api.residency_search(phrases, docs, "EU", True, "DE").collect()
    assert len(rows) == 10 and all(r.id % 2 == 0 for r in rows) and len({r.id for r in rows}) == 10


def test_gates_conserve_rows(spark):
    rows = spark.createDataFrame([(i, "w " * i) for i in range(0, 1000, 10)], "id int, t string")
    reason = corpus.first_failing(corpus.size_gate(F.size(F.split(F.trim("t"), " ")), F.length("t")))
    counts = {r.reason: r.n for r in corpus.histogram(rows.select(reason.alias("reason"))).collect()}
    assert sum(counts.values()) == 100 and counts["selected"] > 0


def test_duplicates(spark):
    rows = spark.createDataFrame([("a", "xx", 1), ("a", "yyy", 2), ("a", "zzz", 3), ("b", "q", 4), (None, "n", 5), ("", "n", 6)], "key string, content string, seq int")
    assert {(r.key, r.content) for r in corpus.longest_per_key(rows, "key", "content", "seq").collect()} == {("a", "zzz"), ("b", "q")}
    assert {(r.key, r.content) for r in corpus.longest_per_key(rows, "key", "content", "seq", False).collect()} == {("a", "yyy"), ("b", "q")}


def test_interleave_sample_admit(spark):
    rows = spark.createDataFrame([(i, "ab"[i % 2] if i < 6 else "a") for i in range(10)], "seq int, g string")
    order = [r.seq for r in corpus.interleave(rows, "g", "seq", 5).orderBy("place").collect()]
    assert order == [0, 1, 2, 3, 4]
    sample = corpus.systematic_sample(spark.range(100).select(F.col("id").alias("seq"), (F.col("id") % 2).alias("s")), "s", "seq", 10)
    assert sorted(r.seq for r in sample.filter("s = 0").collect()) == [0, 20, 40, 60, 80]
    docs = spark.createDataFrame([(i, i % 9, 100 - i, 10) for i in range(60)], "id int, rank int, size int, chunks int")
    admitted = {r.id for r in corpus.admit(docs, "rank", "size", "chunks", "id", 100).collect()}
    assert admitted == {i for i in range(60) if i % 9 < 5}
    before = {r.id: r.before for r in corpus.running_before(docs, [F.col("rank"), F.desc("size"), F.col("id")], "chunks").collect()}
    assert [before[i] for i in sorted(range(60), key=lambda i: (i % 9, -(100 - i), i))] == list(range(0, 600, 10))


def test_pins_names_pages_lexicon(spark):
    pool = spark.createDataFrame([(i, f"t{i}") for i in range(5)], "id int, t string")
    assert {(r.id, r.pinned) for r in corpus.with_pins(pool.filter("id = 1"), pool, F.col("id") < 3, F.col("t")).collect()} == {(1, False), (0, True), (2, True)}
    names = corpus.nearest_name(spark.createDataFrame([("law",)], "name string"), spark.createDataFrame([("law of x",), ("a law",)], "title string"))
    assert names.first().title == "a law"
    pages = spark.createDataFrame([(1, p, f"HEAD\nbody {p}\nmore\nmid\nFOOT") for p in range(4)], "d int, p int, t string")
    assert {r.line for r in corpus.repeated_page_lines(pages, "d", "p", "t", edge=1).collect()} == {"HEAD", "FOOT"}
    assert one_label(spark, 0.9) == "healthy" and one_label(spark, 0.1) == "broken"


def one_label(spark, rate):
    return spark.range(1).select(corpus.preflight_class(F.lit(rate), [(0.35, "healthy"), (0.0, "broken")]).alias("x")).first().x


def test_rate_limit_at_its_edge(spark):
    start = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([(i, "k", start + dt.timedelta(seconds=i)) for i in range(21)] + [(21, "k", start + dt.timedelta(seconds=60))], "id int, key string, ts timestamp")
    found = {r.id: r for r in state.rate_limit(rows, "key", "ts", "id", 60, 20).collect()}
    assert all(found[i].allowed for i in range(20)) and not found[20].allowed and found[21].allowed and found[21].reset_in == 60


def test_state_tables(spark):
    table = spark.createDataFrame([("a", "1", "s"), ("b", "2", "s")], "id string, content string, source string")
    new = spark.createDataFrame([("b", "9", "n"), ("c", "3", "n"), ("c", "4", "n")], "id string, content string, source string")
    assert {tuple(r) for r in state.insert_ignore(table, new, "id").collect()} == {("a", "1", "s"), ("b", "2", "s"), ("c", "3", "n")}
    assert {tuple(r) for r in state.upsert(table, new.filter("content != '4'"), "id", ["content"]).collect()} == {("a", "1", "s"), ("b", "9", "s"), ("c", "3", "n")}
    assert {tuple(r) for r in state.scoped_replace(table, new.filter("id = 'b'"), ["id"]).collect()} == {("a", "1", "s"), ("b", "9", "n")}


def test_crawl(spark):
    html = "<html><head><title> T </title><script>var a</script></head><body><nav>N <a href='/no'>x</a></nav><p>A  b</p>\n\n\n\n<a href='/x#f'>L</a><a href='mailto:a'>M</a><footer>F</footer></body></html>"
    assert crawl.parse_page(html) == ("T", "A b\n\nLM", ["/x#f", "mailto:a"])
    assert crawl.absolute_url("../y?q#f", "https://a.b/c/d") == "https://a.b/y?q" and crawl.absolute_url("mailto:x", "https://a.b") is None
    hosts = [("a.b", "a.b", True), ("x.A.b.", "a.b", True), ("a.b:80", "a.b", True), ("evila.b", "a.b", False), ("a.b.evil", "a.b", False), ("", "a.b", False)]
    rows = spark.createDataFrame(hosts, "h string, a string, want boolean").select(crawl.host_allowed(F.col("h"), F.col("a")).alias("x"), "want").collect()
    assert all(r.x == r.want for r in rows)
    robots = spark.createDataFrame([("a.b", "User-agent: *\nDisallow: /\n\nUser-agent: TestBot # own\nDisallow: /p\nAllow: /p/q\nCrawl-delay: 5")], "host string, body string")
    urls = spark.createDataFrame([("https://a.b/x",), ("https://a.b/p/1",), ("https://a.b/p/q/1",), ("https://c.d/",)], "url string")
    allowed = lambda agent: {r.url: r.allowed for r in crawl.robots_allowed(urls, crawl.robots_rules(robots, agent)).collect()}
    assert allowed("TestBot/1.0") == {"https://a.b/x": False, "https://a.b/p/1": False, "https://a.b/p/q/1": True, "https://c.d/": True}
    assert not allowed("other")["https://a.b/x"]
    pages = spark.createDataFrame([("s", ["https://a.b/1", "https://a.b/2", "https://e.f/3"])], "source_id string, links array<string>")
    found = crawl.discovered(pages, spark.createDataFrame([("https://a.b/1",)], "url string"), spark.createDataFrame([("s", "a.b")], "source_id string, allowed_host string"))
    assert [r.url for r in found.collect()] == ["https://a.b/2"]
    fetched = spark.createDataFrame([(str(i), False, False, True, None, None, i) for i in range(3)], "url string, ok boolean, is_html boolean, allowed boolean, text string, old_hash string, attempts int")
    assert {r.url: r.status for r in crawl.outcome(fetched).collect()} == {"0": "pending", "1": "pending", "2": "failed"}
    assert crawl.page_chunks(spark.createDataFrame([("u", "x" * 1200)], "url string, text string")).count() == 2


def get(url):
    if "down" in url:
        raise TimeoutError
    return (404 if "none" in url else 200), ("text/plain" if "txt" in url else "text/html; charset=utf-8"), b"<p>x</p>"


def test_fetch(spark):
    urls = spark.createDataFrame([("a",), ("a.txt",), ("none",), ("down",)], "url string")
    found = {r.url: (r.ok, r.is_html, r.html) for r in crawl.fetched(urls, get).collect()}
    assert found == {"a": (True, True, "<p>x</p>"), "a.txt": (True, False, None), "none": (False, True, None), "down": (False, False, None)}


def test_queue_and_requeue(spark):
    now = dt.datetime(2024, 1, 10)
    rows = [(f"u{i}", "s", "done" if i < 5 else "pending", now - dt.timedelta(hours=20 + 2 * i), now) for i in range(8)]
    frontier = spark.createDataFrame(rows, "url string, source_id string, status string, last_crawled_at timestamp, discovered_at timestamp")
    again = crawl.requeue_stale(frontier, F.lit(now), 1)
    assert sorted(r.url for r in again.filter("status = 'pending'").collect()) == ["u4", "u5", "u6", "u7"]
    assert [r.url for r in crawl.take_pending(again, 2).collect()] == ["u4", "u5"]


def test_coverage_and_lists(spark):
    rows = spark.createDataFrame([(1, "Law(1).pdf"), (2, "law.pdf"), (3, "b.pdf")], "id int, source_file string")
    sources = spark.createDataFrame([("Law(1).pdf", 3), ("law.pdf", 5), ("b.pdf", 1)], "source_file string, chunks int")
    assert sorted(r.id for r in corpus.best_files(rows, sources).collect()) == [2, 3]
    found = corpus.coverage(rows, spark.createDataFrame([(1, "x"), (2, None)], "id int, title string"), "id", ["title"]).first()
    assert tuple(found) == (3, 2, 1)


FORMS = [("claim-money", 0, "civil"), ("fraud-complaint", 1, "criminal"), ("civil-appeal", 2, "civil"), ("criminal-appeal", 3, "criminal"), ("damages", 4, "civil")]


def test_classify(spark):
    stories = [(1, "مواد مخدر", "damages", False), (2, "متن", "damages", False), (3, "دادنامه خسارت", None, False), (4, "هیچ", None, False), (5, "سرقت شد", None, False), (6, "خسارت خسارت", None, False), (7, "کلاهبرداری", None, False)]
    rows = spark.createDataFrame(stories, "story_id int, story string, form_id string, has_judgment boolean")
    forms = spark.createDataFrame(FORMS, "form_id string, place int, track string")
    keywords = spark.createDataFrame([("damages", "خسارت")], "form_id string, keyword string")
    boosts = spark.createDataFrame([("fraud-complaint", "کلاهبردار", 6), ("damages", "خسارت", 4)], "form_id string, pattern string, weight int")
    found = {r.story_id: (r.form_id, r.confidence, r.refused) for r in classify.classify(rows, forms, keywords, boosts).collect()}
    assert found == {1: ("claim-money", "none", True), 2: ("damages", "high", False), 3: ("civil-appeal", "high", False), 4: ("claim-money", "medium", False), 5: ("fraud-complaint", "medium", False), 6: ("damages", "medium", False), 7: ("fraud-complaint", "high", False)}
    steps = spark.createDataFrame([(1, None, "damages", None, "s1"), (2, "civil", None, None, "s2"), (3, None, None, None, "s3")], "place int, track string, form_id string, has_judgment boolean, steps string")
    told = {r.story_id: r.steps for r in classify.procedure(classify.classify(rows, forms, keywords, boosts), forms, steps).collect()}
    assert told[2] == "s1" and told[4] == "s2" and told[7] == "s3"
    drafts = api.draft(rows.withColumn("answers", F.create_map(F.lit("a"), F.lit("v"))), forms.withColumn("template", F.lit("x {{a}}")), keywords, boosts)
    assert {r.story_id: r.draft for r in drafts.collect()}[2] == "x v" and {r.story_id: r.draft for r in drafts.collect()}[1] is None


def workbook(rows):
    cells = "".join("<row>" + "".join(f'<c r="{chr(65 + j)}{i + 1}" t="inlineStr"><is><t>{v}</t></is></c>' for j, v in enumerate(r) if v is not None) + "</row>" for i, r in enumerate(rows))
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("xl/workbook.xml", "<w/>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{cells}</sheetData></worksheet>')
    return data.getvalue()


def test_readers(spark, tmp_path):
    (tmp_path / "seed.json").write_text(json.dumps({"model": "m", "dim": 2, "chunks": [{"id": "1", "content": "x", "embedding": [0.5, 1]}, {"id": "2"}]}))
    assert [(r.dim, r.id) for r in readers.seed(spark, str(tmp_path / "seed.json")).orderBy("id").collect()] == [(2, "1"), (2, "2")]
    with gzip.open(tmp_path / "a.jsonl.gz", "wt") as f:
        f.write('{"id":"1","content":"x"}\n\nnot json\n{"id":"2"}\n')
    assert readers.jsonl(spark, str(tmp_path / "a.jsonl.gz"), partitions=2).count() == 2
    (tmp_path / "export.json").write_text(json.dumps([{"url": "", "crawl": {"loadedUrl": "u"}, "markdown": "ab", "text": "cd"}, {"url": "v", "markdown": "", "text": "longer"}]))
    assert {(r.url, r.body) for r in readers.crawl_export(spark, str(tmp_path / "export.json")).collect()} == {("u", "ab"), ("v", "longer")}
    (tmp_path / "laws.json").write_text(json.dumps({"laws": [{"law_title": "L", "category": "C", "articles": [{"item_id": 1, "content": "x", "article_label": "12 bis"}]}]}))
    (tmp_path / "terms.json").write_text(json.dumps({"terms": [{"term_id": 1, "word": "w", "content": "c", "letter": "l"}]}))
    rows = {r.raw_id: r for r in readers.banks(spark, {"laws": str(tmp_path / "laws.json"), "terms": str(tmp_path / "terms.json")}).collect()}
    assert (rows["law:1"].source_title, rows["law:1"].article_number, rows["term:1"].content) == ("L — C", "12", "w: c")
    (tmp_path / "books").mkdir()
    book = workbook([["id", "h"], ["1", "x" * 80, None, "t"], ["2", "short"]])
    (tmp_path / "books/a.xlsx").write_bytes(book)
    with zipfile.ZipFile(tmp_path / "books/b.zip", "w") as z:
        z.writestr("in/c.xlsx", book)
    sheet = readers.spreadsheet(spark, str(tmp_path / "books"), {"id": 0, "content": 1, "title": 3}).collect()
    assert [(r.id, r.title) for r in sheet] == [("1", "t")] * 2
    (tmp_path / "pdf").mkdir()
    (tmp_path / "pdf/x.pdf").write_bytes(b"one|two")
    pages = readers.pdf(spark, str(tmp_path / "pdf"), lambda data: ("T", [*data.decode().split("|"), None]))
    assert pages.first().text == "one\ntwo"
    paged = readers.paged(spark, "d", [0, 10], 3, "tests.test_operators", "fetch", "i long, s string")
    assert paged.count() == 6
    assert readers.sql(spark, "select * from {t} where id > ?", 1, t=spark.range(4)).count() == 2


def fetch(dataset, offset, length):
    return [(offset + i, dataset) for i in range(length)]


def test_models_and_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x"), ("b", "y")], "id string, content string")
    cache = spark.createDataFrame([("a", [9.0, 9.0])], "id string, embedding array<double>")
    found = {r.id: r.embedding for r in models.embed_missing(rows, cache, "id", F.col("content"), lambda ts: [[3.0, 4.0] for _ in ts], 2).collect()}
    assert found == {"a": [9.0, 9.0], "b": [0.6, 0.8]}
    assert spark.range(1).select(models.pooled(F.array(F.array(F.lit(1.0), F.lit(3.0)), F.array(F.lit(3.0), F.lit(5.0))), 2).alias("v")).first().v == [2.0, 4.0]
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return "ok"

    assert models.with_retries(flaky, 3, 0)() == "ok"
    path = str(tmp_path / "t")
    sinks.append(rows, path)
    sinks.insert_ignore(spark.createDataFrame([("b", "no"), ("c", "z")], rows.schema), path, "id")
    sinks.upsert(spark.createDataFrame([("a", "new")], rows.schema), path, "id", ["content"])
    assert {tuple(r) for r in spark.read.parquet(path).collect()} == {("a", "new"), ("b", "y"), ("c", "z")}
    twice = state.upsert(spark.read.parquet(path), spark.createDataFrame([("a", "1"), ("a", "2"), ("d", "3"), ("d", None)], rows.schema), "id", ["content"])
    assert {tuple(r) for r in twice.collect()} == {("a", "2"), ("b", "y"), ("c", "z"), ("d", "3")} and twice.count() == 4
    sinks.scoped_replace(spark.createDataFrame([("a", "again")], rows.schema), path, ["id"])
    assert spark.read.parquet(path).filter("content = 'again'").count() == 1
    sinks.json_files(rows, str(tmp_path / "j"), "gzip")
    assert readers.jsonl(spark, str(tmp_path / "j")).count() == 2
    merged = sinks.merge_sources([rows, spark.createDataFrame([("c", "q")], rows.schema)], spark.createDataFrame([("a", "old")], rows.schema))
    assert {r.id: r.content for r in merged.collect()} == {"a": "old", "b": "y", "c": "q"}
    stored = sinks.stored_chunks(rows.withColumn("helper", F.lit(1)), ["id", "content", "law_date"], 1)
    assert stored.columns == ["id", "content", "law_date"]
    tokens = sinks.with_search_tokens(spark.createDataFrame([("T", "5", "A b")], "source_title string, article_number string, content string")).first().tokens
    assert set(tokens) == {"t", "5", "a", "b"}


def test_a_swap_whose_rename_fails_keeps_the_table(spark, tmp_path):
    path = tmp_path / "t"
    spark.range(3).write.parquet(str(path))
    fresh = spark.range(5)
    moved = []
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(str(path)).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    class Failing:  # the second rename, of the new table to its place, is refused
        def rename(self, a, b):
            moved.append((a.getName(), b.getName()))
            return False if a.getName().endswith(".new") else hadoop.rename(a, b)

        def __getattr__(self, name):
            return getattr(hadoop, name)

    with pytest.raises(OSError, match="could not be renamed"):
        sinks.swap_in(Failing(), spark, fresh, str(path))
    assert spark.read.parquet(str(path)).count() == 3 and len(moved) == 3
    sinks.swap(fresh, str(path))
    assert spark.read.parquet(str(path)).count() == 5 and [p.name for p in tmp_path.iterdir() if p.name.endswith(".old")] == []


def test_migrations(spark):
    spark.sql("create database if not exists lex")
    made = schemas.create_tables(spark, "lex")
    assert set(made) == set(schemas.TABLES) and schemas.create_tables(spark, "lex") == []


def test_streams(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([(i, "k", start + dt.timedelta(seconds=i)) for i in range(5)], "id int, user string, ts timestamp")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = jobs.decide(stream, "user", "ts", 60, 3).writeStream.format("memory").queryName("decisions").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r.hits, r.allowed) for r in spark.table("decisions").orderBy("hits").collect()] == [(1, True), (2, True), (3, True), (4, False), (5, False)]
    for _ in range(2):
        jobs.load_once(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), "id", str(tmp_path / "c2")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5
    seen = []
    jobs.micro_batches(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), lambda b, i: seen.append(b.count()), str(tmp_path / "c3")).awaitTermination(120)
    assert sum(seen) == 5
    pieces = spark.createDataFrame([("s", 1, 'data: {"type":"c"}\nda'), ("s", 2, "ta: [DONE]\n\n")], "s string, i int, p string")
    lines = jobs.events_of(jobs.reassemble_lines(pieces, "s", "i", "p")).collect()
    assert [r.event for r in lines] == ["c"]
    counted = jobs.window_hits(rows, "user", "ts", 60)
    assert counted.first().hits == 5


def test_excerpts_and_prompts(spark):
    files = spark.createDataFrame([("u", 1, "f", "alpha one\n\nbeta\n\nalpha two", 2), ("u", 2, "g", "alpha three", 1)], "user_id string, file_id int, filename string, content string, created_at int")
    rows = retrieval.excerpts(F.lit("alpha"), files, 12).orderBy("file_id", "place").collect()
    assert [r.excerpt for r in rows] == ["alpha one", "alp"]
    source = spark.createDataFrame([(1, 1, "T", "5", "content here")], "question_id int, rank int, source_title string, article_number string, content string")
    assert citations.source_lines(source).first().sources == "[1] T — 5\ncontent here"


def test_x39_anonymises_whole_texts_of_all_turns(spark, tmp_path):
    from lexloom.plans import catalogue

    rows = [(c, t, "user", "word " * 40 + f"and Name{c} left") for c in (1, 2) for t in range(5)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    found = catalogue.QUERIES["x39_anonymise"](spark, str(tmp_path)).collect()
    assert sorted((r.conv_id, r.turn) for r in found) == [r[:2] for r in rows]
    for r in found:
        text = json.loads(r.content)["description"]
        assert text.count("word") == 40 and text.endswith("left") and f"Name{r.conv_id}" not in text


def test_rules_in_one_pass_equal_rules_one_by_one(spark):
    import random

    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdeکلم") for _ in range(rng.randint(1, 5)))
    stories = [(i, " ".join(word() for _ in range(rng.randint(0, 80))) if i else None) for i in range(200)]
    keywords = [(f"f{i % 5}", word()) for i in range(60)] + [("f1", None), ("f1", "a b")]
    boosts = [("f0", "ab|cd", 2), ("f1", "a.?b+c", 3), ("f2", "(ab|ce)d", 4), ("f3", "^b", 5), ("f4", r"\bab\b", 6), ("f0", "[ab]c", 7), ("f1", "(?i)AB", 8), ("f2", "abc?d", 9), ("f3", "ab{0,2}e", 10), ("f4", "کل*م", 11), ("f0", "ab(", 0)][:-1]
    rows = spark.createDataFrame(stories, "story_id int, story string")
    k, b = spark.createDataFrame(keywords, "form_id string, keyword string"), spark.createDataFrame(boosts, "form_id string, pattern string, weight int")
    one_pass = {tuple(r) for r in classify.scores(rows, k, b).collect()}
    kept, classify.MAX_RULES = classify.MAX_RULES, 1
    try:
        assert one_pass == {tuple(r) for r in classify.scores(rows, k, b).collect()}
    finally:
        classify.MAX_RULES = kept
    plan = classify.scores(rows, k, b)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize(("pattern", "strings"), [("abc", ["abc"]), ("ab|cde", ["ab", "cde"]), ("tra.?sh", ["tra"]), ("abc?d", ["ab"]), ("a|bc", None), ("x*", None), ("ab(c|d)", None), ("abc[de]fgh", ["abc"]), (r"\bab", None), ("ab{0}cd", None), ("", None)])
def test_required_strings(pattern, strings):
    assert classify.required(pattern) == strings


def test_time_does_not_follow_the_number_of_rules(spark):
    import time

    rows = spark.range(300).select(F.col("id").alias("story_id"), F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(400)), lambda i: F.substring(F.md5((F.col("id") * 1000 + i).cast("string")), 1, 6))).alias("story"))
    none = spark.createDataFrame([], "form_id string, pattern string, weight int")
    took = {}
    for n in (10, 10, 10_000):
        keywords = spark.range(n).select(F.lit("f").alias("form_id"), F.substring(F.md5((F.col("id") + 7).cast("string")), 1, 8).alias("keyword"))
        start = time.perf_counter()
        classify.scores(rows, keywords, none).collect()
        took[n] = time.perf_counter() - start
    assert took[10_000] < 10 * took[10] + 5


def test_containing_names(spark):
    titles = ["law of x", "a law", "law", "Straße", "ab", "b", "", None, "قانون مدنی", "law"]
    names = ["law", "a", "ab", "aw o", "ße", "مدنی", "zz", "zzz", "", None, "law of x"]
    found = corpus.containing(spark.createDataFrame([(t,) for t in titles], "t string"), "t", spark.createDataFrame([(n,) for n in names], "n string"), "n")
    assert {tuple(r) for r in found.collect()} == {(t, n) for t in titles for n in names if t is not None and n and n in t} and found.count() == found.distinct().count()
    plan = corpus.nearest_name(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(t,) for t in titles], "title string"))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_running_sums_of_a_hot_group_are_many_tasks_work(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") % 10 == 0, F.col("id") % 7).when(F.col("id") % 97 == 1, F.lit(None)).otherwise(F.lit(99)).alias("g"), ((F.col("id") * 7919) % 20_011).alias("o"), (F.col("id") % 5).alias("v"))
    found = corpus.running_before(rows, [F.col("o")], "v", "before", "g")
    sums, want = {}, set()
    for r in sorted(rows.collect(), key=lambda r: r.o):
        want.add((r.g, r.o, sums.get(r.g, 0)))
        sums[r.g] = sums.get(r.g, 0) + r.v
    assert {(r.g, r.o, r.before) for r in found.collect()} == want
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be put together again
    try:
        assert {(r.g, r.o, r.before) for r in corpus.running_before(rows, [F.col("o")], "v", "before", "g").collect()} == want
        hot = rows.filter("g = 99").repartitionByRange("g", "o").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(hot) > 1 and max(r["count"] for r in hot) < 0.6 * rows.filter("g = 99").count()


def test_first_and_last_of_short_and_long_documents(spark):
    rows = [(d, i, d % 2 == 0) for d in range(12) for i in range(d)] + [(100, i, True) for i in range(500)] + [(101, i, None) for i in range(500)]
    table = spark.createDataFrame(rows, "doc int, place int, ruling boolean")
    found = {(r.doc, r.place) for r in corpus.first_and_last(table, "doc", "place", F.col("ruling"), 4, 3).collect()}
    want = set()
    for d in {r[0] for r in rows}:
        places = sorted(i for e, i, _ in rows if e == d)
        ruling = next(r for e, _, r in rows if e == d)
        want |= {(d, p) for p in ((places if len(places) <= 3 else [places[0], *places[-2:]]) if ruling else places[:4])}
    assert corpus.first_and_last(table.withColumn("place", F.lit(1)), "doc", "place", F.col("ruling"), 4, 3).count() == len(want)  # nothing but ties
    assert found == want and corpus.first_and_last(table, "doc", "place", F.col("ruling"), 4, 3).count() == len(want)


def test_bounded_rerank_of_a_batch(spark):
    rows = [(i, [float((i * 7 + j) % 11 - 5) for j in range(12)], "t", "holds needle" if i % 3 == 0 else "hay") for i in range(90)]
    chunks = spark.createDataFrame([*rows, (500, None, "t", "needle")], "id long, embedding array<double>, source_title string, content string")
    asked = [(1, "needle", rows[4][1]), (2, "nothing here", rows[9][1]), (3, "", rows[2][1])]
    found = retrieval.bounded_rerank_all(spark.createDataFrame(asked, "question_id long, question string, vector array<double>"), chunks, pool=10, total=25, limit=5)
    cos = lambda a, b: round(sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5, 6)
    for q, words, v in asked:
        hits = [r for r in rows if words == "needle" and "needle" in r[3]][:10]
        pool = (hits + [r for r in rows if r not in hits])[:25]
        want = sorted((-cos(r[1], v), r[0]) for r in pool)[:5]
        assert sorted((-r.semantic, r.id) for r in found.filter(f"question_id = {q}").collect()) == want

"""The jobs over growing copies of small inputs: two runs, killed runs, and the command line."""

import logging
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from jobs import ingest_documents, refresh_pages

LONG = "Every article of this law holds for all offices and courts of the country. " * 4


def write(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def taken(chunks):
    return sorted((r.doc_id, r.place, r.lang, r.content) for r in chunks.collect())


def test_ingest_takes_only_what_is_new(spark, tmp_path, caplog):
    source, target, checkpoint = (str(tmp_path / n) for n in ("raw", "corpus", "checkpoint"))
    schema = "doc_id long, text string, lang string, source string, extra int"
    first = [(1, LONG + "one", "en", "a", 0), (2, None, "en", "a", 0), (3, "short", "fr", "a", 0), (None, LONG, "fr", "a", 0), (4, LONG + "  one", "en", "b", 0), (5, LONG + "five", None, None, 0), (5, LONG + "five again", " ", "c", 0), (6, "x" * 2500, "de", "b", 0)]
    write(spark, first, schema, source)
    with caplog.at_level(logging.INFO):
        chunks = ingest_documents.ingest(spark, source, target, checkpoint)
    once = taken(chunks)
    assert [r[:3] for r in once] == [(1, 0, "en"), (5, 0, "unknown"), (6, 0, "de"), (6, 1, "de"), (6, 2, "de")]
    assert [len(r[3]) for r in once[2:]] == [1100, 1100, 600]
    assert "read 8 rows" in caplog.text and "'duplicate': 2" in caplog.text and "'short': 2" in caplog.text

    assert taken(ingest_documents.ingest(spark, source, target, checkpoint)) == once  # nothing new

    write(spark, [(7, LONG + "seven", "en", "a", 0), (8, LONG + "one ", "en", "a", 0), (1, LONG + "other text under a known id", "en", "a", 0)], schema, source)
    grown = taken(ingest_documents.ingest(spark, source, target, checkpoint))
    assert [r for r in grown if r[0] != 7] == once and [r[:3] for r in grown if r[0] == 7] == [(7, 0, "en")]
    report = {(r.batch, r.reason): r.n for r in spark.read.schema(ingest_documents.REPORT).parquet(f"{target}/report").collect()}
    assert report == {(0, "no_id"): 1, (0, "short"): 2, (0, "duplicate"): 2, (0, "accepted"): 3, (1, "duplicate"): 2, (1, "accepted"): 1}


def test_a_batch_that_comes_again_gives_the_same(spark, tmp_path):
    target = str(tmp_path / "corpus")
    batches = [[(1, LONG, "en", "a"), (2, LONG + "two", "fr", "a")], [(2, LONG + "changed", "fr", "a"), (3, LONG + "three", "en", "a")]]
    frames = [spark.createDataFrame(rows, ingest_documents.RAW) for rows in batches]
    for n in (0, 1, 1, 0):  # the second one killed after writing, the first one again
        ingest_documents.ingest_batch(frames[n], n, target, 200, 1100, 150)
    found = spark.read.schema(ingest_documents.CHUNKS).parquet(f"{target}/chunks")
    assert sorted((r.doc_id, r.batch) for r in found.collect()) == [(1, 0), (2, 0), (3, 1)]


def test_ingest_of_no_files(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    assert ingest_documents.ingest(spark, str(tmp_path / "raw"), str(tmp_path / "out"), str(tmp_path / "checkpoint")).count() == 0


def page(body, title="A title"):
    return f"<html><head><title>{title}</title><style>p {{}}</style></head><body><nav>menu</nav><p>{body}</p><script>var x = '<p>';</script></body></html>"


@pytest.fixture
def crawl(spark, tmp_path):
    def add(*rows):
        write(spark, rows, "page_id long, url string, html string, extra string", str(tmp_path / "pages"))

    return add, str(tmp_path / "pages"), str(tmp_path / "out")


def test_refresh_replaces_changed_pages_only(spark, crawl):
    add, source, target = crawl
    add((1, "https://a.org/x#top", page(LONG), "e"), (2, "https://a.org/y", page(LONG + "y"), "e"), (3, "https://b.org/", page("too short"), "e"), (4, None, page(LONG), "e"), (5, "https://b.org/z", None, "e"), (None, "https://b.org/q", page(LONG), "e"))
    found = refresh_pages.refresh(spark, source, target)
    assert sorted((r.url, r.site, r.title, r.content) for r in found.collect()) == [("https://a.org/x", "a.org", "A title", LONG.strip()), ("https://a.org/y", "a.org", "A title", LONG + "y")]
    before = {r.url: r for r in found.collect()}
    assert {r.url: r for r in refresh_pages.refresh(spark, source, target).collect()} == before

    files = lambda: {f: os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(f"{target}/pages") for f in names if f.endswith(".parquet")}
    kept = files()
    add((6, "https://a.org/x", page(LONG), "e"), (8, "https://c.org/new", page("w " * 900), "e"), (7, "https://c.org/new", page(LONG), "e"), (2, "https://late.org/", page(LONG), "e"), (9, "https://a.org/x", page("cut"), "e"))
    grown = refresh_pages.refresh(spark, source, target)
    assert {r.url: r for r in grown.filter("url like '%a.org%'").collect()} == before
    assert sorted((r.place, r.content) for r in grown.filter("site = 'c.org'").collect()) == [(0, ("w " * 900)[:1100]), (1, ("w " * 900)[950:].strip())]
    assert kept.items() <= files().items()  # unchanged pages were not written again
    assert grown.filter("url like '%late%'").count() == 0
    ticks = spark.read.parquet(f"{target}/ticks").orderBy("page_id").collect()
    assert [(t.page_id, t.processed, t.updated, t.unchanged) for t in ticks] == [(5, 2, 2, 0), (9, 2, 1, 1)]


def test_refresh_killed_before_its_mark_gives_the_same(spark, crawl, monkeypatch):
    add, source, target = crawl
    add((1, "https://a.org/x", page(LONG), "e"), (2, "https://b.org/y", page(LONG * 9), "e"))
    monkeypatch.setattr(refresh_pages.crawl, "tick_counts", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        refresh_pages.refresh(spark, source, target)
    monkeypatch.undo()
    add((3, "https://a.org/x", page(LONG + "changed"), "e"))
    split = sorted(map(tuple, refresh_pages.refresh(spark, source, target).collect()))
    whole = sorted(map(tuple, refresh_pages.refresh(spark, source, f"{target}-at-once").collect()))
    assert split == whole and len(split) == 4


HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_command_line_runs_the_job(spark, tmp_path):
    write(spark, [(1, LONG, "en", "a"), (2, "short", "en", "a")], ingest_documents.RAW, str(tmp_path / "raw"))
    config = tmp_path / "job.toml"
    config.write_text(f'source = "{tmp_path}/raw"\ntarget = "{tmp_path}/corpus"\ncheckpoint = "{tmp_path}/checkpoint"\nleast_chars = 10000\n')
    for _ in range(2):  # with a value of the config overruled; the second run takes nothing
        said = subprocess.run([sys.executable, "-m", "jobs.ingest_documents", "--config", str(config), "--least-chars", "100"], cwd=HERE, capture_output=True, text=True, timeout=300)
        assert said.returncode == 0, said.stderr[-2000:]
        assert taken(spark.read.schema(ingest_documents.CHUNKS).parquet(f"{tmp_path}/corpus/chunks")) == [(1, 0, "en", LONG)]
    assert "0 batches in this run" in said.stderr


def test_command_lines_read_their_config(tmp_path):
    here = HERE
    for job, told in (("ingest_documents", "--checkpoint"), ("refresh_pages", "--target")):
        said = subprocess.run([sys.executable, "-m", f"jobs.{job}", "--help"], cwd=here, capture_output=True, text=True, timeout=120)
        assert said.returncode == 0 and told in said.stdout and "--least-chars" in said.stdout


def test_page_text_drops_what_is_no_text(spark):
    from lexloom.functions.cleaning import page_text, page_title

    html = "<html><head><title> A &amp; B\n c </title></head><body><!-- no --><h1>One</h1><p class='a'>two &lt;b&gt; <b>th</b>ree&nbsp;four<br/>five</p><script>if (a < b) {}</script>\n\n\n\n<div>six</div></body></html>"
    row = spark.createDataFrame([(html,), (None,), ("",), ("plain",)], "html string").select(page_title(F.col("html")).alias("t"), page_text(F.col("html")).alias("x")).collect()
    assert [tuple(r) for r in row] == [("A & B c", "One\ntwo <b> three four\nfive\n\nsix"), ("", ""), ("", ""), ("", "plain")]

"""Reading source files into rows."""

from __future__ import annotations

import importlib
import io
import itertools
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from lexloom import schemas
from lexloom.functions.cleaning import clean_scan
from lexloom.functions.text import leading_number, text


def seed(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of a seed file {model, dim, chunks: [...]}, with model and dim. A file without a list of chunks fails."""
    shape = StructType().add("model", StringType()).add("dim", IntegerType()).add("chunks", ArrayType(schemas.CHUNKS))
    raw = spark.read.schema(shape).json(path, multiLine=True)
    chunks = F.when(F.col("chunks").isNull(), F.raise_error(F.lit("seed file has no list of chunks"))).otherwise(F.col("chunks"))
    return raw.select("model", "dim", F.explode(chunks).alias("c")).select("model", "dim", "c.*")


def jsonl(spark: SparkSession, path: str | list[str], schema: StructType = schemas.CHUNKS, partitions: int | None = None) -> DataFrame:
    """Rows of JSON-lines files, gzipped or not; blank and unparsable lines are dropped.

    A gzip file is one task's to read, so with many rows a file pass `partitions`.
    """
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return rows.repartition(partitions) if partitions else rows


def jsonl_parts(spark: SparkSession, path: str) -> DataFrame:
    """Records of all parts of a dataset with the part's name and a sequence number in order of part and place."""
    return spark.read.schema(schemas.JSONL).json(path).withColumns({"part": F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1), "seq": F.monotonically_increasing_id()})


def crawl_export(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Pages of crawl exports (lists of records): url, title, body (the longer of markdown and text, markdown of equals), http_status."""
    raw = spark.read.schema(schemas.CRAWL_EXPORT).option("ignoreMissingFiles", True).json(path, multiLine=True)
    md, tx = text("markdown"), text("text")
    return raw.select(F.coalesce(F.nullif("url", F.lit("")), F.col("crawl.loadedUrl"), F.lit("")).alias("url"), F.trim(text("metadata.title")).alias("title"), F.when(F.length(md) >= F.length(tx), md).otherwise(tx).alias("body"), F.col("crawl.httpStatusCode").alias("http_status"))


def documents(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """Documents of a folder of sharded JSON files, at any depth; empty shards are fine."""
    reader = spark.read.option("recursiveFileLookup", True).option("ignoreMissingFiles", True)
    return (reader.schema(schema) if schema else reader).json(path, multiLine=True)


def _bank(rows: DataFrame, raw_id, content, source_type, title, article=None, date=None) -> DataFrame:
    null = F.lit(None).cast("string")
    return rows.select(raw_id.alias("raw_id"), text(content).alias("content"), F.lit(source_type).alias("source_type"), title.alias("source_title"), (null if article is None else article).alias("article_number"), (null if date is None else date).alias("law_date"))


def laws(raw: DataFrame) -> DataFrame:
    a = raw.select(F.explode("laws").alias("l")).select("l.law_title", "l.category", F.explode("l.articles").alias("a"))
    title = F.when(text("category") != "", F.concat("law_title", F.lit(" — "), "category")).otherwise(F.col("law_title"))
    return _bank(a, F.concat(F.lit("law:"), "a.item_id"), F.col("a.content"), "statute", title, leading_number(F.col("a.article_label")))


def conventions(raw: DataFrame) -> DataFrame:
    a = raw.select(F.explode("conventions").alias("c")).select("c.title", F.explode("c.articles").alias("a"))
    return _bank(a, F.concat(F.lit("con:"), "a.item_id"), F.col("a.content"), "convention", F.col("title"))


def opinions(raw: DataFrame) -> DataFrame:
    a = raw.select(F.explode("years").alias("y")).select("y.year_title", F.explode("y.opinions").alias("o"))
    return _bank(a, F.concat(F.lit("opin:"), "o.opinion_id"), F.col("o.content"), "advisory_opinion", F.col("year_title"), F.when(text("o.shomarenazarie") != "", F.concat(F.lit("نظریه "), "o.shomarenazarie")))


def verdicts(raw: DataFrame) -> DataFrame:
    v = raw.select(F.explode("verdicts").alias("v"))
    blank = lambda c: F.nullif(c, F.lit(""))
    return _bank(v, F.concat(F.lit("ara:"), "v.verdict_id"), F.col("v.content"), "case_law", F.coalesce(blank("v.group"), F.lit("رأی وحدت رویه")), blank("v.vote_no"), blank("v.date"))


def terms(raw: DataFrame) -> DataFrame:
    t = raw.select(F.explode("terms").alias("t"))
    content = F.when(text("t.content") != "", F.concat("t.word", F.lit(": "), "t.content")).otherwise(F.col("t.word"))
    return _bank(t, F.concat(F.lit("term:"), "t.term_id"), content, "terminology", F.trim(F.concat(F.lit("اصطلاح‌نامه حقوقی — حرف "), text("t.letter"))))


BANKS = {"laws": (schemas.LAWS, laws), "conventions": (schemas.CONVENTIONS, conventions), "opinions": (schemas.OPINIONS, opinions), "verdicts": (schemas.VERDICTS, verdicts), "terms": (schemas.TERMS, terms)}


def banks(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """The union of the banks whose files are given (name -> path)."""
    parts = [flatten(spark.read.schema(schema).json(paths[name], multiLine=True)) for name, (schema, flatten) in BANKS.items() if name in paths]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ---- spreadsheets, zip archives, PDF files

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}


def sheet_rows(data: bytes) -> Iterator[list[str]]:
    """Rows of a workbook's first sheet as texts, by column letters; gaps are ''."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")) for si in ET.fromstring(book.read("xl/sharedStrings.xml")).findall("m:si", _NS)]
        for row in ET.fromstring(book.read("xl/worksheets/sheet1.xml")).iter(f"{{{_NS['m']}}}row"):
            values: list[str] = []
            for cell in row.findall("m:c", _NS):
                letters = re.match("[A-Z]*", cell.attrib.get("r", ""))[0]
                place = 0
                for c in letters:
                    place = 26 * place + ord(c) - 64
                place = place - 1 if letters else len(values)
                v, inline = cell.find("m:v", _NS), cell.find("m:is", _NS)
                value = "".join(t.text or "" for t in inline.iter(f"{{{_NS['m']}}}t")) if inline is not None else (v.text or "" if v is not None else "")
                values += [""] * (place + 1 - len(values))
                values[place] = shared[int(value)] if cell.attrib.get("t") == "s" and value else value
            yield values


def spreadsheet(spark: SparkSession, path: str, columns: dict[str, int], least: int = 80, content: str = "content") -> DataFrame:
    """Rows of workbooks (or of workbooks in zip archives): the named columns by place, no header row, contents of `least` characters or more."""
    names = list(columns)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, data in zip(batch["path"], batch["content"], strict=True):
                for book in _workbooks(bytes(data)):
                    rows = list(sheet_rows(book))[1:]
                    cells = [[file, *(r[i] if i < len(r) else "" for i in columns.values())] for r in rows]
                    yield pd.DataFrame(cells, columns=["file", *names])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    rows = files.mapInPandas(read, "file string, " + ", ".join(f"`{n}` string" for n in names))
    return rows.filter(F.length(content) >= least)


def _workbooks(data: bytes) -> list[bytes]:
    """The workbook itself, or those inside a plain zip archive."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        if "xl/workbook.xml" in z.namelist():
            return [data]
        return [z.read(n) for n in sorted(z.namelist()) if n.endswith(".xlsx")]


def pdf(spark: SparkSession, path: str, pages_of: Callable[[bytes], tuple[str, list[str | None]]], watermark: str | None = None) -> DataFrame:
    """(path, pdf_title, text) of PDF files. pages_of gives a file's title and its pages' texts; a page it fails on is "",
    and a file it fails on has no title and an empty text."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for file, data in zip(batch["path"], batch["content"], strict=True):
                try:
                    title, pages = pages_of(bytes(data))
                except Exception:  # whatever a page extractor raises: one bad file does not end the job
                    title, pages = None, []
                rows.append((file, title, "\n".join(p or "" for p in pages)))
            yield pd.DataFrame(rows, columns=["path", "pdf_title", "text"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(read, "path string, pdf_title string, text string").withColumn("text", clean_scan(F.col("text"), watermark))


# ---- paged rows of a remote dataset


#: Partitions that a micro-batch's pages are dealt to at most; the pages of one are fetched one after another.
MOST_PARTITIONS = 128


class _Page(InputPartition):
    """A page, and of its rows those from `first` up to `last`."""

    def __init__(self, offset: int, length: int, first: int = 0, last: int | None = None):
        self.offset, self.length, self.first, self.last = offset, length, first, last


class _Pages(InputPartition):
    def __init__(self, pages: list[_Page]):
        self.pages = pages


class PagedRows(DataSource):
    """A dataset behind fetch(dataset, offset, length) -> rows; one partition per offset.

    Options: dataset, length, module and function of fetch, schema; offsets (comma-separated) in a batch, until (the row
    that a run reads up to) in a stream.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_rows"

    def schema(self) -> str:
        return self.options.get("schema", "row_index long, content string")

    def reader(self, schema: StructType) -> DataSourceReader:
        return _PagedReader(dict(self.options))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _PagedStreamReader(dict(self.options))


def _fetched(options: dict[str, str], page: _Page) -> Iterator[tuple]:
    fetch = getattr(importlib.import_module(options["module"]), options["function"])
    yield from (tuple(r) for r in itertools.islice(fetch(options["dataset"], page.offset, page.length), page.first, page.last))


class _PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [_Page(int(o), int(self.options.get("length", "100"))) for o in self.options["offsets"].split(",")]

    def read(self, page: _Page) -> Iterator[tuple]:
        return _fetched(self.options, page)


class _PagedStreamReader(DataSourceStreamReader):
    """Offsets are row numbers; a batch's pages are dealt to partitions, so the executors fetch them.

    Pages begin at multiples of the length and are asked for whole, whatever rows a batch begins and ends with; rows of
    other batches are left out of what comes.
    """

    def __init__(self, options: dict[str, str]):
        self.options = options

    def initialOffset(self) -> dict:
        return {"row": 0}

    def latestOffset(self) -> dict:
        return {"row": int(self.options["until"])}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        length = int(self.options.get("length", "100"))
        pages = [_Page(o, length, max(0, start["row"] - o), min(length, end["row"] - o)) for o in range(start["row"] // length * length, end["row"], length)]
        each = max(1, -(-len(pages) // MOST_PARTITIONS))
        return [_Pages(pages[i : i + each]) for i in range(0, len(pages), each)]

    def read(self, pages: _Pages) -> Iterator[tuple]:
        for page in pages.pages:
            yield from _fetched(self.options, page)


def paged(spark: SparkSession, dataset: str, offsets: list[int], length: int, module: str, function: str, schema: str) -> DataFrame:
    spark.dataSource.register(PagedRows)
    options = {"dataset": dataset, "offsets": ",".join(map(str, offsets)), "length": length, "module": module, "function": function, "schema": schema}
    return spark.read.format("paged_rows").options(**options).load()


def paged_stream(spark: SparkSession, dataset: str, until: int, length: int, module: str, function: str, schema: str) -> DataFrame:
    """The rows before `until` that a stream's checkpoint has not taken yet."""
    spark.dataSource.register(PagedRows)
    return spark.readStream.format("paged_rows").options(dataset=dataset, until=until, length=length, module=module, function=function, schema=schema).load()


def parquet_page(dataset: str, offset: int, length: int) -> Iterator[tuple]:
    """Rows of one page of a dataset that lies as Parquet in folders page=N, each of `length` rows or fewer; a fetch for PagedRows."""
    found = pq.read_table(f"{dataset}/page={offset // length}", partitioning=None)
    return zip(*(c.to_pylist() for c in found.columns), strict=True)


def jdbc(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """Rows of a query against a relational database; a second database is a second url."""
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()


def sql(spark: SparkSession, statement: str, *args: object, **tables: DataFrame) -> DataFrame:
    """A parameterised statement (? placeholders) over catalog tables and the given ones (named in braces)."""
    return spark.sql(statement, args=list(args) or None, **tables)

"""Schemas of the stored tables."""

from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType, TimestampType


def _table(**columns) -> StructType:
    return StructType([StructField(name, kind) for name, kind in columns.items()])


S, I, L, D, B, T = StringType(), IntegerType(), LongType(), DoubleType(), BooleanType(), TimestampType()

CHUNKS = _table(id=S, content=S, embedding=ArrayType(D), source_type=S, source_title=S, article_number=S, law_date=S, source_url=S, source_id=S, hf_dataset=S)
LEGAL_DOCUMENTS = _table(id=L, source=S, jurisdiction=S, country=S, title=S, section_reference=S, full_text=S, source_url=S, embedding=ArrayType(D))
CRAWL_SOURCE = _table(id=S, name=S, allowed_host=S, seed_urls=ArrayType(S), source_type=S, enabled=B)
CRAWL_PAGE = _table(url=S, source_id=S, status=S, content_hash=S, attempts=I, discovered_at=T, last_crawled_at=T, error=S)
AUDIT = _table(question_id=L, retrieved_ids=ArrayType(S), match_kinds=ArrayType(_table(id=S, kind=S, score=D)), cited=ArrayType(_table(raw=S, number=S, kind=S)), unverified=ArrayType(_table(raw=S, number=S, kind=S)), created_at=T)
RATE_LIMIT = _table(bucket_key=S, window_start=T, hits=I)
CHAT = _table(id=L, user_id=S, chat_type=S, role=S, content=S, matter_id=S, request_id=S, created_at=T)
MATTER = _table(matter_id=S, user_id=S, title=S, status=S, created_at=T)
USER_FILE = _table(file_id=L, user_id=S, filename=S, content=S, matter_id=S, created_at=T)
CONTACT = _table(id=S, name=S, email=S, message=S, created_at=T)

#: Records of the JSONL parts, of crawl exports, and of the five nested banks.
JSONL = _table(id=S, source_file=S, book_title=S, author=S, chapter=S, chunk_index=I, total_chunks_in_file=I, text=S, word_count=I, had_corrections=B, domain=S)
CRAWL_EXPORT = _table(url=S, markdown=S, text=S, metadata=_table(title=S), crawl=_table(loadedUrl=S, httpStatusCode=I))
LAWS = _table(laws=ArrayType(_table(law_title=S, category=S, articles=ArrayType(_table(item_id=S, content=S, article_label=S)))))
CONVENTIONS = _table(conventions=ArrayType(_table(title=S, articles=ArrayType(_table(item_id=S, content=S)))))
OPINIONS = _table(years=ArrayType(_table(year_title=S, opinions=ArrayType(_table(opinion_id=S, content=S, shomarenazarie=S)))))
VERDICTS = _table(verdicts=ArrayType(_table(verdict_id=S, content=S, group=S, vote_no=S, date=S)))
TERMS = _table(terms=ArrayType(_table(term_id=S, word=S, content=S, letter=S)))

TABLES = {"legal_chunks": CHUNKS, "legal_documents": LEGAL_DOCUMENTS, "crawl_source": CRAWL_SOURCE, "crawl_page": CRAWL_PAGE, "legal_audit_log": AUDIT, "request_rate_limit": RATE_LIMIT, "chat_message": CHAT, "matter": MATTER, "user_file": USER_FILE, "contact_messages": CONTACT}


def create_tables(spark, database: str = "default") -> list[str]:
    """Create the tables that are missing (the place of ordered migrations); returns their names."""
    missing = [n for n in TABLES if not spark.catalog.tableExists(f"{database}.{n}")]
    for name in missing:
        spark.createDataFrame([], TABLES[name]).write.format("parquet").saveAsTable(f"{database}.{name}")
    return missing

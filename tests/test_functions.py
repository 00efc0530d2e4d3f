import json

import pytest
from pyspark.sql import functions as F

from lexloom.functions import anonymize, authority, chunking, cleaning, references, vectors
from lexloom.functions import text as T


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'double'}" for k, v in values.items())) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


def value(spark, f, *texts):
    return one(spark, f(*(F.col(f"c{i}") for i in range(len(texts)))), **{f"c{i}": t for i, t in enumerate(texts)})


def test_digits_and_letters(spark):
    assert value(spark, T.latin_digits, "۱۲۳ ٤٥٦") == "123 ٤٥٦"
    assert value(spark, T.normalize, "  ماده   ۱۲ علي‌رضا ك ة ") == "ماده 12 علیرضا ک ه"
    assert value(spark, T.normalize_letters, "۱ ي") == "۱ ی"


def test_dates_numbers_and_names(spark):
    assert value(spark, T.year, "قانون مصوب ۱۳۷۹") == "1379" and value(spark, T.year, "none") is None
    assert value(spark, T.normalized_date, "۱۳۹۹-۱.۲") == "1399/1/2" and value(spark, T.normalized_date, "/") is None
    assert value(spark, T.labelled_date, "x تاریخ تصویب: ۱۳۹۹/۰۲/۰۳ y") == "1399/02/03"
    assert value(spark, T.words_to_number, "یکصد و بیست و سه") == 123 and value(spark, T.words_to_number, "12") == 12
    assert value(spark, T.words_to_number, "یک و نامعلوم") is None and value(spark, T.words_to_number, "صفر") is None
    assert value(spark, T.source_name, "Law_of-Work(2).pdf") == "law of work"
    assert value(spark, T.hex_file_name, "file-12ab-d982d8a7-x_y.pdf") == "قا x y"
    assert value(spark, T.leading_number, " 12 of") == "12" and value(spark, T.leading_number, "of 12") is None
    assert value(spark, T.slug, "a b/c!") == "a-b-c" and value(spark, T.slug, "!!") == "text"
    assert value(spark, T.query_id, "http://x/?IDS=77&a") == "77"
    assert value(spark, T.without_nulls, "a\x00b") == "ab"


@pytest.mark.parametrize(("url", "official"), [("https://a.b/c", True), ("HTTP://a", True), ("data/x.pdf", False), ("/abs", False), (None, False), ("https://host/x (file)", True), ("ftp://a", False)])
def test_official_urls(spark, url, official):
    assert value(spark, T.is_official_url, url) is official


@pytest.mark.parametrize(("raw", "code"), [("DE", "DE"), ("de", None), ("deu", "DE"), (" Czech Republic ", "CZ"), ("türkiye", "TR"), ("", None), (None, None), ("Atlantis", None)])
def test_countries(spark, raw, code):
    assert value(spark, T.country, raw) == code


def test_templates_and_patterns(spark):
    answers = F.create_map(F.lit("a"), F.lit(" x "), F.lit("b"), F.lit("  "))
    assert one(spark, T.fill_template(F.lit("{{a}}-{{b}}-{{c}}"), answers)) == "x-………………-………………"
    assert value(spark, T.escape_pattern, "5[a.*") == r"5\[a\.\*"
    assert value(spark, T.phrases, "1. one\n- \"two\"\n\n• three") == ["one", "two", "three"]


def test_references(spark):
    refs = value(spark, references.article_refs, "اصل ۰۲۲ و ماده ۱۰ و ماده 10 و تبصره 3 قانون مدنی و رأی وحدت رویه شماره 733")
    assert [(r.kind, r.number, r.law_hint) for r in refs] == [("principle", "22", "قانون مدنی"), ("article", "10", "قانون مدنی"), ("note", "3", "قانون مدنی"), ("ruling", "733", "قانون مدنی")]
    assert value(spark, references.article_refs, "سال 1400 چه شد") == []
    assert value(spark, references.law_hint, "قانون کارشناسان") == "" and value(spark, references.law_hint, "قانون کار") == "کار"
    values = one(spark, references.match_values(references.article_refs(F.lit("اصل 5"))[0]))
    assert values == ["5", "۵", "5مکرر", "5 مکرر", "۵مکرر", "۵ مکرر", "اصل 5", "اصل ۵"]
    score = lambda article, title: value(spark, lambda q, a, t: references.article_score(references.article_refs(q), a, t), "ماده 10 قانون مدنی", article, title)
    assert (score("۱۰", "قانون مدنی"), score("10مکرر", "قانون تجارت"), score("11", "قانون مدنی"), score("1234567", "قانون مدنی")) == (1.0, 0.35, 0.0, 0.0)
    assert value(spark, references.infer_article, None, "ماده 7", "ماده 8") == "7" and value(spark, references.infer_article, "3", "ماده 7", "") == "3"


def test_citations(spark):
    cites = value(spark, references.cited_numbers, "ماده 10 و ماده ۰۱۰ و اصل 3 و رای شماره 45")
    assert [(c.kind, c.number) for c in cites] == [("principle", "3"), ("article", "10"), ("ruling", "45")]
    backed = lambda article, content: one(spark, references.supports(references.cited_numbers(F.lit("ماده 1"))[0], F.lit(article).cast("string"), F.lit("t"), F.lit(content)))
    assert backed("1", "") and backed(None, "طبق ماده 1 قانون") and not backed(None, "ماده 10") and not backed("10", "x")


def test_quotes(spark):
    case = json.dumps({"persons": [], "subject": "S", "description": "D", "judgments": [{"text": "J"}, {}]})
    assert value(spark, references.quote, case, None) == "S — D — J"
    assert value(spark, references.quote, "مقدمه. ماده 12 متن آن است. بعد", "۱۲") == "ماده 12 متن آن است."
    assert value(spark, references.quote, "متن  بلند", "12(") == "متن بلند"


def test_authority(spark):
    of = lambda kind, title: value(spark, authority.authority, kind, title).rank
    assert [of("statute", "قانون اساسي"), of("convention", None), of("statute", "آیین‌نامه x"), of("statute", "قانون"), of("advisory_opinion", ""), of("terminology", ""), of("case_law", "رأی وحدت رویه"), of("case_law", ""), of("x", "")] == [100, 88, 70, 90, 40, 20, 80, 35, 30]


def test_vectors(spark):
    cos = lambda a, b: one(spark, vectors.cosine(F.array(*map(F.lit, a)).cast("array<double>"), F.array(*map(F.lit, b)).cast("array<double>")))
    assert cos([1.0, 0.0], [1.0, 0.0]) == 1 and cos([1.0], [1.0, 2.0]) == -1 and cos([], []) == -1 and cos([0.0], [1.0]) == -1
    assert value(spark, vectors.parse, "[1, 2.5]") == [1.0, 2.5] and value(spark, vectors.parse, "no") == []
    state = lambda n: one(spark, F.struct(vectors.is_embedded(F.array_repeat(F.lit(1.0), n)), vectors.lacks_embedding(F.array_repeat(F.lit(1.0), n))))
    assert [tuple(state(n)) for n in (9, 10, 11)] == [(False, True), (False, False), (True, False)]


def sliding(text, size=1100, overlap=150):
    out, start = [], 0
    while text and True:
        out.append(text[start : start + size])
        if start + size >= len(text):
            return out
        start += size - overlap
    return out


def test_sliding_chunks(spark):
    for n in (0, 1, 1099, 1100, 1101, 2049, 2050, 2051, 3000):
        text = "".join(chr(97 + i % 26) for i in range(n))
        assert value(spark, chunking.sliding_chunks, text) == sliding(text), n


def pack(text, longest=1400, least=180):
    import re

    text = text.replace("\r\n", "\n").strip()
    if not text:
        return []
    if len(text) <= longest:
        return [text]
    out, held = [], ""
    for p in re.split(r"\n{2,}", text):
        if held and len(held) + 2 + len(p) > longest:
            out.append(held.strip())
            held = p
        else:
            held = f"{held}\n\n{p}" if held else p
    return [x for x in [*out, held.strip()] if len(x) >= least]


def test_pack_paragraphs(spark):
    import random

    rng = random.Random(1)
    texts = ["", "short", *("\n\n".join("w" * rng.randint(1, 900) for _ in range(rng.randint(1, 9))) for _ in range(20))]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", chunking.pack_paragraphs(F.col("t")).alias("p")).collect()
    assert {r.i: r.p for r in rows} == {i: pack(t) for i, t in enumerate(texts)}


def test_articles(spark):
    text = "مقدمه " * 10 + "\nماده 1 - یک\nماده ۲ مکرر - دو\nماده واحده: سه"
    parts = value(spark, chunking.split_articles, text)
    assert [p.number for p in parts] == [None, "1", "2 مکرر", "واحده"] and parts[1].body == "ماده 1 - یک"
    assert value(spark, chunking.split_articles, "no heading")[0].body == "no heading"
    body = "ماده 1 - " + "\n\n".join("x" * 700 for _ in range(5))
    packed = one(spark, chunking.pack_articles(chunking.split_articles(F.lit(body)), F.lit("Title"), F.lit("x")))
    assert [p.number for p in packed] == [None, None, None] and all(p.body.startswith("Title\n\n") and len(p.body) <= 1650 + 7 for p in packed)
    many = F.transform(F.sequence(F.lit(1), F.lit(9)), lambda i: F.struct(i.cast("string").alias("number"), F.repeat(i.cast("string"), F.lit(300)).alias("body")))
    numbers = lambda kind: [p.number for p in one(spark, chunking.pack_articles(many, F.lit(""), F.lit(kind)))]
    assert numbers("قانون") == list("123456") and numbers("رأی") == ["1", "8", "9"]
    assert value(spark, chunking.split_articles_of_scan, "x" * 401) == ["x" * 401] and value(spark, chunking.split_articles_of_scan, "x") == []


def test_cleaning(spark):
    raw = "menu MARK# Head\n\n\n\n**b** [w](u) ![i](u)\n| a | b |\n a<br/>b&nbsp;c\\-d TAIL x"
    clean = value(spark, lambda c: cleaning.strip_chrome(c, tail="TAIL", start_marks=("MARK",)), raw)
    assert clean.startswith("Head\n\nb w") and clean.endswith("a\nb c-d") and not set("#*|![]()") & set(clean)
    assert value(spark, lambda c: cleaning.clean_scan(c, "www\\.site\\.org"), "a WWW.SITE.ORG\x00 b\n\n\n\nc") == "a b\n\nc"
    kinds = ["قانون کار", "آیین‌نامه x", "دادنامه شماره", "اساسنامه", "دستورالعمل", "تصویب نامه", "مصوبه", "بخشنامه", "دیگر"]
    found = [value(spark, lambda c: F.concat_ws(":", cleaning.document_kind(c), cleaning.kind_rank(cleaning.document_kind(c)).cast("string")), k) for k in kinds]
    assert [f.split(":")[1] for f in found] == list("012345678")
    crumb = value(spark, cleaning.breadcrumb, "# خانه > قانون مدنی > ماده ۱۰\nمتن ۱۳۹۹/۰۱")
    assert (crumb.title, crumb.article_number, crumb.law_date, crumb.kind) == ("قانون مدنی", "10", "1399/01", "statute-like")
    assert value(spark, cleaning.article_of_scan, "ماده ۰۰۷") == "7" and value(spark, cleaning.article_of_row, "اصل بیست و دوم: x", "") == "22"
    assert value(spark, lambda c: cleaning.nfkc(c), "ﬁ ي") == "fi ی"
    assert value(spark, lambda c: cleaning.source_class(c, [("bad", None), ("law", "statute")]), "law bad") is None
    assert value(spark, lambda c: cleaning.heading_title(c, F.lit("f")), "# A heading that is long\nx") == "A heading that is long"


def test_anonymise():
    case = {"subject": "S", "description": "Ali Rezaei lives at Tehran 5. Ali", "persons": [{"role": "R1", "fullName": "Ali Rezaei", "address": "Tehran 5", "national_code": 7}, {"role": "R1", "full_name": "Ali"}, "x"], "mobile": "1", "charges": ["Ali Rezaei"]}
    content, title = anonymize.anonymize(json.dumps(case))
    clean = json.loads(content)
    assert clean["description"] == "…… lives at ……. ……" and clean["charges"] == ["……"] and "mobile" not in clean
    assert clean["persons"] == [{"role": "R1"}, {"role": "R1"}, {"role": "طرف پرونده"}] and title == "R1 · طرف پرونده — S"
    assert list(clean) == ["subject", "description", "persons", "charges"]
    assert anonymize.anonymize("no json") == ("no json", None) and anonymize.anonymize("no json", strict=True)[0] == "{}"
    assert anonymize.anonymize("[1]") == ("[1]", None) and anonymize.anonymize(None) == (None, None)


def test_anonymise_nested_spellings_and_order():
    case = {"persons": {"fullName": "Zed Who"}, "Full-Name": "n", "notes": [["Zed Who", {"tel": "1", "say": "Zed Who!"}], 5, None]}
    content, title = anonymize.anonymize(json.dumps(case))
    assert json.loads(content) == {"persons": [], "notes": [["……", {"say": "……!"}], 5, None]} and title == "پرونده قضایی (هویت حذف‌شده)"
    deep = {"persons": [{"role": " ", "contact": {"email": "a@b.c"}, "address": {"address": ["Long Street 9", "x"], "city": "Rome"}}], "text": "a@b.c Long Street 9 Rome x"}
    content, _ = anonymize.anonymize(json.dumps(deep))
    assert json.loads(content)["text"] == "a@b.c …… Rome x"
    assert anonymize.named_in([{"fullName": "ab"}, {"fullName": "abc"}, {"fullName": "ab"}, 7, None]) == ["abc", "ab"]
    assert anonymize.anonymize("") == ("", None) and anonymize.anonymize('{"a":1}') == ('{"a":1,"persons":[]}', "پرونده قضایی (هویت حذف‌شده)")


def test_kinds_of_titles(spark):
    titles = {"قانون کار": "قانون", "آيين دادرسی": "آیین‌نامه", "x" * 20 + " آیین‌نامه": "آیین‌نامه", "شماره ۱ دادنامه": "رأی", "x" * 50 + " دادنامه": "سایر", "متن اساسنامه": "اساسنامه", "یک بخشنامه": "بخشنامه", "": "سایر"}
    for title, kind in titles.items():
        assert value(spark, cleaning.document_kind, title) == kind
    assert value(spark, cleaning.document_kind, None) == "سایر"


def test_anonymise_chunks(spark):
    rows = [(1, '{"persons":[{"fullName":"Ali B"}],"x":"Ali B"}', "t", "other"), (2, "plain", "وکیل دادگستری: نام - x", "cases"), (3, "plain", "t", None)]
    found = {r.id: r for r in anonymize.anonymize_chunks(spark.createDataFrame(rows, "id int, content string, source_title string, hf_dataset string"), ["cases"]).collect()}
    assert "Ali" not in found[1].content and found[2].source_title == "وکیل دادگستری- x" and found[3].source_title == "t"


def brute_pack(paragraphs, longest, lead):
    """(text, part) of greedy packing, and how the lengths count."""
    done, held, n = [], None, 0
    for p in paragraphs:
        if held is not None and n + len(p) + 2 > longest:
            done.append(held)
            held, n = p, len(p)
        else:
            n = len(p) + lead if held is None else n + len(p) + 2
            held = p if held is None else f"{held}\n\n{p}"
    return done + [held]


def test_packing_equals_brute_force_on_long_and_short_texts(spark):
    import random

    rng = random.Random(3)
    texts = ["\n\n".join("w" * rng.randint(1, 400) for _ in range(rng.randint(1, 60))) for _ in range(80)] + ["x" * 2000, "a\n\nb", "", "y" * 1399 + "\n\nz" * 900]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in rows.select("t", chunking.pack_paragraphs(F.col("t")).alias("p")).collect():
        want = [] if not r.t else [r.t] if len(r.t) <= 1400 else [x for x in brute_pack(r.t.split("\n\n"), 1400, 0) if len(x) >= 180]
        assert r.p == want
    pieces = F.array(F.struct(F.lit("7").alias("number"), F.col("t").alias("body")))
    for r in rows.select("t", chunking.pack_articles(pieces, F.lit(""), F.lit(""), cap=1000).alias("p")).collect():
        parts = [r.t] if len(r.t) <= 1650 else brute_pack(r.t.split("\n\n"), 1650, 2)
        assert [(c.number, c.body) for c in r.p] == [(f"7/{k}" if len(parts) > 1 else "7", x) for k, x in enumerate(parts) if len(x) >= 220]


def test_a_hundred_thousand_paragraphs_are_packed_in_linear_time(spark):
    import time

    took = {}
    for n in (10_000, 10_000, 100_000):
        row = spark.range(1).select(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(F.lit("paragraph number "), i.cast("string"))), "\n\n").alias("t"))
        start = time.perf_counter()
        made = row.select(F.explode(chunking.pack_paragraphs(F.col("t"))).alias("p")).agg(F.count(F.lit(1)), F.sum(F.length("p"))).first()
        took[n] = time.perf_counter() - start
        assert made[0] > n / 70 and made[1] > 18 * n
    assert took[100_000] < 25 * took[10_000] + 5


@pytest.mark.parametrize(("metadata", "title"), [("قانون مدنی - سایت حقوقی", "قانون مدنی"), ("قانون تجارت | پایگاه اختبار 2", "قانون تجارت"), ("قانون کار - متن کامل", "قانون کار - متن کامل"), ("قانون - سایت", "file")])
def test_site_names_go_from_titles(spark, metadata, title):
    found = one(spark, cleaning.title_of_scan(F.col("b"), F.col("m"), F.col("f")), b="no law here", m=metadata, f="file")
    assert found == title

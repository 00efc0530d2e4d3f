"""References to articles, principles, notes and rulings in questions and answers, and what supports them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexloom.functions import fixed as V
from lexloom.functions.text import collapse_space, escape_pattern, latin_digits, let, normalize, persian_digits, text

#: kind -> pattern with the number in group 1, in the order in which kinds are read.
QUESTION_PATTERNS = [("principle", rf"{V.PRINCIPLE}\s+([0-9]{{1,3}})"), ("article", rf"{V.ARTICLE}\s+([0-9]{{1,4}})(?:\s*{V.REPEATED})?"), ("note", rf"{V.NOTE}\s+([0-9]{{1,2}})"), ("ruling", V.RULING_PATTERN)]
ANSWER_PATTERNS = [("principle", rf"{V.PRINCIPLE}\s+([0-9]{{1,3}})"), ("article", rf"{V.ARTICLE}\s+([0-9]{{1,4}})"), ("ruling", V.RULING_PATTERN)]


def _hint(q: Column) -> Column:
    chain = F.lit("")
    for pattern, hint in reversed(V.LAW_HINTS):
        chain = F.when(q.rlike(pattern), F.lit(hint)).otherwise(chain)
    return chain


def law_hint(question: Column) -> Column:
    """What the title of the law that a question names contains; the first rule that matches counts, none gives ''."""
    return let(normalize(text(question)), _hint)


def _bare(number: Column) -> Column:
    stripped = F.regexp_replace(number, "^0+", "")
    return F.when(stripped == "", F.lit("0")).otherwise(stripped)


def article_refs(question: Column) -> Column:
    """array<struct<kind, number, law_hint>> of a question: kinds in turn, repeats dropped, no leading zeros."""

    def refs(x: Column) -> Column:
        def of(kind: str, pattern: str) -> Column:
            return F.transform(F.regexp_extract_all(x["q"], F.lit(pattern), 1), lambda n: F.struct(F.lit(kind).alias("kind"), _bare(n).alias("number"), x["hint"].alias("law_hint")))

        return F.array_distinct(F.flatten(F.array(*(of(k, p) for k, p in QUESTION_PATTERNS))))

    return let(let(normalize(text(question)), lambda q: F.struct(q.alias("q"), _hint(q).alias("hint"))), refs)


def cited_numbers(answer: Column) -> Column:
    """array<struct<raw, number, kind>> of an answer; of repeats (kind, number) the first stays."""

    def cites(q: Column) -> Column:
        def of(kind: str, pattern: str) -> Column:
            raws, numbers = F.regexp_extract_all(q, F.lit(pattern), 0), F.regexp_extract_all(q, F.lit(pattern), 1)
            return F.zip_with(raws, numbers, lambda raw, n: F.struct(raw.alias("raw"), _bare(n).alias("number"), F.lit(kind).alias("kind")))

        return F.flatten(F.array(*(of(k, p) for k, p in ANSWER_PATTERNS)))

    def first_of_each(every: Column) -> Column:
        return F.filter(every, lambda x, i: ~F.exists(F.slice(every, F.lit(1), i), lambda y: (x["kind"] == y["kind"]) & (x["number"] == y["number"])))

    return let(let(normalize(text(answer)), cites), first_of_each)


def match_values(ref: Column) -> Column:
    """The spellings of a reference's number in stored article numbers."""
    n, fa = ref["number"], persian_digits(ref["number"])
    join = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    plain = F.array(n, fa, join(n, V.REPEATED), join(n, " " + V.REPEATED), join(fa, V.REPEATED), join(fa, " " + V.REPEATED))
    more = F.array(join(V.PRINCIPLE + " ", n), join(V.PRINCIPLE + " ", fa))
    return F.when(ref["kind"] == "principle", F.concat(plain, more)).otherwise(plain)


def article_score(refs: Column, article: Column, title: Column) -> Column:
    """How well a row is the article asked for: 1 with the law named in its title, 0.35 with another, 0.72 if none is named."""
    art, name = latin_digits(text(article)), normalize(text(title))
    of = lambda r: F.when((art == r["number"]) | (art == F.concat(r["number"], F.lit(V.REPEATED))), F.when(r["law_hint"] == "", F.lit(V.EXACT_PLAIN)).when(F.contains(name, r["law_hint"]), F.lit(V.EXACT_TITLE)).otherwise(F.lit(V.EXACT_OTHER_TITLE))).otherwise(F.lit(0.0))
    return F.when(F.length(art) > 6, F.lit(0.0)).otherwise(F.coalesce(F.array_max(F.transform(refs, of)), F.lit(0.0)))


def infer_article(current: Column, title: Column, content: Column, longest: int = 500) -> Column:
    """The stored article number if not blank, else the first number after an article or principle in title and content."""
    head = normalize(F.concat_ws(" ", text(title), F.substring(text(content), 1, longest)))
    number = lambda word: F.nullif(F.regexp_extract(head, rf"{word}\s+([0-9]{{1,4}})", 1), F.lit(""))
    return F.coalesce(F.nullif(F.trim(current), F.lit("")), number(V.ARTICLE), number(V.PRINCIPLE))


def supports(cite: Column, article: Column, title: Column, content: Column) -> Column:
    """Whether a row of the corpus supports a citation, by its article number or by naming it in its text."""
    art, name, body = latin_digits(text(article)), normalize(text(title)), normalize(text(content))
    n = cite["number"]
    named = lambda before, space, where: F.regexp_like(where, F.concat(F.lit(before + space), n, F.lit("(?![0-9])")))
    principle = (art == n) | named(V.PRINCIPLE, r"\s+", F.concat_ws(" ", body, name))
    ruling = (art == n) | F.contains(name, n) | named(V.RULING_SUPPORT, r"\s*", body)
    article_ = (art == n) | (art == F.concat(n, F.lit(V.REPEATED))) | named(V.ARTICLE, r"\s+", body)
    return F.when(cite["kind"] == "principle", principle).when(cite["kind"] == "ruling", ruling).otherwise(article_)


def quote(content: Column, article: Column, longest: int = 420) -> Column:
    """What to show of a row: a case file's subject, description and judgments; else its article's sentence; else its start."""
    flat = collapse_space(text(content))
    case = flat.startswith("{") & F.contains(flat, F.lit('"persons"'))
    record = F.from_json(text(content), "struct<subject:string,description:string,judgments:array<struct<text:string>>>")
    parts = F.filter(F.concat(F.array(record["subject"], record["description"]), F.coalesce(F.transform(record["judgments"], lambda j: j["text"]), F.array().cast("array<string>"))), lambda p: p.isNotNull() & (F.trim(p) != ""))
    number = latin_digits(text(article))
    pattern = F.concat(F.lit(rf"(?:{V.ARTICLE}|{V.PRINCIPLE})\s*"), escape_pattern(number), F.lit(r"[^.۞]*[.۞]?"))
    sentence = F.when(number != "", F.nullif(F.regexp_substr(flat, pattern), F.lit("")))
    told = F.when(case & record.isNotNull(), F.array_join(parts, " — "))
    return F.substring(F.coalesce(told, sentence, flat), 1, longest)

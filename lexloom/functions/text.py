"""Text functions as Column expressions: normalising, numbers, dates, hashes, identifiers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexloom.functions import fixed as V

#: White space as Unicode has it; Java's \s is ASCII only, and (?U) would change \d too.
SPACE = r"[\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
#: White space that a run of must become one space: a space with more behind it, or any other white space.
_RUN = SPACE.replace("[", "(?: [", 1) + r"+|[\t-\r\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]" + SPACE + "*)"
#: What separates words when tokens are compared.
TOKEN_BREAK = r"[^\u0600-\u06FFa-zA-Z0-9]+"


def text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _each(c: Column, old: str, new: str) -> Column:
    """Characters replaced one by one: a byte search each, where translate() looks every character up in a map."""
    for i, a in enumerate(old):
        c = F.replace(c, F.lit(a), F.lit(new[i : i + 1]))
    return c


def latin_digits(c: Column) -> Column:
    """Persian digits U+06F0-06F9 to 0-9; the Arabic-Indic block stays."""
    return _each(c, V.PERSIAN_DIGITS, V.LATIN_DIGITS)


def persian_digits(c: Column) -> Column:
    return F.translate(c, V.LATIN_DIGITS, V.PERSIAN_DIGITS)


def trim_space(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def collapse_space(c: Column) -> Column:
    """Runs of white space become one space, none at the ends."""
    return F.trim(F.regexp_replace(c, _RUN, " "))


def normalize_letters(c: Column) -> Column:
    """Arabic letters to Persian ones, no zero-width non-joiner, single spaces; digits stay."""
    return collapse_space(_each(c, V.ARABIC_LETTERS + V.ZERO_WIDTH_NON_JOINER, V.PERSIAN_LETTERS))


def normalize(c: Column) -> Column:
    """normalize_letters with Latin digits."""
    return normalize_letters(latin_digits(c))


def tokens(c: Column, least: int = 3) -> Column:
    """Words of a normalised text of at least `least` characters, repeats kept."""
    return F.filter(F.split(normalize(c), TOKEN_BREAK), lambda t: F.length(t) >= least)


def search_tokens(c: Column) -> Column:
    """Lower-cased words for full-text match, without stemming or stop words."""
    return F.array_distinct(F.array_remove(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), ""))


def trigrams(c: Column) -> Column:
    """The distinct runs of three characters of a text, cut in one pass; a shorter text has none."""
    letters = F.split(c, "")
    places = F.sequence(F.lit(0), F.size(letters) - 3)
    return F.when(F.length(c) >= 3, F.array_distinct(F.transform(places, lambda i: F.concat(letters[i], letters[i + 1], letters[i + 2])))).otherwise(F.array().cast("array<string>"))


def search_text(title: Column, article: Column, content: Column, longest: int = 40_000) -> Column:
    """What full-text search sees: title, article number and the first characters of the content."""
    return F.concat_ws(" ", text(title), text(article), F.substring(text(content), 1, longest))


def contains_any(c: Column, words: str) -> Column:
    """Whether a text contains one of the words (joined by |): a byte search each, which alternation in a pattern is not."""
    found = F.lit(False)
    for w in words.split("|"):
        found = found | F.contains(c, F.lit(w))
    return found


def without_nulls(c: Column) -> Column:
    return F.regexp_replace(c, r"\x00", "")


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def normalized_hash(c: Column) -> Column:
    return F.sha2(collapse_space(c), 256)


def short_hash(c: Column, digits: int = 16) -> Column:
    return F.substring(F.sha2(c, 256), 1, digits)


def signature(c: Column, longest: int = 180) -> Column:
    """What duplicates are compared by: the first characters with white space collapsed."""
    start = collapse_space(F.substring(text(c), 1, 4 * longest))  # nearly always enough; else the whole text is collapsed
    return F.when(F.length(start) > longest, F.substring(start, 1, longest)).otherwise(F.substring(collapse_space(text(c)), 1, longest))


def ratio_of(c: Column, characters: str = r"[\u0600-\u06FF]") -> Column:
    """Share of characters of a class; 0 for an empty text."""
    return F.when(F.length(c) > 0, F.regexp_count(c, F.lit(characters)) / F.length(c)).otherwise(F.lit(0.0))


def leading_number(c: Column) -> Column:
    return F.nullif(F.regexp_extract(trim_space(text(c)), r"^([0-9]+)", 1), F.lit(""))


def year(c: Column) -> Column:
    """The first four digits that can be a Jalali year, else null."""
    return F.nullif(F.regexp_extract(latin_digits(text(c)), "(13[0-9]{2}|14[0-9]{2})", 1), F.lit(""))


def normalized_date(c: Column) -> Column:
    """A textual date with slashes; blank is null."""
    s = F.regexp_replace(F.translate(latin_digits(c), ",،-.", "////"), "/{2,}", "/")
    return F.nullif(F.regexp_replace(s, "^/+|/+$", ""), F.lit(""))


def labelled_date(c: Column) -> Column:
    """The date behind a word for adoption or date in the first 2500 characters."""
    pattern = r"(?:مصوب|تاریخ(?:\s*(?:تنظیم|دادنامه|تصویب))?)\s*[:：]?\s*((?:13|14|۱۳|۱۴)[0-9۰-۹]{2}(?:[/\-٬,،.][0-9۰-۹]{1,2}){0,2})"
    return normalized_date(F.nullif(F.regexp_extract(F.substring(text(c), 1, 2500), pattern, 1), F.lit("")))


def words_to_number(c: Column) -> Column:
    """The sum of number words joined by "and"; digits as they are; an unknown word or a sum of zero gives null."""
    table = F.create_map(*(F.lit(x) for pair in (V.ONES | V.TENS | V.HUNDREDS).items() for x in pair))
    s = collapse_space(F.translate(text(c), V.ZERO_WIDTH_NON_JOINER + "-", "  "))
    parts = F.filter(F.split(s, r"\s+و\s+"), lambda p: F.trim(p) != "")
    total = F.aggregate(F.transform(parts, lambda p: F.try_element_at(table, F.trim(p))), F.lit(0), lambda a, b: a + b)
    return F.when(s.rlike("^[0-9]+$"), s.try_cast("int")).otherwise(F.nullif(total, F.lit(0)))


def source_name(c: Column) -> Column:
    """A file name without copy number, extension and separators, in lower case."""
    s = F.regexp_replace(F.regexp_replace(c, r"\([0-9]+\)", ""), r"\.(pdf|PDF)$", "")
    return F.lower(collapse_space(F.regexp_replace(s, r"[_\-]+", " ")))


def hex_file_name(c: Column) -> Column:
    """A file name whose dash-separated parts of four hex digits or more are UTF-8."""
    name = F.regexp_replace(F.regexp_replace(c, r"(?i)^file-[0-9a-f]+-?", ""), r"(?i)\.(pdf|pd)$", "")
    even = lambda p: F.substring(p, F.lit(1), F.length(p) - F.length(p) % 2)
    part = lambda p: F.when(p.rlike("^[0-9A-Fa-f]{4,}$"), F.regexp_replace(F.unhex(even(p)).cast("string"), "�", "")).otherwise(p)
    return collapse_space(F.translate(F.array_join(F.transform(F.split(name, "-"), part), " "), "_", " "))


def slug(c: Column, longest: int = 50, default: str = "text") -> Column:
    s = F.substring(F.regexp_replace(F.regexp_replace(c, r"[^\w\u0600-\u06FF]+", "-"), "^-+|-+$", ""), 1, longest)
    return F.coalesce(F.nullif(s, F.lit("")), F.lit(default))


def stable_id(prefix: str, *parts: Column, longest: int = 80) -> Column:
    """An identifier of safe characters, at most `longest`."""
    return F.substring(F.concat(F.lit(prefix + "-"), F.regexp_replace(F.concat_ws("-", *parts), r"[^A-Za-z0-9_\u0600-\u06FF-]+", "-")), 1, longest)


def query_id(url: Column, name: str = "IDS") -> Column:
    return F.nullif(F.regexp_extract(url, f"{name}=([0-9]+)", 1), F.lit(""))


def escape_pattern(c: Column) -> Column:
    """The text as a pattern that matches just it."""
    return F.regexp_replace(c, r"([.*+?^${}()|\[\]\\])", r"\\$1")


def fill_template(template: Column, answers: Column, blank: str = V.BLANK) -> Column:
    """{{key}} becomes the trimmed answer, or `blank` where there is none."""
    given = F.map_filter(answers, lambda k, v: trim_space(F.coalesce(v, F.lit(""))) != "")
    filled = F.aggregate(F.map_entries(given), template, lambda t, e: F.replace(t, F.concat(F.lit("{{"), e["key"], F.lit("}}")), trim_space(e["value"])))
    return F.regexp_replace(filled, r"\{\{\w+\}\}", blank)


def window_start(ts: Column, seconds: int) -> Column:
    epoch = F.unix_micros(ts.cast("timestamp"))
    return F.timestamp_micros(F.floor(epoch / (seconds * 1_000_000)) * (seconds * 1_000_000))


def resets_in(ts: Column, seconds: int) -> Column:
    """Whole seconds until the window ends, at least 1."""
    left = (F.unix_micros(window_start(ts, seconds)) + seconds * 1_000_000 - F.unix_micros(ts.cast("timestamp"))) / 1_000_000
    return F.greatest(F.lit(1), F.ceil(left)).cast("long")


def country(c: Column) -> Column:
    """A two-letter country code from such a code (upper case), a three-letter code or an English name; else null."""
    s = trim_space(text(c))
    table = lambda d: F.create_map(*(F.lit(x) for pair in d.items() for x in pair))
    return F.when(s.rlike("^[A-Z]{2}$"), s).otherwise(F.coalesce(F.try_element_at(table(V.ISO3), F.upper(s)), F.try_element_at(table(V.COUNTRY_NAMES), F.lower(s))))


def phrases(c: Column) -> Column:
    """Lines of a model's answer without bullets, numbering and quotes; blank ones are dropped."""
    clean = lambda l: trim_space(F.regexp_replace(F.regexp_replace(trim_space(l), r"^[-*••]+\s*|^[0-9]+[.)]\s*", ""), "^[\"'«]+|[\"'»]+$", ""))  # noqa: E731, E741
    return F.filter(F.transform(F.split(text(c), "\n"), clean), lambda l: l != "")  # noqa: E741


def is_official_url(c: Column) -> Column:
    """http and https addresses, spaces and letters of any script included; null is not one."""
    return F.coalesce(c.rlike(r"(?i)^\s*https?:[/\\]*[^/\\?#\s]"), F.lit(False))


def request_id() -> Column:
    """A random id for each row of a batch of requests, for the audit."""
    return F.uuid()

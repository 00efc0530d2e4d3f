"""Cutting texts into chunks, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexloom.functions import fixed as V
from lexloom.functions.text import latin_digits, let, ratio_of, text, trim_space

_EDGE = r"^[ \n\t|]+|[ \n\t|]+$"


def sliding_chunks(c: Column, size: int = 1100, overlap: int = 150) -> Column:
    """Pieces of `size` characters that overlap; an empty text has none. The places come from a sequence, not a loop."""
    step, n = size - overlap, F.length(c)
    count = F.when(n <= size, 1).otherwise(F.ceil((n - size) / step) + 1).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(c, i * step + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def _packed(paragraphs: Column, longest: int, lead: int = 0) -> Column:
    """Paragraphs joined by blank lines, greedily up to `longest` characters; lead: what the first counts above its length.

    The fold runs over lengths and keeps places only; each text is joined once, so long documents take linear time.
    """
    start = F.struct(F.array().cast("array<int>").alias("cuts"), F.lit(0).alias("held"), F.lit(0).alias("i"))

    def add(s: Column, n: Column) -> Column:
        first = s["i"] == 0
        cut = first | (s["held"] + n + 2 > longest)
        held = F.when(first, n + lead).when(cut, n).otherwise(s["held"] + n + 2)
        return F.struct(F.when(cut, F.concat(s["cuts"], F.array(s["i"]))).otherwise(s["cuts"]).alias("cuts"), held.alias("held"), (s["i"] + 1).alias("i"))

    cuts = F.aggregate(F.transform(paragraphs, F.length), start, add, lambda s: F.concat(s["cuts"], F.array(s["i"])))
    joined = lambda c: F.transform(F.slice(c, F.lit(1), F.size(c) - 1), lambda at, k: F.array_join(F.slice(paragraphs, at + 1, c[k + 1] - at), "\n\n"))
    return let(cuts, joined)


def pack_paragraphs(c: Column, longest: int = 1400, least: int = 180) -> Column:
    """Paragraphs joined greedily up to `longest` characters; a text that short passes whole, else pieces under `least` go."""

    def pieces(whole: Column) -> Column:
        packed = let(F.split(whole, r"\n{2,}"), lambda p: F.transform(_packed(p, longest), trim_space))
        return F.when(whole == "", F.array().cast("array<string>")).when(F.length(whole) <= longest, F.array(whole)).otherwise(F.filter(packed, lambda x: (x != "") & (F.length(x) >= least)))

    return let(trim_space(F.replace(text(c), F.lit("\r\n"), F.lit("\n"))), pieces)


def split_articles(c: Column, escaped: bool = True) -> Column:
    """array<struct<number, body>>: the text cut before each article heading; a preamble over 40 characters has no number."""
    tail = (r"\\?" if escaped else "") + r"[.\-–—ـ:\s]"
    number = rf"{V.ARTICLE}\s*({V.SINGLE}|[0-9۰-۹]{{1,4}}(?:\s*{V.REPEATED})?)"
    cut = rf"(?={V.ARTICLE}\s*(?:{V.SINGLE}|[0-9۰-۹]{{1,4}}(?:\s*{V.REPEATED})?){tail})"
    parts = F.filter(F.transform(F.split(text(c), cut), lambda p: F.regexp_replace(p, _EDGE, "")), lambda p: p != "")
    numbered = F.transform(parts, lambda p: F.struct(F.nullif(latin_digits(F.regexp_extract(p, "^" + number, 1)), F.lit("")).alias("number"), p.alias("body")))
    kept = F.filter(numbered, lambda s, i: (i > 0) | s["number"].isNotNull() | (F.length(s["body"]) > 40))
    return F.when(F.size(parts) <= 1, F.array(F.struct(F.lit(None).cast("string").alias("number"), text(c).alias("body")))).otherwise(kept)


def split_articles_of_scan(c: Column, least: int = 400, longest: int = 3500, share: float = 0.3) -> Column:
    """array<string> for scanned texts: a preamble stays if it names an article, or if it is long enough and Persian enough."""
    cut = rf"(?={V.ARTICLE}\s*(?:{V.SINGLE}|[0-9۰-۹]{{1,4}}(?:\s*{V.REPEATED})?)[.\-–—ـ:\s])"
    parts = F.filter(F.transform(F.split(text(c), cut), trim_space), lambda p: p != "")
    named = lambda p: p.rlike(rf"{V.ARTICLE}\s*([0-9۰-۹]{{1,4}}|{V.SINGLE})|{V.PRINCIPLE}\s*([0-9۰-۹]{{1,3}})")
    fits = lambda p: (F.length(p) >= least) & (F.length(p) <= longest) & (ratio_of(p) > share)
    kept = F.filter(parts, lambda p, i: (i > 0) | named(p) | fits(p))
    short = F.when(F.length(text(c)) > least, F.array(text(c))).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(parts) <= 1, short).otherwise(kept)


def pack_articles(pieces: Column, title: Column, kind: Column, longest: int = 1650, least: int = 220, cap: int = 6, ruling_cap: int = 3) -> Column:
    """Articles as chunks array<struct<number, body>>: long ones packed by paragraph and labelled number/part, short ones
    dropped, the title put in front where the first 160 characters lack it, and a document's chunks capped: rulings keep
    the first and the last ones, others the first."""
    pair = lambda n, b: F.struct(n.alias("number"), b.alias("body"))
    gap = F.lit("\n\n")

    def pack(a: Column) -> Column:
        def parts(bodies: Column) -> Column:
            label = lambda k: F.when(F.size(bodies) > 1, F.concat(a["number"], F.lit("/"), k.cast("string"))).otherwise(a["number"])
            return F.transform(bodies, lambda b, k: pair(label(k), b))

        def cut(body: Column) -> Column:
            return F.when(F.length(body) <= longest, F.array(pair(a["number"], body))).otherwise(let(let(F.split(body, r"\n{2,}"), lambda p: _packed(p, longest, 2)), parts))

        return let(F.regexp_replace(a["body"], _EDGE, ""), cut)

    trimmed = F.transform(F.flatten(F.transform(pieces, pack)), lambda c: pair(c["number"], F.regexp_replace(c["body"], _EDGE, "")))
    name = text(title)
    headed = lambda b: F.when((name != "") & ~F.contains(F.substring(b, 1, 160), name), F.concat(name, gap, b)).otherwise(b)
    labelled = F.transform(F.filter(trimmed, lambda c: F.length(c["body"]) >= least), lambda c: pair(c["number"], trim_space(headed(c["body"]))))
    n = F.size(labelled)
    ruling = kind == V.RULING_KIND
    return F.filter(labelled, lambda c, i: F.when(ruling, (n <= ruling_cap) | (i == 0) | (i > n - ruling_cap)).otherwise(i < cap))

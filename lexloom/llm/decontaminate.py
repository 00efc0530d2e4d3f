"""Benchmark decontamination (op5): size-partitioned MinHash containment search, verified by exact shingle containment.

DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import keyed, materialize

#: The items' shingles are broadcast while they have at most so many rows and bytes; beyond, they are joined by shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 64 << 20


def words(text: Column) -> Column:
    """The lower-cased runs of letters and digits of a text."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def shingles(text: Column, size: int, hashed: bool) -> Column:
    """All shingles of `size` words (fewer words: their whole sequence; none: no shingle), as strings or 64-bit hashes."""
    make = (lambda part: F.xxhash64(part)) if hashed else (lambda part: F.array_join(part, " "))

    def of(w: Column) -> Column:
        n = F.size(w)
        return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - (size - 1))), lambda i: make(F.slice(w, i, size))))

    # the one-element array binds the words to a lambda variable: they are split once a text, not once a shingle
    return F.array_distinct(F.coalesce(F.element_at(F.transform(F.array(words(F.coalesce(text, F.lit("")))), of), 1), F.array().cast("array<bigint>" if hashed else "array<string>")))


def contaminated(docs: DataFrame, items: DataFrame, *, shingle: int = 5, threshold: float = 0.8, votes: int = 2, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Pairs of a document and a test item it contains: __d, __t (the document's key, see keyed), item_id, n_shared, n_item, containment.

    Containment is the share of the item's distinct word shingles that the document has, at least `threshold`.

    Search: items are partitioned by size (powers of two of their number m of distinct shingles). An item's MinHash
    sketch is its k least shingle hashes, with k for its partition: floor((1 - threshold) * hi) + votes, hi the largest
    size there. Of those k, a document that contains the item lacks at most m - ceil(threshold * m), so it must show
    the rest, `votes` or more: whatever the document's length, no pair is missed and no estimate of its Jaccard index,
    which tends to 0 for short items in long documents, is needed. Every document shingle is looked up in the sketches,
    as many of them as there are, spread over all tasks. Verification: the candidates' shingles are compared as strings.

    Null or empty texts have no shingles and match nothing; texts of fewer than `shingle` words have one, their whole
    sequence, and so match only such texts. Rows of items with a null id are ignored; items that share an id are one
    item with all their shingles. Repeated document rows give one pair. Empty tables give no pairs.
    """
    sized = items.filter(F.col(item_col).isNotNull()).select(F.col(item_col).alias("item_id"), shingles(F.col(item_text_col), shingle, False).alias("s"))
    whole = materialize(sized.select("item_id", F.explode("s").alias("s")).distinct())
    held = whole.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("s") + 8), F.lit(0)).alias("size")).first()
    small = (lambda x: F.broadcast(x)) if held["n"] <= broadcast_rows and held["size"] <= BROADCAST_BYTES else (lambda x: x)
    sizes = whole.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_item"))

    need = lambda n: F.ceil(n * F.lit(threshold) - 1e-9)
    split = F.xxhash64(F.split("s", " "))  # as shingles() hashes the words of a shingle
    high = F.pow(F.lit(2), F.floor(F.log2(F.size("h"))) + 1) - 1
    k = F.least(F.size("h"), (high - need(high) + votes).cast("int"))
    sketches = whole.groupBy("item_id").agg(F.array_sort(F.collect_set(split)).alias("h")).select("item_id", F.explode(F.slice("h", 1, k)).alias("h"), (k - (F.size("h") - need(F.size("h")))).alias("must"))

    keys = keyed(docs, id_col, text_col)
    rows = docs.select(*keys, shingles(docs[text_col], shingle, True).alias("h")).select("__d", "__t", F.explode_outer("h").alias("h"))  # a plain explode infers a filter that would make the shingles twice
    hits = rows.join(small(sketches), "h").groupBy("__d", "__t", "item_id").agg(F.size(F.collect_set("h")).alias("n"), F.max("must").alias("must"))
    found = materialize(hits.filter(F.col("n") >= F.col("must")).select("__d", "__t", "item_id"))

    texts = docs.select(*keys, docs[text_col].alias("text")).join(found.select("__d", "__t").distinct(), ["__d", "__t"], "left_semi")
    parts = texts.select("__d", "__t", F.explode_outer(shingles(F.col("text"), shingle, False)).alias("s"))
    shared = parts.join(small(whole), "s").groupBy("__d", "__t", "item_id").agg(F.size(F.collect_set("s")).alias("n_shared"))
    exact = shared.join(found, ["__d", "__t", "item_id"], "left_semi").join(small(sizes), "item_id")
    return exact.filter(F.col("n_shared") >= need(F.col("n_item"))).select("__d", "__t", "item_id", F.col("n_shared").cast("long").alias("n_shared"), "n_item", (F.col("n_shared") / F.col("n_item")).alias("containment"))


def drop_contaminated(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without those that contain a test item (see contaminated)."""
    bad = contaminated(docs, items, id_col=id_col, text_col=text_col, **options).select(F.col("__d").alias("__bd"), F.col("__t").alias("__bt")).distinct()
    d, t = keyed(docs, id_col, text_col)
    return docs.withColumns({"__d": d, "__t": t}).join(bad, (F.col("__d") == F.col("__bd")) & (F.col("__t") == F.col("__bt")), "left_anti").drop("__d", "__t")

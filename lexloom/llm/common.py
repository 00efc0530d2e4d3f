"""Plumbing that the operators share: shared storage, byte views of Arrow columns, hashed exchanges."""

from __future__ import annotations

import contextlib
import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.session import broadcast_if_small, materialize

__all__ = ["NO_ID", "Exchange", "blobs_by_kind", "buckets", "bytes_of", "keyed", "lean", "materialize", "mix", "resolve", "runs", "sampled", "split_hot", "width"]

#: Stands for a null doc_id where documents are ordered: after every other document.
NO_ID = (1 << 63) - 1


def sampled(rows: DataFrame, group: str, key: str, n: int) -> DataFrame:
    """At most n rows of each group, those with the least hashes of their key, in column __turn's order.

    The groups are counted first, so that each task drops what lies above the share of hashes that n rows can need; then
    one group's task sorts little more than n rows, however large the group is.
    """
    counts = rows.groupBy(group).agg(F.count(F.lit(1)).alias("__n")).select(F.col(group).alias("__g"), (F.least(F.lit(1.0), (n + 6 * n**0.5 + 40) / F.col("__n")) * (1 << 40)).cast("long").alias("__bar"))
    hashed = F.pmod(F.xxhash64(key, F.lit(17)), F.lit(1 << 40))
    few = rows.join(materialize(counts), F.col(group) == F.col("__g")).filter(hashed < F.col("__bar")).drop("__g", "__bar")
    turn = F.row_number().over(Window.partitionBy(group).orderBy(hashed, key))
    return few.withColumn("__turn", turn).filter(F.col("__turn") <= n)


def lean(run: Callable) -> Callable:
    """run, a function over Arrow batches, after which its worker gives back the memory that it no longer uses.

    Workers are kept between tasks and stages, so what an idle one holds is missing to the others of its executor.
    """

    @functools.wraps(run)
    def leaner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # a C library without it
                ctypes.CDLL(None).malloc_trim(0)

    return leaner


def slices(batches: Iterator[pa.RecordBatch], column: int, rows: int = 256, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices of at most `rows` rows and `size` bytes of a text or binary column, or of one row."""
    for batch in batches:
        offsets = bytes_of(batch.column(column))[1]
        for i, j in runs(offsets, size):
            for at in range(i, j, rows):
                yield batch.slice(at, min(rows, j - at))


def width(spark: SparkSession) -> int:
    """How many partitions a shuffle gets."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def buckets(docs: DataFrame, per: int = 64 << 20) -> int:
    """Into how many parts what is made of docs is dealt: one for every `per` bytes of its input, a shuffle's partitions at least."""
    leaves = docs._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return max([width(docs.sparkSession), *(-(-n // per) for n in sizes if n < 1 << 60)])  # beyond: Spark does not know it


def split_hot(dealt: DataFrame, key: str, node: str, most: int, weight: Column | None = None) -> tuple[DataFrame, int]:
    """dealt with a column `cell` that deals a hot key's rows on, and how many cells the hot keys make.

    A key whose rows weigh more than `most` (a row weighs 1, or `weight`) has its nodes hashed into blocks of about half of
    that, and each of its rows goes to one cell for every other block: any two rows of the key meet in a cell, and no cell
    holds much more than `most`. The rows of any other key have cell 0. Weights are summed in each task before the shuffle.
    """
    weighed = dealt.groupBy(key).agg(F.sum(F.lit(1) if weight is None else weight).alias("__w")).filter(F.col("__w") > most)
    hot = materialize(weighed.select(F.col(key).alias("__hot"), F.ceil(F.col("__w") * 2 / most).cast("long").alias("__m")))
    cells = hot.agg(F.sum(F.col("__m") * (F.col("__m") - 1) / 2)).first()[0]
    if not cells:
        return dealt.withColumn("cell", F.lit(0).cast("long")), 0
    mine = F.pmod(F.xxhash64(node, F.lit(29)), F.col("__m"))
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("__m") - 1), lambda x: x != mine)
    cell = F.when(F.col("__m").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.transform(others, lambda x: F.least(x, mine) * F.col("__m") + F.greatest(x, mine)))
    known = dealt.join(broadcast_if_small(hot, 100_000), F.col(key) == F.col("__hot"), "left")
    return known.withColumn("cell", F.explode(cell)).drop("__hot", "__m"), int(cells)


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    """Columns __d, __t that name a row: its id (nulls last) and a 64-bit hash of its text.

    Rows equal in both are the same document seen again and get the same decision.
    """
    return [
        F.coalesce(docs[id_col].cast("long"), F.lit(NO_ID)).alias("__d"),
        F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit(""))).alias("__t"),
    ]


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column (null: empty) and the n + 1 offsets of its values."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8), offsets


def runs(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Split values into runs [i, j) of at most limit bytes, or of one value."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of uint64 values."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Exchange:
    """Packs entries of fixed-width columns into one binary per bucket, so that a shuffle moves few wide rows.

    layout: (name, numpy dtype) pairs. An entry's bucket is the number of the reducer that gets it.
    """

    schema = "bucket int, kind int, entries binary"

    def __init__(self, layout: list[tuple[str, str]], buckets: int):
        self.layout, self.buckets = layout, buckets

    def pack(self, kind: int, bucket: np.ndarray, columns: dict[str, np.ndarray]) -> pa.RecordBatch | None:
        if not len(bucket):
            return None
        order = np.argsort(bucket.astype(np.int32), kind="stable")
        sorted_bucket = bucket[order]
        at = np.flatnonzero(np.r_[True, sorted_bucket[1:] != sorted_bucket[:-1]])
        parts = [np.ascontiguousarray(columns[name].astype(kind_, copy=False)[order]) for name, kind_ in self.layout]
        ends = np.r_[at[1:], len(order)]
        blobs = [b"".join(p[a:b].tobytes() for p in parts) for a, b in zip(at.tolist(), ends.tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(sorted_bucket[at], pa.int32()), pa.array(np.full(len(at), kind), pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "kind", "entries"])

    def unpack(self, blobs: list[bytes]) -> dict[str, np.ndarray]:
        size = sum(np.dtype(k).itemsize for _, k in self.layout)
        parts: dict[str, list[np.ndarray]] = {name: [] for name, _ in self.layout}
        for blob in blobs:
            n, at = len(blob) // size, 0
            for name, kind in self.layout:
                parts[name].append(np.frombuffer(blob, kind, n, at))
                at += n * np.dtype(kind).itemsize
        return {name: np.concatenate(parts[name]) if parts[name] else np.empty(0, kind) for name, kind in self.layout}

    def deal(self, packed: DataFrame) -> DataFrame:
        """Send each bucket to the partition of its number."""
        return packed.repartitionById(self.buckets, F.col("bucket"))


def blobs_by_kind(batches: Iterator[pa.RecordBatch]) -> dict[int, list[bytes]]:
    found: dict[int, list[bytes]] = {}
    for batch in batches:
        for kind, blob in zip(batch.column("kind").to_pylist(), batch.column("entries").to_pylist(), strict=True):
            found.setdefault(kind, []).append(blob)
    return found


def resolve(path: str) -> str:
    """A vocabulary file's place on this machine: the path itself, or the public file of that name."""
    import os

    if os.path.exists(path):
        return path
    import public_tokenizers

    return public_tokenizers.path(os.path.basename(path))

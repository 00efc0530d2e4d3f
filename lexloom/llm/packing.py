"""Packing (op10): concatenate and cut, with global offsets from prefix sums over partition token totals."""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import lean, materialize, resolve, slices
from lexloom.llm.token_counts import encode_long, load

#: Both libraries' patterns read letters, numbers and space alike below this; other texts take the .json tokenizer itself.
_BEYOND = re.compile("[^\x00-ɏ]")
#: A space between two visible ASCII characters: no word of the pattern goes on over it or looks back from it.
_CUT = re.compile("(?<=[!-~]) (?=[!-~])")
#: Characters of a text that are encoded at once.
STRETCH = 1 << 16


def stretches(text: str, size: int = STRETCH) -> Iterator[str]:
    """A text in pieces that are encoded apart with the ids of the whole: `size` characters or more, up to the next cut."""
    at = 0
    while len(text) - at > size:
        found = _CUT.search(text, at + size)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:] if at else text


@functools.cache
def _quick(ranks: str, specials: tuple[tuple[str, int], ...]):
    import base64

    import public_tokenizers
    import tiktoken

    with open(resolve(ranks), "rb") as lines:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens=dict(specials))


@functools.cache
def encoder(path: str, ranks: str | None) -> Callable[[str], np.ndarray]:
    """Ids of a text by the .json tokenizer at path, special strings in texts as its default; one a worker.

    Texts of any length are encoded stretch by stretch, and a stretch without a cut in overlapping chunks (encode_long).
    ranks: a .tiktoken file of the same vocabulary, whose quicker library gives the same ids for Latin letters; what it
    does not take, such as very long runs of one kind of character, and all other texts go to the tokenizer.
    """
    tokenizer = load(path)
    whole = lambda text: tokenizer.encode(text, add_special_tokens=False)
    specials = tokenizer.get_added_tokens_decoder()
    cuts = not any(t.lstrip or t.rstrip or t.single_word or re.search(r"\s", t.content) for t in specials.values())
    quick = _quick(ranks, tuple(sorted((t.content, i) for i, t in specials.items()))) if ranks else None

    def ids(text: str) -> np.ndarray:
        if quick is not None and len(text) <= 2 * STRETCH and not _BEYOND.search(text):
            return quick.encode_to_numpy(text, allowed_special="all")
        return np.array(encode_long(text, whole), np.uint32)

    return lambda text: np.concatenate([ids(x) for x in stretches(text)]) if cuts and len(text) > STRETCH else ids(text)


def encoded(docs: DataFrame, path: str, ranks: str | None, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """First pass: doc_id, part (number of the partition), base (tokens before it there), n, ids (little-endian, 16 or 32 bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, base = encoder(path, ranks), TaskContext.get().partitionId(), 0
        for piece in slices(batches, 1):
            ids = [np.append(encode(x or ""), np.uint32(end_id)) for x in piece.column(1).to_pylist()]
            n = np.array([len(x) for x in ids], np.int64)
            starts = base + np.cumsum(n) - n
            base += int(n.sum())
            blobs = [x.astype("<u2").tobytes() if x.max() < 1 << 16 else x.astype("<u4").tobytes() for x in ids]
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(np.full(len(ids), part), pa.int32()), pa.array(starts), pa.array(n), pa.array(blobs, pa.binary())], ["doc_id", "part", "base", "n", "ids"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(lean(run), "doc_id long, part int, base long, n long, ids binary")


def pack(docs: DataFrame, path: str, *, ranks: str | None = None, size: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Lay all documents end to end and cut the line every `size` tokens.

    A document is its ids followed by end_id (null or empty text: end_id alone). Pass one writes ids and offsets within
    each partition; the totals of the partitions (one number each) are summed on the driver; pass two adds the two
    offsets and cuts at every multiple of size. All sequences but the last are full. One row per piece: doc_id, start,
    length, ids_crc32, doc_tokens, sequence_id, offset (and ids with with_ids). The order of documents is that of the
    first pass; every input row is packed, repeated rows and null ids too. An empty table gives no rows.
    """
    tokens = materialize(encoded(docs, path, ranks, end_id, id_col, text_col))
    totals = tokens.groupBy("part").agg(F.sum("n").alias("n")).collect()
    starts = np.zeros(1 + max([-1, *(r["part"] for r in totals)]), np.int64)
    for r in totals:
        starts[r["part"]] = r["n"]
    starts = np.cumsum(starts) - starts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4):
            rows: list[tuple] = []
            for doc, part, base, n, blob in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                ids = np.frombuffer(blob, "<u2" if len(blob) == 2 * n else "<u4").astype("<u4")
                at, g = 0, int(starts[part]) + base
                while at < n:
                    take = min(n - at, size - (g + at) % size)
                    cut = ids[at : at + take]
                    rows.append((doc, at, take, zlib.crc32(cut.tobytes()), n, (g + at) // size, (g + at) % size, cut if with_ids else None))
                    at += take
                if len(rows) > 20_000:
                    yield _batch(rows, with_ids)
                    rows = []
            if rows:
                yield _batch(rows, with_ids)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return tokens.select("doc_id", "part", "base", "n", "ids").mapInArrow(lean(run), schema + ", ids array<long>" * with_ids)


def _batch(rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"][: 7 + with_ids]
    columns = list(zip(*rows, strict=True))
    arrays = [pa.array(c, pa.int64()) for c in columns[:7]] + ([pa.array([x.astype(np.int64) for x in columns[7]], pa.list_(pa.int64()))] if with_ids else [])
    return pa.RecordBatch.from_arrays(arrays, names)

"""Substring dedup (op3): content-defined chunks by a gear rolling hash, deduplicated by digest, repeats extended byte by byte."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import Exchange, blobs_by_kind, buckets, bytes_of, keyed, lean, materialize, mix, runs

#: Bytes that the gear hash sees: the width of its 32-bit register.
WINDOW = 32
#: Bytes that are chunked at once, and entries that a task holds before it packs them.
RUN, HELD = 1 << 21, 1 << 20

GEAR = np.random.default_rng(20240607).integers(0, 1 << 32, 256, dtype=np.uint32)

#: k and x: the two halves of a chunk's digest; d, t, s, l: its document, start and length; m: its task has more
#: of it.
LAYOUT = [("k", "<u8"), ("x", "<u8"), ("d", "<i8"), ("t", "<i8"), ("s", "<u4"), ("l", "<u4"), ("m", "u1")]
LEFT, RIGHT = 0, 1


def digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two halves of the 128-bit BLAKE2b digest of each slice."""
    whole, make = memoryview(np.ascontiguousarray(data)), hashlib.blake2b
    made = b"".join([make(whole[a:b], digest_size=16).digest() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
    halves = np.frombuffer(made, "<u8").reshape(-1, 2)
    return halves[:, 0], halves[:, 1]


@dataclass(frozen=True)
class Chunker:
    """One place in `every` may be a cut; chunks have over `shortest` bytes (34 on average) and `longest` at most. A run of
    repeated bytes counts from `least` on."""

    every: int = 16
    shortest: int = 12
    longest: int = 1024
    least: int = 100

    def cut(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Starts of all chunks, and the end. A chunk ends where the gear hash of the last WINDOW bytes is small enough,
        unless one could end in the `shortest` bytes before.

        starts: of the texts that lie end to end in data, and the end. A cut depends on the few bytes before it alone, so an insertion changes the chunks that it touches and no others; only where no cut falls for `longest`
        bytes is one forced. A text's first cuts may come after WINDOW bytes.
        """
        h = GEAR[data]
        for s in (1, 2, 4, 8, 16):
            more = h[:-s] << np.uint32(s)
            h[s:] += more
        cuts = np.flatnonzero(h < np.uint32((1 << 32) // self.every)) + 1
        text = np.searchsorted(starts, cuts, "left") - 1
        cuts = cuts[cuts - starts[text] >= WINDOW]
        cuts = cuts[np.r_[True, np.diff(cuts) > self.shortest][: len(cuts)]]
        cuts = np.union1d(cuts, starts)
        gaps = np.diff(cuts)
        if len(gaps) and gaps.max() > self.longest:
            long_ = np.flatnonzero(gaps > self.longest)
            cuts = np.union1d(cuts, np.concatenate([np.arange(cuts[i], cuts[i + 1], self.longest) for i in long_]))
        return cuts


def long_cuts(text: np.ndarray, chunker: Chunker) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(part, cuts in it, where it begins) of a text in parts of RUN bytes, each from the last cut of the one before."""
    done = 0
    while done < len(text):
        begin = max(0, done - WINDOW)
        part = text[begin : done + RUN]
        cuts = chunker.cut(part, np.array([0, len(part)]))
        cuts = np.union1d(cuts[cuts >= done - begin], [done - begin])
        if begin + len(part) < len(text):  # the last chunk may go on in the next part
            cuts = cuts[:-1] if len(cuts) > 2 else cuts
        yield part, cuts, begin
        done = begin + int(cuts[-1])


def _chunks(data: np.ndarray, offsets: np.ndarray, chunker: Chunker) -> Iterator[dict[str, np.ndarray]]:
    """Entries of runs of whole texts; a text longer than RUN in pieces, each from the last cut of the one before."""

    def entries(part: np.ndarray, cuts: np.ndarray, row: np.ndarray, start: np.ndarray) -> dict[str, np.ndarray]:
        k, x = digests(part, cuts[:-1], cuts[1:])
        return {"row": row, "k": k, "x": x, "s": start.astype(np.uint32), "l": np.diff(cuts).astype(np.uint32)}

    for i, j in runs(offsets, RUN):
        if offsets[j] == offsets[i]:
            continue
        if j > i + 1 or offsets[j] - offsets[i] <= RUN:
            part, starts = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            cuts = chunker.cut(part, np.unique(starts))
            row = np.searchsorted(starts, cuts[:-1], "right") - 1
            yield entries(part, cuts, row + i, cuts[:-1] - starts[row])
            continue
        for part, cuts, begin in long_cuts(data[offsets[i] : offsets[j]], chunker):
            at = cuts[:-1] + begin
            yield entries(part, cuts, np.full(len(at), i), at)


def heads(e: dict[str, np.ndarray], order: np.ndarray, keys: tuple[str, ...]) -> np.ndarray:
    """Where, in entries sorted by keys, another key begins."""
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        v = e[k][order]
        new[1:] |= v[1:] != v[:-1]
    return new


def first_seen(e: dict[str, np.ndarray], keys: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(order, copy): entries sorted by keys, then document and place; copy marks those after the first place of a key."""
    order = np.lexsort((e["s"], e["t"], e["d"], *(e[k] for k in reversed(keys))))
    head = np.maximum.accumulate(np.where(heads(e, order, keys), np.arange(len(order)), 0))
    same = np.ones(len(order), bool)
    for k in ("d", "t", "s"):
        v = e[k][order]
        same &= v == v[head]
    return order, ~same


def _any(flags: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Whether a flag is set in each of the runs that begin at head."""
    return np.add.reduceat(flags.astype(np.int64), head) > 0 if len(head) else np.empty(0, bool)


def _sent(docs: DataFrame, chunker: Chunker, exchange: Exchange, id_col: str, text_col: str) -> DataFrame:
    """Entries of all chunks, dealt by digest. Within a task, copies of a chunk's first place are known as such (kind 1): they
    go anywhere, here by document, so that a frequent chunk sends one entry a task to its bucket and not all it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            e = {n: np.concatenate([h[n] for h in held]) for n, _ in exchange.layout if n != "m"}
            held.clear()
            order, copy = first_seen(e, ("k", "x"))
            head = np.flatnonzero(heads(e, order, ("k", "x")))
            e["m"] = np.zeros(len(order), np.uint8)
            e["m"][order] = np.repeat(_any(copy, head), np.diff(np.r_[head, len(order)]))
            for kind, chosen in ((0, order[~copy]), (1, order[copy])):
                part = {n: v[chosen] for n, v in e.items()}
                key = part["k"] >> np.uint64(20) if not kind else mix(part["d"].view(np.uint64))
                out = exchange.pack(kind, (key % np.uint64(exchange.buckets)).astype(np.int64), part)
                if out is not None:
                    yield out

        for batch in batches:
            d, t = (batch.column(i).to_numpy() for i in (0, 1))
            data, offsets = bytes_of(batch.column(2))
            for e in _chunks(data, offsets, chunker):
                row = e.pop("row")
                held.append(e | {"d": d[row], "t": t[row]})
                if sum(len(h["k"]) for h in held) > HELD:
                    yield from flush()
        if held:
            yield from flush()

    texts = docs.select(*keyed(docs, id_col, text_col), F.coalesce(docs[text_col].cast("string"), F.lit("")).cast("binary").alias("b"))
    return exchange.deal(texts.mapInArrow(lean(run), exchange.schema))


def places(docs: DataFrame, chunker: Chunker, id_col: str, text_col: str) -> DataFrame:
    """All places of chunks that have two or more: __d, __t, span (start << 32 | length), k, x, and first: whether it is the
    chunk's first place (smallest doc_id, then the earliest start). A first place is given once."""
    exchange = Exchange(LAYOUT, buckets(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = blobs_by_kind(batches)
        asked, known = exchange.unpack(blobs.pop(0, [])), exchange.unpack(blobs.pop(1, []))
        order, copy = first_seen(asked, ("k", "x"))
        head = np.flatnonzero(heads(asked, order, ("k", "x")))
        first = order[head[_any(copy, head) | _any(asked["m"][order], head)]]
        for is_first, e, chosen in ((True, asked, first), (False, asked, order[copy]), (False, known, np.arange(len(known["d"])))):
            for at in range(0, len(chosen), 1 << 16):
                part = {n: v[chosen[at : at + (1 << 16)]] for n, v in e.items()}
                span = (part["s"].astype(np.int64) << 32) | part["l"].astype(np.int64)
                columns = [part["d"], part["t"], span, part["k"].view(np.int64), part["x"].view(np.int64), np.full(len(span), is_first)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["__d", "__t", "span", "k", "x", "first"])

    return _sent(docs, chunker, exchange, id_col, text_col).mapInArrow(lean(run), "__d long, __t long, span long, k long, x long, first boolean")


def borders(text: np.ndarray, span: np.ndarray, chunker: Chunker, deep: int = 64) -> Iterator[tuple[int, int, int, bytes]]:
    """(index into span, side, place, bytes) for the ends of each run of adjoining spans, sorted: the bytes beyond a chunk.

    The outermost chunk may be a common phrase whose first place is another than the passage's; so all chunks within `deep`
    bytes of an end ask there. The bytes go as far as a common passage can. On the left that is the chunk before the run
    and the bytes that decide where it begins: had the passage more, that chunk would be repeated too. On the right it is
    the next chunk, and if that ends too near the asking one's start to be a cut at its first place as well, all up to the
    second cut that must be.
    """
    start, end = span >> 32, (span >> 32) + (span & 0xFFFFFFFF)
    cuts = np.unique(np.concatenate([part + begin for _, part, begin in long_cuts(text, chunker)]))
    back = WINDOW + chunker.shortest
    opens = np.flatnonzero(np.r_[True, start[1:] > end[:-1]])
    closes = np.r_[opens[1:] - 1, len(span) - 1]
    for i, j in zip(opens.tolist(), closes.tolist(), strict=True):
        before = int(np.searchsorted(cuts, start[i]))
        low = max(0, int(cuts[before - 1]) - back) if before else 0
        for k in range(i, min(j, int(np.searchsorted(start, start[i] + deep)) - 1) + 1):
            if low < start[k]:
                yield k, LEFT, int(start[k]), text[low : start[k]].tobytes()
        for k in range(max(i, int(np.searchsorted(end, end[j] - deep, "right"))), j + 1):
            after = int(np.searchsorted(cuts, end[j], "right"))
            if after < len(cuts) and cuts[after] < start[k] + back:
                after = int(np.searchsorted(cuts, start[k] + back)) + 1
            high = int(cuts[after]) if after < len(cuts) else len(text)
            if high > end[k]:
                yield k, RIGHT, int(end[k]), text[end[k] : high].tobytes()


def alike(x: bytes, y: bytes, side: int) -> int:
    """How many bytes two strings share at their ends that meet a chunk: the last ones left of it, the first ones right of it."""
    n = min(len(x), len(y))
    a, b = (np.frombuffer(z[len(z) - n :][::-1] if side == LEFT else z[:n], np.uint8) for z in (x, y))
    differ = np.flatnonzero(a != b)
    return int(differ[0]) if len(differ) else n


def extensions(texts: DataFrame, found: DataFrame, chunker: Chunker) -> DataFrame:
    """__d, __t, span of what a run of repeated chunks goes on to share with the first places of its outer ones.

    texts: keyed_bytes; found: places. Chunks at both ends of every run ask for the bytes beyond their first place (borders). A
    chunk's first place answers once for each side, with as many bytes as anyone asks for; answers meet the asking ends by
    digest, in a join that can be split where one chunk has very many places. The texts are dealt by document once: all
    joins with them share that exchange.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            rows: list[tuple] = []
            data, offsets = bytes_of(batch.column("b"))
            for row, (d, t, copies) in enumerate(zip(batch.column("__d").to_pylist(), batch.column("__t").to_pylist(), batch.column("copies"), strict=True)):
                if (d, t) in seen:  # the same document again
                    continue
                seen.add((d, t))
                values = copies.values
                span, index = np.unique(values.field(0).to_numpy(zero_copy_only=False), return_index=True)
                k, x = (values.field(i).to_numpy(zero_copy_only=False)[index].tolist() for i in (1, 2))
                rows += [(k[i], x[i], side, d, t, at, part) for i, side, at, part in borders(data[offsets[row] : offsets[row + 1]], span, chunker)]
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], ["k", "x", "side", "__d", "__t", "at", "bytes"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            rows = []
            for d, t, text, asked in zip(batch.column("__d").to_pylist(), batch.column("__t").to_pylist(), batch.column("b"), batch.column("asked").to_pylist(), strict=True):
                if (d, t) in seen:
                    continue
                seen.add((d, t))
                view = text.as_buffer()
                for q in asked:
                    a, b = q["fspan"] >> 32, (q["fspan"] >> 32) + (q["fspan"] & 0xFFFFFFFF)
                    part = view[max(0, a - q["n"]) : a] if q["side"] == LEFT else view[b : b + q["n"]]
                    rows.append((q["k"], q["x"], q["side"], bytes(part)))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], ["k", "x", "side", "there"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            side, at = batch.column("side").to_numpy(), batch.column("at").to_numpy()
            n = np.array([alike(x, y, z) for x, y, z in zip(batch.column("bytes").to_pylist(), batch.column("there").to_pylist(), side.tolist(), strict=True)], np.int64)
            span = pa.array(np.where(side == LEFT, at - n, at) << 32 | n)
            yield pa.RecordBatch.from_arrays([batch.column("__d"), batch.column("__t"), span], ["__d", "__t", "span"]).filter(pa.array(n > 0))

    def of(lists: DataFrame, column: str) -> DataFrame:
        named = lists.select(F.col("__d").alias("__cd"), F.col("__t").alias("__ct"), column)
        return texts.join(named, (F.col("__d") == F.col("__cd")) & (F.col("__t") == F.col("__ct"))).select("doc_id", "__d", "__t", "b", column)

    copies = found.filter("not first").groupBy("__d", "__t").agg(F.collect_list(F.struct("span", "k", "x")).alias("copies"))
    asks = of(copies, "copies").mapInArrow(lean(ask), "k long, x long, side int, __d long, __t long, at long, bytes binary")
    wanted = asks.groupBy("k", "x", "side").agg(F.max(F.octet_length("bytes")).alias("n"))
    firsts = found.filter("first").select("__d", "__t", "span", F.col("k").alias("fk"), F.col("x").alias("fx"))
    owners = wanted.join(firsts, (F.col("k") == F.col("fk")) & (F.col("x") == F.col("fx"))).groupBy("__d", "__t").agg(F.collect_list(F.struct("k", "x", "side", F.col("span").alias("fspan"), "n")).alias("asked"))
    answers = of(owners, "asked").mapInArrow(lean(answer), "k long, x long, side int, there binary")
    return asks.join(answers, ["k", "x", "side"]).select("__d", "__t", "side", "at", "bytes", "there").mapInArrow(lean(compare), "__d long, __t long, span long")


def repeated(docs: DataFrame, chunker: Chunker, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """__d, __t, spans: places (start << 32 | length) of a document's chunks that also start earlier (smaller doc_id, or
    same document and earlier start), and the bytes next to them that agree with those next to the chunk's first place."""
    found = materialize(places(docs, chunker, id_col, text_col))
    more = extensions(keyed_bytes(docs, id_col, text_col), found, chunker)
    return found.filter("not first").select("__d", "__t", "span").unionByName(more).groupBy("__d", "__t").agg(F.collect_list("span").alias("spans"))


def spans_to_remove(spans: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Runs [a, b) of adjoining or overlapping spans (start << 32 | length), those of fewer than `least` bytes left out."""
    spans = np.unique(spans)
    start, length = spans >> 32, spans & 0xFFFFFFFF
    reach = np.maximum.accumulate(start + length)
    head = np.flatnonzero(np.r_[True, start[1:] > reach[:-1]])
    begins, ends = start[head], reach[np.r_[head[1:] - 1, len(start) - 1]]
    return [(int(a), int(b)) for a, b in zip(begins, ends, strict=True) if b - a >= least]


def _widen(text: bytes, a: int, b: int) -> tuple[int, int]:
    """The run shrunk to whole UTF-8 characters."""
    while a < b and text[a] & 0xC0 == 0x80:
        a += 1
    while b > a and b < len(text) and text[b] & 0xC0 == 0x80:
        b -= 1
    return a, b


def with_spans(docs: DataFrame, spans: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs with column __spans (null: none), joined on the document's key."""
    d, t = keyed(docs, id_col, text_col)
    named = spans.select(F.col("__d").alias("__sd"), F.col("__t").alias("__st"), F.col("spans").alias("__spans"))
    joined = docs.withColumns({"__d": d, "__t": t}).join(named, (F.col("__d") == F.col("__sd")) & (F.col("__t") == F.col("__st")), "left")
    return joined.drop("__sd", "__st")


def keyed_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the text's bytes (null: empty) as b, and the row's key __d, __t."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).cast("binary").alias("b"), *keyed(docs, id_col, text_col))


def report(texts: DataFrame, spans: DataFrame, least: int) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of keyed_bytes: what the removal of its spans leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for d, text, found in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                text = text.as_py() or b""
                gone = spans_to_remove(np.asarray(found.values), least) if found.is_valid and len(found) else []
                kept, at = hashlib.sha256(), 0
                for a, b in gone:
                    kept.update(memoryview(text)[at:a])
                    at = b
                kept.update(memoryview(text)[at:])
                rows.append((d, len(text), sum(b - a for a, b in gone), len(gone), kept.hexdigest()))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int64()] * 4 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    named = spans.select(F.col("__d").alias("__sd"), F.col("__t").alias("__st"), F.col("spans").alias("__spans"))
    joined = texts.join(named, (F.col("__d") == F.col("__sd")) & (F.col("__t") == F.col("__st")), "left").select("doc_id", "b", "__spans")
    return joined.mapInArrow(lean(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove(docs: DataFrame, spans: DataFrame, least: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, their texts without the spans; every row and column stays. Runs are shrunk to whole characters."""
    columns = docs.columns
    place = columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(place).to_pylist()
            for i, found in enumerate(batch.column(len(columns))):
                if found.is_valid and len(found) and (gone := spans_to_remove(np.asarray(found.values), least)):
                    text, kept, at = texts[i].encode(), [], 0
                    for a, b in gone:
                        a, b = _widen(text, a, b)
                        kept.append(text[at:a])
                        at = b
                    texts[i] = b"".join([*kept, text[at:]]).decode()
            arrays = [batch.column(i) if i != place else pa.array(texts, pa.string()) for i in range(len(columns))]
            yield pa.RecordBatch.from_arrays(arrays, columns)

    joined = with_spans(docs, spans, id_col, text_col).select(*(F.col(f"`{c}`") for c in columns), "__spans")
    return joined.mapInArrow(lean(run), docs.schema)


def dedupe(docs: DataFrame, *, chunker: Chunker = Chunker(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with repeated passages removed from their texts; the first place of each stays.

    Texts are cut into content-defined chunks; a chunk whose digest also starts earlier (smaller doc_id, or same
    document and earlier start) is a repeat. Each run of adjoining repeats is extended byte by byte, to both sides, as
    far as the text agrees with that around the first places of its outer chunks, and is removed if it then has
    chunker.least bytes. Every row stays, with an empty text if all of it is repeated. Null or empty texts are left alone. Rows
    with a null id come after all others. Rows equal in id and text are one document and do not repeat each other.
    Digests are 128 bits of BLAKE2b, so that different chunks are not taken for equal. A passage that holds no whole chunk
    is not found: its first chunk starts with the first cut after some WINDOW bytes, and cuts are 34 bytes apart on average. Texts without cuts (one phrase over and over) have forced ones, where extension ends too.
    """
    return remove(docs, repeated(docs, chunker, id_col, text_col), chunker.least, id_col, text_col)

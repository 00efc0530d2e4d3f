"""Suffix-array dedup (op2): every byte that a repeated 100-byte string covers, but for the string's first place.

Places to look at are found first. Of the 32-byte strings inside each window of 100 bytes, the one with the least hash
(ties: the leftmost) is the window's anchor, so equal windows have equal anchors at equal offsets. An anchor with the
bytes around it that its windows can reach is a context. Only anchors that occur in two different contexts need more
than comparing digests; their contexts go to shards by anchor, and suffix arrays decide there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import Exchange, blobs_by_kind, buckets, bytes_of, keyed, lean, materialize, mix, runs
from lexloom.llm.substring_dedup import GEAR, digests, first_seen, keyed_bytes, report

#: Length of the strings, and of the anchors in them.
LENGTH, ANCHOR = 100, 32
#: Bytes of a window before or behind its anchor at most.
REACH = LENGTH - ANCHOR
#: Bytes that are scanned at once, entries that a task holds before it packs them, and bytes of a shard's suffix array.
RUN, HELD, SHARD = 1 << 20, 1 << 20, 1 << 20
#: Different contexts beyond which an anchor is hot, in a task or in all: its windows are then dealt one by one. Up to
#: that, a few shards hold all its contexts.
HOT = 1 << 14

PLACE = [("d", "<i8"), ("t", "<i8"), ("s", "<u4"), ("l", "<u4")]
ASKED = [("k", "<u8"), ("x", "<u8"), ("y", "<u8"), ("h", "u1"), *PLACE]
WINDOWS = [("k", "<u8"), ("x", "<u8"), *PLACE]

_SEEDED = np.random.default_rng(20240611)
_VALUE = _SEEDED.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0xD1342543DE82EF95)


_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers 0 to n of the base and of its inverse modulo 2**64, kept for the next call."""
    if len(_POWERS[0]) <= n:
        for i, base in enumerate((_BASE, _BACK)):
            p = np.full(n + 1, base, np.uint64)
            p[0] = 1
            _POWERS[i] = np.cumprod(p)
    return _POWERS


class Hasher:
    """64-bit polynomial hashes of any slices of a buffer; they depend on a slice's bytes alone."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        ahead, self.back = _powers(n)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_VALUE[data] * ahead[:n], out=self.sums[1:])

    def slices(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))


def anchors(data: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Positions of the anchors of the windows that start where `windows` is true (and end inside data)."""
    n = len(data) - LENGTH + 1
    if n <= 0 or not windows[:n].any():
        return np.empty(0, np.int64)
    h = GEAR[data]
    for s in (1, 2, 4, 8, 16):
        more = h[:-s] << np.uint32(s)
        h[s:] += more
    h = h[ANCHOR - 1 :] * np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA77)
    least = h.astype(np.uint64) << np.uint64(32) | np.arange(len(h), dtype=np.uint64)
    for s in (1, 2, 4, 8, 16, 32):
        least = np.minimum(least[:-s], least[s:])
    least = np.minimum(least[: n], least[REACH + 1 - 64 :][:n])
    return np.unique((least[windows[:n]] & np.uint64(0xFFFFFFFF)).astype(np.int64))


def contexts(data: np.ndarray, starts: np.ndarray, windows: np.ndarray) -> dict[str, np.ndarray]:
    """Contexts of the anchors of texts that lie end to end in data: text (number), k (the anchor's hash, by which they are
    dealt), x and y (a digest of the bytes, with the anchor's place in them), start and length in data."""
    at = anchors(data, windows)
    text = np.searchsorted(starts, at, "right") - 1
    begin, end = np.maximum(starts[text], at - REACH), np.minimum(starts[text + 1], at + LENGTH)
    hasher = Hasher(data)
    x, y = digests(data, begin, end)
    return {"text": text, "k": hasher.slices(at, at + ANCHOR), "x": x + (at - begin).astype(np.uint64), "y": y, "start": begin, "l": end - begin}


def entries(data: np.ndarray, offsets: np.ndarray, run: int = RUN) -> Iterator[dict[str, np.ndarray]]:
    """Entries of all texts; one longer than `run` in pieces that overlap by what contexts can reach."""
    for i, j in runs(offsets, run):
        size = int(offsets[j] - offsets[i])
        if size < LENGTH:
            continue
        if j > i + 1 or size <= run:
            part, starts = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            whole = np.ones(size, bool)
            for e in starts[1:]:
                whole[max(0, e - LENGTH + 1) : e] = False
            c = contexts(part, starts, whole)
            yield {"row": c["text"] + i, "k": c["k"], "x": c["x"], "y": c["y"], "s": c["start"] - starts[c["text"]], "l": c["l"]}
            continue
        text = data[offsets[i] : offsets[j]]
        for lo in range(0, size - LENGTH + 1, run):
            hi = min(lo + run, size - LENGTH + 1)
            begin, end = max(0, lo - REACH), min(size, hi + REACH + LENGTH)
            chosen = np.zeros(end - begin, bool)
            chosen[lo - begin : hi - begin] = True
            c = contexts(text[begin:end], np.array([0, end - begin]), chosen)
            yield {"row": np.full(len(c["k"]), i), "k": c["k"], "x": c["x"], "y": c["y"], "s": c["start"] + begin, "l": c["l"]}


def covered(e: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Places as (d, t, s, l), overlapping or adjoining ones of a document merged."""
    if not len(e["d"]):
        return {n: e[n] for n, _ in PLACE}
    order = np.lexsort((e["s"], e["t"], e["d"]))
    d, t, s, end = e["d"][order], e["t"][order], e["s"][order].astype(np.int64), (e["s"].astype(np.int64) + e["l"])[order]
    new = np.r_[True, (d[1:] != d[:-1]) | (t[1:] != t[:-1])]
    group = np.cumsum(new) - 1
    reach = np.maximum.accumulate(end + group * (1 << 33)) - group * (1 << 33)
    head = np.flatnonzero(new | np.r_[True, s[1:] > reach[:-1]])
    return {"d": d[head], "t": t[head], "s": s[head], "l": reach[np.r_[head[1:] - 1, len(s) - 1]] - s[head]}


def several(order: np.ndarray, k: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How many first places (distinct contexts) the key of each entry in `order` has; order is sorted by key."""
    key = k[order]
    head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return np.repeat(np.add.reduceat(first.astype(np.int64), head), np.diff(np.r_[head, len(key)])) if len(key) else np.empty(0, np.int64)


# ---- suffix arrays of a shard


def big_endian(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on as a number in lexicographic order, zeros behind the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    word = padded[: len(data)].astype(np.uint64)
    for i in range(1, 8):
        word = word << np.uint64(8) | padded[i : i + len(data)]
    return word


def suffix_array(word: np.ndarray, left: np.ndarray) -> np.ndarray:
    """All suffixes in order; a suffix ends where its context does (left: bytes to there), and equal ones keep text order.

    Larsson-Sadakane refinement: a suffix's rank is the place of its group's head; while groups of equal prefixes of h
    bytes remain, only their members are sorted again, by the rank h bytes on; singletons never move.
    """
    short = np.minimum(left, 8)
    first = np.where(left < 8, word >> (np.uint64(8) * (8 - short).astype(np.uint64) % np.uint64(64)) << (np.uint64(8) * (8 - short).astype(np.uint64) % np.uint64(64)), word)
    sa = np.lexsort((short, first)) if len(word) and ((word >> np.uint64(56)) == 0).any() else np.argsort(first, kind="stable")
    key, tail = first[sa], short[sa]
    head = np.r_[True, (key[1:] != key[:-1]) | (tail[1:] != tail[:-1])][: len(sa)]
    rank = np.zeros(len(word), np.int64)
    rank[sa] = np.maximum.accumulate(np.where(head, np.arange(len(sa)), 0))
    h = 8
    while True:
        open_ = np.flatnonzero(~(head & np.r_[head[1:], True][: len(head)]))
        member = sa[open_]
        if not len(open_) or not (left[member] > h).any():
            return sa
        second = np.where(left[member] > h, rank[np.minimum(member + h, len(word) - 1)] + 1, 0)
        key = rank[member].astype(np.uint64) << np.uint64(32) | second.astype(np.uint64)
        order = np.argsort(key, kind="stable")
        key, sa[open_] = key[order], member[order]
        head[open_] = np.r_[True, key[1:] != key[:-1]]
        rank[sa[open_]] = np.maximum.accumulate(np.where(head, np.arange(len(sa)), 0))[open_]
        h *= 2


def common_prefixes(word: np.ndarray, left: np.ndarray, sa: np.ndarray, starts: np.ndarray, sizes: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """lcp[r]: bytes that suffixes sa[r - 1] and sa[r] share, `depth` at most and none across a context's end.

    Kasai's walk in text order, one context a lane and all lanes in step: the next suffix shares at least one byte less
    with its neighbour than this one does with its own, so comparison goes on from there, eight bytes at a time.
    """
    place = np.empty(len(word), np.int64)
    place[sa] = np.arange(len(sa))
    lcp = np.zeros(len(sa), np.int64)
    lanes = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[lanes], sizes[lanes]
    shared = np.zeros(len(starts), np.int64)
    for j in range(int(sizes[0]) if len(sizes) else 0):
        n = int(np.searchsorted(-sizes, -j, "left"))  # lanes longer than j
        i = starts[:n] + j
        at = place[i]
        lane = np.flatnonzero(at > 0)
        shared[:n] = np.maximum(shared[:n] - 1, 0)
        off = np.flatnonzero(at <= 0)
        shared[off] = 0
        a, b, got = i[lane], sa[at[lane] - 1], shared[lane]
        most = np.minimum(np.minimum(left[a], left[b]), depth)
        live = np.flatnonzero(got < most)
        while len(live):
            differ = word[a[live] + got[live]] ^ word[b[live] + got[live]]
            top = differ & ~(differ >> np.uint64(1))  # keeps the highest bit and cannot round up to the next
            got[live] += np.where(differ == 0, 8, 7 - (np.frexp(np.maximum(top, np.uint64(1)).astype(np.float64))[1] - 1) // 8)
            live = live[(differ == 0) & (got[live] < most[live])]
        got = np.minimum(got, most)
        shared[lane] = got
        lcp[at[lane]] = got
    return lcp


def locate(word: np.ndarray, sa: np.ndarray, other: np.ndarray, wanted: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """For strings of `depth` bytes at other[wanted], the place in sa of the first equal string in word, or -1: binary search."""
    rest = depth % 8
    mask = np.uint64(((1 << 8 * rest) - 1) << 8 * (8 - rest)) if rest else np.uint64(0)

    def compare(at: np.ndarray) -> np.ndarray:
        sign = np.zeros(len(wanted), np.int8)
        for o in range(0, depth, 8):
            a, b = word[at + o], other[wanted + o]
            if o + 8 > depth:
                a, b = a & mask, b & mask
            sign = np.where(sign == 0, np.where(a < b, -1, np.where(a > b, 1, 0)), sign)
        return sign

    lo, hi = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(sa))
    while len(wanted) and (lo < hi).any():
        mid = (lo + hi) // 2
        less = (compare(sa[np.minimum(mid, len(sa) - 1)]) < 0) & (lo < hi)
        lo, hi = np.where(less, mid + 1, lo), np.where(less | (lo >= hi), hi, mid)
    found = np.minimum(lo, max(0, len(sa) - 1))
    return np.where((lo < len(sa)) & (compare(sa[found]) == 0), found, -1) if len(sa) else np.full(len(wanted), -1)


class Shard:
    """Contexts with their suffix array: classes of equal strings of LENGTH bytes, and which places are not the first."""

    def __init__(self, data: np.ndarray, e: dict[str, np.ndarray]):
        sizes = e["l"].astype(np.int64)
        self.e, self.starts = e, np.cumsum(sizes) - sizes
        lane = np.repeat(np.arange(len(sizes)), sizes)
        left = np.repeat(self.starts + sizes, sizes) - np.arange(len(data))
        self.word = big_endian(data)
        sa = suffix_array(self.word, left)
        lcp = common_prefixes(self.word, left, sa, self.starts, sizes)
        whole = left[sa] >= LENGTH
        # strings in order; a class goes on where the common prefix with all between is whole
        low = np.minimum(lcp, LENGTH)
        cut = np.cumsum(low < LENGTH)[whole]
        self.sa = sa[whole]
        self.head = np.flatnonzero(np.r_[True, cut[1:] != cut[:-1]]) if len(self.sa) else np.empty(0, np.int64)
        self.group = np.repeat(np.arange(len(self.head)), np.diff(np.r_[self.head, len(self.sa)]))
        self.lane = lane[self.sa]
        self.place = e["s"][self.lane].astype(np.int64) + self.sa - self.starts[self.lane]
        order = np.lexsort((self.place, e["t"][self.lane], e["d"][self.lane], self.group))
        self.first = order[self.head] if len(self.head) else self.head  # the index of each class's first place
        f = self.first[self.group]
        self.gone = self.key(np.arange(len(self.sa))) != self.key(f)

    def key(self, index: np.ndarray) -> np.ndarray:
        """(d, t, place) as records that compare."""
        out = np.empty(len(index), [("d", "i8"), ("t", "i8"), ("p", "i8")])
        out["d"], out["t"], out["p"] = self.e["d"][self.lane[index]], self.e["t"][self.lane[index]], self.place[index]
        return out

    def merge(self, later: Shard) -> None:
        """Of each class that both shards have, the later first place is no longer a first place."""
        if not len(self.head) or not len(later.head):
            return
        found = locate(self.word, self.sa[self.head], later.word, later.sa[later.head])
        theirs = np.flatnonzero(found >= 0)
        ours = found[theirs]
        a, b = self.key(self.first[ours]), later.key(later.first[theirs])
        less = np.lexsort((np.r_[a["p"], b["p"]], np.r_[a["t"], b["t"]], np.r_[a["d"], b["d"]]))
        rank = np.empty(len(less), np.int64)
        rank[less] = np.arange(len(less))
        earlier = rank[: len(a)] < rank[len(a) :]
        differ = a != b
        later.gone[later.first[theirs[earlier & differ]]] = True
        self.gone[self.first[ours[~earlier & differ]]] = True

    def removed(self) -> dict[str, np.ndarray]:
        i = np.flatnonzero(self.gone)
        return covered({"d": self.e["d"][self.lane[i]], "t": self.e["t"][self.lane[i]], "s": self.place[i], "l": np.full(len(i), LENGTH)})


def resolve(data: np.ndarray, e: dict[str, np.ndarray], shard: int = SHARD) -> Iterator[dict[str, np.ndarray]]:
    """Removed places of contexts (bytes end to end in data), shard by shard; shards that cut a key's contexts are merged."""
    sizes = e["l"].astype(np.int64)
    at = np.cumsum(sizes) - sizes
    order = np.argsort(e["k"], kind="stable")
    ends = np.cumsum(sizes[order])
    i, open_ = 0, []
    while i < len(order):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + shard, "right")))
        if j < len(order):  # end with a whole key where one ends inside
            cut = np.flatnonzero(np.diff(e["k"][order[i : j + 1]]) != 0)
            j = i + int(cut[-1]) + 1 if len(cut) else j
        part = order[i:j]
        n = sizes[part]
        index = np.repeat(at[part] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        made = Shard(data[index], {name: v[part] for name, v in e.items()})
        if open_ and e["k"][order[i]] != e["k"][order[i - 1]]:
            yield from (s.removed() for s in open_)
            open_ = []
        for s in open_:
            s.merge(made)
        open_.append(made)
        i = j
    yield from (s.removed() for s in open_)


# ---- the operator


def _asked(docs: DataFrame, id_col: str, text_col: str, most: int, parts: int) -> DataFrame:
    """Contexts as digests, dealt by anchor. Kinds: 0 asked (h: hot in its task), 1 removed already, 2 hot already."""
    exchange = Exchange(ASKED, parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            e = {n: np.concatenate([h[n] for h in held]) for n, _ in ASKED if n != "h"}
            held.clear()
            order, copy = first_seen(e, ("k", "x", "y"))
            contexts_ = several(order, e["k"], ~copy)
            hot = contexts_ > most
            key = e["k"][order]
            head = np.maximum.accumulate(np.where(np.r_[True, key[1:] != key[:-1]], np.arange(len(key)), 0))
            known = hot & ~copy & (np.arange(len(key)) - head >= 2)  # two contexts are asked for, so that others learn of it
            for kind, chosen in ((0, ~copy & ~known), (1, copy), (2, known)):
                part = {n: v[order[chosen]] for n, v in e.items()}
                if kind == 1:
                    part = covered(part)
                    part |= {n: np.zeros(len(part["d"]), np.uint64) for n in ("k", "x", "y")}
                part["h"] = hot[chosen].astype(np.uint8) if kind != 1 else np.zeros(len(part["d"]), np.uint8)
                spread = part["k"] >> np.uint64(20) if not kind else mix(part["d"].view(np.uint64))
                out = exchange.pack(kind, (spread % np.uint64(exchange.buckets)).astype(np.int64), part)
                if out is not None:
                    yield out

        for batch in batches:
            d, t = (batch.column(i).to_numpy() for i in (0, 1))
            data, offsets = bytes_of(batch.column(2))
            for e in entries(data, offsets):
                row = e.pop("row")
                held.append(e | {"d": d[row], "t": t[row]})
                if sum(len(h["k"]) for h in held) > HELD:
                    yield from flush()
        if held:
            yield from flush()

    texts = docs.select(*keyed(docs, id_col, text_col), F.coalesce(docs[text_col].cast("string"), F.lit("")).cast("binary").alias("b"))
    return exchange.deal(texts.mapInArrow(lean(run), exchange.schema))


def _told(asked: DataFrame, most: int, parts: int) -> DataFrame:
    """__d, __t, kind, span, k: 0 removed, 1 to be compared under anchor k, 2 to be compared window by window.

    Heat is judged here, by an anchor's contexts in all tasks; a task that had very many itself has said so.
    """
    exchange = Exchange(ASKED, parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = blobs_by_kind(batches)
        e, removed, hot = (exchange.unpack(blobs.get(kind, [])) for kind in (0, 1, 2))
        order, copy = first_seen(e, ("k", "x", "y"))
        many = several(order, e["k"], ~copy)
        heat = (many > most) | (several(order, e["k"], e["h"][order] > 0) > 0)
        pick = lambda mask: {n: v[order[mask]] for n, v in e.items()}
        gone = covered(pick(copy))
        parts = [(0, gone), (0, removed), (1, pick(~copy & (many > 1) & ~heat)), (2, pick(~copy & heat)), (2, hot)]
        for kind, p in parts:
            if len(p["d"]):
                span = (p["s"].astype(np.int64) << 32) | p["l"].astype(np.int64)
                k = p["k"].view(np.int64) if kind == 1 else np.zeros(len(span), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(p["d"]), pa.array(p["t"]), pa.array(np.full(len(span), kind, np.int32)), pa.array(span), pa.array(k)], ["__d", "__t", "kind", "span", "k"])

    return asked.mapInArrow(lean(run), "__d long, __t long, kind int, span long, k long")


def _decided(texts: DataFrame, told: DataFrame, parts: int, shard: int) -> DataFrame:
    """__d, __t, span of the places that suffix arrays (and, for hot anchors, window digests) find repeated."""
    windows = Exchange(WINDOWS, parts)
    named = Exchange([("k", "<u8"), *PLACE], parts)
    compared = told.filter("kind > 0").groupBy("__d", "__t").agg(
        F.collect_list(F.when(F.col("kind") == 1, F.struct("span", "k"))).alias("asks"), F.collect_list(F.when(F.col("kind") == 2, F.col("span"))).alias("hot")
    )
    compared = compared.select(F.col("__d").alias("__cd"), F.col("__t").alias("__ct"), "asks", "hot")
    joined = texts.join(compared, (F.col("__d") == F.col("__cd")) & (F.col("__t") == F.col("__ct"))).select("doc_id", "__d", "__t", "b", "asks", "hot")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asks: list[tuple[np.ndarray, ...]] = []
        hots: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal size
            if asks:
                d, t, s, n, k, text = (np.concatenate([a[i] for a in asks]) for i in range(6))
                bucket = (k >> np.uint64(20)) % np.uint64(parts)
                order = np.argsort(bucket, kind="stable")
                at = np.cumsum(n) - n
                for b in np.unique(bucket):
                    part = order[np.searchsorted(bucket[order], b, "left") : np.searchsorted(bucket[order], b, "right")]
                    index = np.repeat(at[part] - (np.cumsum(n[part]) - n[part]), n[part]) + np.arange(n[part].sum())
                    entry = named.pack(0, np.full(len(part), b, np.int64), {"k": k[part], "d": d[part], "t": t[part], "s": s[part], "l": n[part]})
                    yield pa.RecordBatch.from_arrays([*entry.columns, pa.array([text[index].tobytes()], pa.binary())], ["bucket", "kind", "entries", "bytes"])
            if hots:
                d, t, s, k, x = (np.concatenate([h[i] for h in hots]) for i in range(5))
                e = {"d": d, "t": t, "s": s, "k": k, "x": x, "l": np.full(len(d), LENGTH, np.uint32)}
                order, copy = first_seen(e, ("k", "x"))
                for kind, chosen in ((1, order[~copy]), (2, order[copy])):
                    p = {n_: v[chosen] for n_, v in e.items()}
                    if kind == 2:
                        p = covered(p)
                        p |= {n_: np.zeros(len(p["d"]), np.uint64) for n_ in ("k", "x")}
                    key = p["k"] >> np.uint64(20) if kind == 1 else mix(p["d"].view(np.uint64))
                    out = windows.pack(kind, (key % np.uint64(parts)).astype(np.int64), p)
                    if out is not None:
                        yield pa.RecordBatch.from_arrays([*out.columns, pa.array([b""] * out.num_rows, pa.binary())], ["bucket", "kind", "entries", "bytes"])
            asks.clear()
            hots.clear()
            size = 0

        for batch in batches:
            d, t = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            data, offsets = bytes_of(batch.column(3))
            seen: set[tuple[int, int]] = set()
            for row in range(batch.num_rows):
                if (int(d[row]), int(t[row])) in seen:  # the same document again
                    continue
                seen.add((int(d[row]), int(t[row])))
                text = data[offsets[row] : offsets[row + 1]]
                ask = batch.column(4)[row].values
                if len(ask):
                    span, k = ask.field(0).to_numpy(zero_copy_only=False), ask.field(1).to_numpy(zero_copy_only=False)
                    s, n = span >> 32, span & 0xFFFFFFFF
                    index = np.repeat(s - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    asks.append((np.full(len(s), d[row]), np.full(len(s), t[row]), s.astype(np.uint32), n, k.view(np.uint64), text[index]))
                    size += len(index)
                hot = batch.column(5)[row].values
                if len(hot):
                    span = hot.to_numpy(zero_copy_only=False)
                    places = np.unique(np.concatenate([np.arange(a >> 32, (a >> 32) + (a & 0xFFFFFFFF) - LENGTH + 1) for a in span]))
                    k, x = digests(text, places, places + LENGTH)
                    hots.append((np.full(len(places), d[row]), np.full(len(places), t[row]), places.astype(np.uint32), k, x))
                    size += 40 * len(places)
                if size > 24 << 20:
                    yield from flush()
        yield from flush()

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs: dict[int, list[bytes]] = {}
        texts_: list[bytes] = []
        for batch in batches:
            for kind, blob, text in zip(*(batch.column(n).to_pylist() for n in ("kind", "entries", "bytes")), strict=True):
                blobs.setdefault(kind, []).append(blob)
                if kind == 0:
                    texts_.append(text)
        found: list[dict[str, np.ndarray]] = []
        e = named.unpack(blobs.get(0, []))
        if len(e["k"]):
            found += resolve(np.frombuffer(b"".join(texts_), np.uint8), e, shard)
        w = windows.unpack(blobs.get(1, []))
        order, copy = first_seen(w, ("k", "x"))
        found += [covered({n: v[order[copy]] for n, v in w.items()}), windows.unpack(blobs.get(2, []))]
        for p in found:
            if len(p["d"]):
                span = (p["s"].astype(np.int64) << 32) | p["l"].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(p["d"]), pa.array(p["t"]), pa.array(span)], ["__d", "__t", "span"])

    sent = joined.mapInArrow(lean(send), "bucket int, kind int, entries binary, bytes binary")
    return sent.repartitionById(parts, F.col("bucket")).mapInArrow(lean(decide), "__d long, __t long, span long")


def repeated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, shard: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """(texts, spans): texts with doc_id, b, __d, __t; spans with __d, __t and the repeated places (start << 32 | length)."""
    parts = buckets(docs, 32 << 20)
    told = materialize(_told(_asked(docs, id_col, text_col, hot, parts), hot, parts))
    texts = keyed_bytes(docs, id_col, text_col)
    more = _decided(texts, told, parts, shard)
    spans = told.filter("kind = 0").select("__d", "__t", "span").unionByName(more).groupBy("__d", "__t").agg(F.collect_list("span").alias("spans"))
    return texts, spans


def removal_report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, shard: int = SHARD) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row.

    Removed is each byte covered by a 100-byte string that also starts earlier: in a document with a smaller doc_id, or
    in the same one further left; overlaps count, and strings are judged on the input. Matches never cross documents.
    Null and empty texts, and texts under 100 bytes, lose nothing. Null ids come after all others. Rows equal in id and
    text are one document (they do not repeat each other and get the same result); of rows that share an id but not
    the text, the order is that of a hash of the text. hot: different contexts of an anchor beyond which its windows
    are compared one by one, by 128-bit digests combined in each task, and not in suffix arrays; shard: bytes of a suffix
    array. Neither changes the result. Contexts that are equal as a whole are found by digest too, so that copies do not
    fill the arrays; digests are BLAKE2b. Other columns are not read. An empty table gives no rows.
    """
    texts, spans = repeated(docs, id_col=id_col, text_col=text_col, hot=hot, shard=shard)
    return report(texts, spans, 1)

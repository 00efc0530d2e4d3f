"""Vector code compression (op12): product codes whose codebooks are learned by Lloyd's rounds with partition-local heaps."""

from __future__ import annotations

import functools
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import lean, materialize
from lexloom.llm.integer_vectors import MOST, floors, largest, usable
from lexloom.session import broadcast_if_small

#: Rows of a block: one row of the state, whose heaps hold parts of these rows only.
BLOCK = 1 << 14
#: Distances that a scan holds at once.
HELD = 1 << 20
#: What rounding may add to a bound: a part of its size, and a length.
RELATIVE, ABSOLUTE = 1e-12, 1e-6

STATE = ["ids", "labels", "vectors", "owners", "sizes", "keys", "members", "at", "sums"]


class Codebooks:
    """Entries of every part, (parts, entries, width) integers, and the drift that each entry's bounds have borne so far."""

    def __init__(self, entries: np.ndarray, drift: np.ndarray):
        self.entries, self.drift = entries, drift

    @classmethod
    def first(cls, entries: np.ndarray) -> Codebooks:
        return cls(entries, np.zeros(entries.shape[:2]))

    def moved(self, entries: np.ndarray) -> Codebooks:
        """The next entries. What separates a part from the others may shrink by its own entry's way and the longest of the others'."""
        way = np.sqrt(((entries - self.entries).astype(float) ** 2).sum(axis=2)) * (1 + RELATIVE)
        if way.shape[1] == 1:
            return Codebooks(entries, self.drift + way)
        order = np.sort(way, axis=1)
        return Codebooks(entries, self.drift + way + np.where(way == order[:, -1:], order[:, -2:-1], order[:, -1:]))


def two_nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest entry of each part (ties: the lower index), its squared distance and that of the next nearest, exact.

    Distances go through doubles where they are below 2**53, and so exact there, else through longs.
    """
    top = int(np.abs(parts).max(initial=0)) + int(np.abs(entries).max(initial=0))
    kind = np.float64 if parts.shape[1] * top * top < 1 << 51 else np.int64
    own, first, second = np.empty(len(parts), np.int64), np.empty(len(parts), np.int64), np.empty(len(parts), np.int64)
    book = entries.astype(kind)
    lengths = (book * book).sum(axis=1)
    step = max(1, HELD // len(book))
    for at in range(0, len(parts), step):
        x = parts[at : at + step].astype(kind)
        away = ((x * x).sum(axis=1)[:, None] - 2 * (x @ book.T) + lengths).astype(np.int64)
        best = away.argmin(axis=1)
        own[at : at + step], first[at : at + step] = best, away[np.arange(len(x)), best]
        away[np.arange(len(x)), best] = np.iinfo(np.int64).max
        second[at : at + step] = away.min(axis=1)
    return own, first, second


class Heaps:
    """The heaps of one part of a block, one for each entry: (key, row) pairs in heap order, all of them end to end.

    A key is the slack of a row's bounds, lower minus upper, plus the drift that its entry had borne when the key was made;
    as long as it is above the entry's drift, no other entry can be as near.
    """

    def __init__(self, sizes: np.ndarray, keys: np.ndarray, members: np.ndarray):
        self.sizes, self.keys, self.members = sizes, keys, members

    def pop(self, drift: np.ndarray) -> tuple[np.ndarray, list[list[tuple[float, int]] | None]]:
        """The rows whose bounds the drift has violated, taken off, and what is left of the heaps that gave any."""
        ends = np.cumsum(self.sizes)
        starts, bar = ends - self.sizes, drift * (1 + RELATIVE) + ABSOLUTE
        left: list[list[tuple[float, int]] | None] = [None] * len(self.sizes)
        popped: list[int] = []
        for e in np.flatnonzero(self.sizes):
            a, b = starts[e], ends[e]
            if self.keys[a] > bar[e]:
                continue
            heap = list(zip(self.keys[a:b].tolist(), self.members[a:b].tolist(), strict=True))
            while heap and heap[0][0] <= bar[e]:
                popped.append(heapq.heappop(heap)[1])
            left[e] = heap
        return np.array(popped, np.int64), left

    def pushed(self, left: list[list[tuple[float, int]] | None], owners: np.ndarray, keys: np.ndarray, members: np.ndarray) -> Heaps:
        """The heaps with rows added to their owners' heaps; left: what pop gave."""
        ends = np.cumsum(self.sizes)
        starts = ends - self.sizes
        for e in np.unique(owners):
            if left[e] is None:
                a, b = starts[e], ends[e]
                left[e] = list(zip(self.keys[a:b].tolist(), self.members[a:b].tolist(), strict=True))
        for e, key, member in zip(owners.tolist(), keys.tolist(), members.tolist(), strict=True):
            heapq.heappush(left[e], (key, member))
        sizes = np.array([self.sizes[e] if heap is None else len(heap) for e, heap in enumerate(left)], np.int32)
        keys_ = [self.keys[a:b] if heap is None else np.array([x[0] for x in heap]) for a, b, heap in zip(starts, ends, left, strict=True)]
        members_ = [self.members[a:b] if heap is None else np.array([x[1] for x in heap], np.int32) for a, b, heap in zip(starts, ends, left, strict=True)]
        return Heaps(sizes, np.concatenate(keys_), np.concatenate(members_).astype(np.int32))


def reassign(vectors: np.ndarray, owners: np.ndarray | None, heaps: list[Heaps] | None, books: Codebooks) -> tuple[np.ndarray, list[Heaps], list[tuple[int, np.ndarray]], int]:
    """(owners, heaps, changes of the sums, rescanned parts) of a block, vectors (rows, parts, width), under books.

    Only parts that are popped are compared with all entries. A change is (part * entries + entry, [rows, sums...]).
    """
    n, parts, width = vectors.shape
    entries = books.entries.shape[1]
    before, heaps_, changes, scanned = owners, [], [], 0
    owners = np.zeros((n, parts), np.uint8) if before is None else before.copy()
    for j in range(parts):
        if heaps is None:
            held, (rows, left) = Heaps(np.zeros(entries, np.int32), np.empty(0), np.empty(0, np.int32)), (np.arange(n), [None] * entries)
        else:
            held, (rows, left) = heaps[j], heaps[j].pop(books.drift[j])
        scanned += len(rows)
        x = vectors[rows, j].astype(np.int64)
        own, first, second = two_nearest(x, books.entries[j])
        lower = np.sqrt(second.astype(float)) * (1 - RELATIVE) if entries > 1 else np.full(len(rows), np.inf)
        keys = lower - np.sqrt(first.astype(float)) * (1 + RELATIVE) + books.drift[j][own]
        heaps_.append(held.pushed(left, own, keys, rows))
        for gone, e in ((False, own), (True, None if before is None else before[rows, j].astype(np.int64))):
            if e is not None and len(e):
                turned = own != before[rows, j] if before is not None else np.ones(len(rows), bool)
                for entry in np.unique(e[turned]):
                    its = turned & (e == entry)
                    sums = np.r_[its.sum(), x[its].sum(axis=0)]
                    changes.append((j * entries + int(entry), -sums if gone else sums))
        owners[rows, j] = own
    return owners, heaps_, changes, scanned


def compress(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 1024, parts: int = 4, size: int = 256, rounds: int = 4) -> DataFrame:
    """vec_id, label, code, error, label_error, codebooks_sha256 of every usable row.

    Every component x counts as floor(scale * x); vectors are cut into `parts` equal parts. The codebook of each part starts
    as that part of the rows of the `size` smallest ids (ties by the vector, null ids last; fewer rows make fewer entries).
    Each round assigns every part to its nearest entry (squared Euclidean distance, ties to the lower index) and replaces
    each entry by floor(sum / count) of its parts; entries without parts stay. Parts are assigned once more at the end.

    Rows are packed into blocks, each one row of a written table together with a heap for every entry. A round pops the
    parts whose slack the entries' drift has used up, compares these with all entries and pushes them again; the others
    keep their entry, which is then strictly the nearest. Bounds are widened by more than their rounding. A block also
    gives what it adds to and takes from the entries' sums; only these changes, summed by entry and component, go to the
    driver: size * (dimensions + parts) numbers at most, as many as the codebooks hold. The state of a round is deleted once the next is
    written.

    error: the squared distances of a row's parts to their entries. label_error: its sum over the rows of the same label,
    nulls together. code: two hex digits for each part. Rows whose vector is null, empty or holds null or non-finite
    components are dropped, as are rows of another length than the commonest (ties: the longest). If that is no multiple
    of `parts`, zeros fill the last part up. Repeated rows count one by one; an empty table gives no rows. Other columns
    are ignored. Where sums might not fit into a long, a ValueError says so.
    """
    spark = vectors.sparkSession
    found = usable(vectors, id_col, vector_col, __label=F.col(label_col))
    kind = vectors.schema[label_col].dataType
    length = F.size("__x").alias("dims")
    common = found.groupBy(length).agg(F.count(F.lit(1)).alias("n"), largest(scale).alias("most")).orderBy(F.desc("n"), F.desc("dims")).first()
    schema = f"vec_id long, label {kind.simpleString()}, code string, error long, label_error long, codebooks_sha256 string"
    if common is None:
        return spark.createDataFrame([], schema)
    dims, most, n = common["dims"], common["most"], common["n"]
    width = -(-dims // parts)
    if 4 * parts * width * most**2 >= MOST or n * most >= MOST:
        raise ValueError(f"components up to {most:g} in {n} vectors of {dims} make sums that do not fit into a long")
    narrow = next(t for t, b in (("<i2", 15), ("<i4", 31), ("<i8", 63)) if most < 1 << b)
    rows = found.filter(F.size("__x") == dims).select("__id", "__label", floors(scale, most).alias("__v"))
    start = rows.orderBy(F.col("__id").asc_nulls_last(), "__v").limit(size).select("__v").collect()

    def cut(table: np.ndarray) -> np.ndarray:
        return np.pad(table, ((0, 0), (0, parts * width - dims))).reshape(len(table), parts, width)

    books = Codebooks.first(cut(np.array([r["__v"] for r in start], np.int64)).transpose(1, 0, 2).copy())
    entries = books.entries.shape[1]
    state_schema = f"ids array<long>, labels array<{kind.simpleString()}>, vectors binary, owners binary, sizes binary, keys binary, members binary, at array<int>, sums array<long>"

    def told(ids: pa.Array, labels: pa.Array, vectors_: np.ndarray, owners: np.ndarray, heaps: list[Heaps], changes: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        blob = lambda x: pa.array([x.tobytes()], pa.binary())
        one = lambda x, offset: pa.ListArray.from_arrays(pa.array([0, offset], pa.int32()), x)
        at, sums = np.array([c[0] for c in changes], np.int32), np.concatenate([np.empty(0, np.int64), *(c[1] for c in changes)]).astype(np.int64)
        joined = [np.concatenate([getattr(h, name) for h in heaps]) for name in ("sizes", "keys", "members")]
        return pa.RecordBatch.from_arrays([one(ids, len(ids)), one(labels, len(labels)), blob(vectors_), blob(owners), *map(blob, joined), one(pa.array(at), len(at)), one(pa.array(sums), len(sums))], STATE)

    def begin(books: Codebooks, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, BLOCK):
                part = batch.slice(first, BLOCK)
                table = cut(part.column("__v").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, dims).astype(narrow))
                owners, heaps, changes, _ = reassign(table, None, None, books)
                yield told(part.column("__id"), part.column("__label"), table, owners, heaps, changes)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray, np.ndarray, list[Heaps]]]:
        for batch in batches:
            for i in range(batch.num_rows):
                blob = {c: batch.column(c)[i].as_buffer() for c in ("vectors", "owners", "sizes", "keys", "members")}
                table = np.frombuffer(blob["vectors"], narrow).reshape(-1, parts, width)
                sizes = np.frombuffer(blob["sizes"], np.int32).reshape(parts, entries)
                keys, members = (np.frombuffer(blob[c], t).reshape(parts, len(table)) for c, t in (("keys", np.float64), ("members", np.int32)))
                heaps = [Heaps(sizes[j], keys[j], members[j]) for j in range(parts)]
                yield batch.column("ids")[i].values, batch.column("labels")[i].values, table, np.frombuffer(blob["owners"], np.uint8).reshape(-1, parts), heaps

    def again(books: Codebooks, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, labels, table, owners, heaps in blocks(batches):
            owners, heaps, changes, _ = reassign(table, owners, heaps, books)
            yield told(ids, labels, table, owners, heaps, changes)

    def end(books: Codebooks, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, labels, table, owners, heaps in blocks(batches):
            owners, _, _, _ = reassign(table, owners, heaps, books)
            away = table.astype(np.int64) - books.entries[np.arange(parts), owners]
            digits = owners.tobytes().hex()
            codes = [digits[i : i + 2 * parts] for i in range(0, len(digits), 2 * parts)]
            yield pa.RecordBatch.from_arrays([ids, labels, pa.array(codes, pa.string()), pa.array((away**2).sum(axis=(1, 2)))], ["vec_id", "label", "code", "error"])

    state, totals = None, np.zeros((parts * entries, 1 + width), np.int64)
    for _ in range(rounds):
        old = state
        step = functools.partial(begin if old is None else again, books)
        state = materialize((rows if old is None else old).mapInArrow(lean(step), state_schema))
        if old is not None:
            discard(old)
        each = state.select(F.posexplode("at").alias("i", "at"), "sums").select("at", F.posexplode(F.slice("sums", F.col("i") * (1 + width) + 1, 1 + width)).alias("c", "s"))
        for change in each.groupBy("at", "c").agg(F.sum("s").alias("s")).collect():
            totals[change["at"], change["c"]] += change["s"]
        counts, sums = totals[:, :1], totals[:, 1:]
        means = np.where(counts > 0, sums // np.maximum(counts, 1), books.entries.reshape(-1, width))
        books = books.moved(means.reshape(books.entries.shape))
    step = functools.partial(end, books)
    coded = materialize((state if state is not None else materialize(rows.mapInArrow(lean(functools.partial(begin, books)), state_schema))).mapInArrow(lean(step), f"vec_id long, label {kind.simpleString()}, code string, error long"))
    if state is not None:
        discard(state)
    digest = hashlib.sha256(",".join(map(str, books.entries.reshape(-1).tolist())).encode()).hexdigest()
    by_label = coded.groupBy(F.col("label").alias("__label")).agg(F.sum("error").alias("label_error"))
    known = coded.join(broadcast_if_small(by_label, 100_000), F.col("label").eqNullSafe(F.col("__label")))
    return known.select("vec_id", "label", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def discard(written: DataFrame) -> None:
    """Delete the folder of a table that `materialize` wrote and that nothing reads any more."""
    spark = written.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(written.inputFiles()[0]).getParent()
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

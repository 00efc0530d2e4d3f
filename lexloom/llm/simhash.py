"""SimHash near-duplicates (op7): fingerprints linked by a binary trie self-join with a Hamming error budget."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import buckets, keyed, lean, materialize, split_hot

#: Node pairs that are expanded at once; a pair of nodes of at most LEAF pairs of members is compared directly, COMPARED pairs at once.
FRONT, LEAF, COMPARED = 1 << 18, 64, 1 << 18
#: MinHash values of a document that wide_links pairs up: at a similarity of 0.8, two of six are shared but once in 600.
KEYS = 6
#: A task's share of one key: rows of a block of bits, rows of a pair of MinHash values, bytes of a candidate component (a node counts
#: NODE at least). What exceeds it is split into cells, in which any two of its rows meet.
BLOCK_ROWS, PAIR_ROWS, SET_BYTES, NODE = 1 << 20, 1 << 17, 32 << 20, 4096


def shingle_hashes(text: bytes, shingle: int = 3, seed: int = 42) -> Iterator[np.ndarray]:
    """Hashes of all shingles, block by block: A-Z lower-cased, words cut at ASCII white space; fewer words: their sequence."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    n = len(words)
    if not n:
        return
    joined = b" ".join(words)
    if n <= shingle:
        yield np.array([xxh64_intdigest(joined, seed)], "<u8")
        return
    lengths = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lengths + 1) - 1
    begins, ends = (ends - lengths)[: n - shingle + 1].tolist(), ends[shingle - 1 :].tolist()
    for at in range(0, len(begins), 1 << 14):
        block = zip(begins[at : at + (1 << 14)], ends[at : at + (1 << 14)], strict=True)
        yield np.array([xxh64_intdigest(joined[a:b], seed) for a, b in block], "<u8")


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> np.uint64:
    """The SimHash of a text: a bit is set if over half the shingle hashes have it; without words it is 0."""
    return _sketched(text, shingle, seed, None)[0]


def _sketched(text: bytes, shingle: int, seed: int, turns: np.ndarray | None) -> tuple[np.uint64, np.ndarray | None, int]:
    """(SimHash, MinHash values under the permutations x * turns[0] + turns[1], digest of the shingle set)."""
    from xxhash import xxh64_intdigest

    ones, n, held = np.zeros(64, np.int64), 0, []
    least = None if turns is None else np.full(turns.shape[1], (1 << 64) - 1, np.uint64)
    for hashes in shingle_hashes(text, shingle, seed):
        n += len(hashes)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        if turns is not None:
            held.append(hashes)
            for at in range(0, len(hashes), 1024):
                least = np.minimum(least, (hashes[at : at + 1024, None] * turns[0] + turns[1]).min(axis=0))
    digest = xxh64_intdigest(np.unique(np.concatenate(held)).tobytes() if held else b"", seed)
    return np.packbits(2 * ones > n, bitorder="little").view("<u8")[0], least, digest


def fingerprints(docs: DataFrame, *, shingle: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x or b"", shingle, seed) for x in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").cast("binary").alias("text")).mapInArrow(lean(run), "doc_id long, fp long")


def _unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Merge the sets of a[i] and b[i]; parent[i] is the least index of i's set."""
    while True:
        x, y = parent[a], parent[b]
        if not (x != y).any():
            return parent
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up


def _first_set(r: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """Where in each sorted range [lo, hi), of values that agree above `bit`, that bit begins to be set."""
    a, b = lo.copy(), hi.copy()
    while (live := a < b).any():
        mid = (a + b) >> 1
        set_ = (r[np.minimum(mid, len(r) - 1)] & bit) != 0
        a, b = np.where(live & ~set_, mid + 1, a), np.where(live & set_, mid, b)
    return a


def trie_links(r: np.ndarray, lo: np.ndarray, hi: np.ndarray, top: int, budget: int, alike: Callable | None = None) -> np.ndarray:
    """Join the binary trie of each range [lo, hi) of r (sorted within it, equal in the first `top` bits) with itself.

    Pairs of nodes are walked down together, bit by bit, with the number of bits in which their paths differ; a pair is
    dropped when that exceeds the budget, or when all its members are linked already. alike(i, j) may refuse pairs of
    members that are within the budget. Returns for each value the index of the least one it is linked to, directly or
    over others of its range.
    """
    parent = np.arange(len(r))
    lo, hi = lo[hi - lo > 1], hi[hi - lo > 1]
    stack = [(lo, hi, lo, hi, np.full(len(lo), top), np.zeros(len(lo), np.int64))]
    while stack:
        front = stack.pop()
        if len(front[0]) > FRONT:
            stack.append(tuple(x[FRONT:] for x in front))
            front = tuple(x[:FRONT] for x in front)
        step = np.r_[0, np.cumsum(parent[1:] != parent[:-1])]
        lo1, hi1, lo2, hi2, depth, diff = front
        joined = (step[hi1 - 1] == step[lo1]) & (step[hi2 - 1] == step[lo2]) & (parent[lo1] == parent[lo2])
        lo1, hi1, lo2, hi2, depth, diff = (x[~joined] for x in front)
        if not len(lo1):
            continue
        small = ((hi1 - lo1) * (hi2 - lo2) <= LEAF) | (depth >= 64)
        if small.any():
            first, second, width2 = lo1[small], lo2[small], (hi2 - lo2)[small]
            pairs = (hi1 - lo1)[small] * width2
            upto, at = np.cumsum(pairs), 0
            while at < len(pairs):
                end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + COMPARED, "right")))
                a, b, size2, count = first[at:end], second[at:end], width2[at:end], pairs[at:end]
                which = np.repeat(np.arange(len(a)), count)
                k = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
                i, j = a[which] + k // size2[which], b[which] + k % size2[which]
                near = np.flatnonzero((i < j) & (parent[i] != parent[j]) & (np.bitwise_count(r[i] ^ r[j]) <= budget))
                if alike is not None and len(near):
                    near = near[alike(i[near], j[near])]
                parent = _unite(parent, i[near], j[near])
                at = end
        lo1, hi1, lo2, hi2, depth, diff = (x[~small] for x in (lo1, hi1, lo2, hi2, depth, diff))
        if not len(lo1):
            continue
        bit = np.uint64(1) << (63 - depth).astype(np.uint64)
        mid1, mid2 = _first_set(r, lo1, hi1, bit), _first_set(r, lo2, hi2, bit)
        other = lo1 != lo2
        children = [(lo1, mid1, lo2, mid2, diff, None), (mid1, hi1, mid2, hi2, diff, None), (lo1, mid1, mid2, hi2, diff + 1, None), (mid1, hi1, lo2, mid2, diff + 1, other)]
        parts = []
        for a1, b1, a2, b2, d, only in children:
            ok = (b1 > a1) & (b2 > a2) & (d <= budget) & ((a1 != a2) | (b1 - a1 > 1))
            if only is not None:
                ok &= only
            parts.append(tuple(x[ok] for x in (a1, b1, a2, b2, depth + 1, d)))
        stack.append(tuple(np.concatenate(x) for x in zip(*parts, strict=True)))
    return parent


def links(distinct: DataFrame, budget: int = 3, partitions: int = 1, most: int = BLOCK_ROWS) -> DataFrame:
    """(a, b) pairs that span every group of distinct fingerprints (column fp) within budget bits of each other.

    Of budget + 1 blocks of bits, two fingerprints within the budget share one: so each fingerprint goes to budget + 1
    tries, rotated to start with one of its blocks, and is met there by all that share the block. Work is dealt by
    (block, its value) over `partitions` tasks or more; a value that more than `most` fingerprints share is split into
    cells. A cell emits at most one link for each fingerprint it holds, however many are close.
    """
    blocks = budget + 1
    spans = [(64 * b // blocks, 64 * (b + 1) // blocks - 64 * b // blocks) for b in range(blocks)]
    turned = F.array(*(F.struct(F.lit(b).alias("b"), (F.shiftleft("fp", at).bitwiseOR(F.shiftrightunsigned("fp", 64 - at)) if at else F.col("fp")).alias("r"), F.shiftrightunsigned(F.shiftleft("fp", at), 64 - bits).alias("v")) for b, (at, bits) in enumerate(spans)))
    dealt = distinct.select("fp", F.explode(turned).alias("x")).select("fp", "x.b", "x.r", F.xxhash64("x.b", "x.v").alias("key"))
    dealt, cells = split_hot(dealt, "key", "fp", most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [tuple(x.column(i).to_numpy() for i in range(3)) for x in batches]
        if not held:
            return
        block, value, cell = (np.concatenate([x[i] for x in held]) for i in range(3))
        held.clear()
        value = value.view(np.uint64)
        for b, (at, bits) in enumerate(spans):
            r, c = value[block == b], cell[block == b]
            if not len(r):
                continue
            order = np.lexsort((r, c))
            r, c = r[order], c[order]
            cuts = np.flatnonzero((np.diff(c) != 0) | (np.diff(r >> np.uint64(64 - bits)) != 0)) + 1
            parent = trie_links(r, np.r_[0, cuts], np.r_[cuts, len(r)], bits, budget)
            child = np.flatnonzero(parent != np.arange(len(r)))
            back = (lambda x: x) if not at else (lambda x, at=np.uint64(at): x >> at | x << np.uint64(64 - int(at)))
            yield pa.RecordBatch.from_arrays([pa.array(back(r[child]).view(np.int64)), pa.array(back(r[parent[child]]).view(np.int64))], ["a", "b"])

    return dealt.repartition(partitions + cells, "key", "cell").select("b", "r", "cell").mapInArrow(lean(run), "a long, b long")


def components(pairs: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every linked node but the roots: root is the least node that can be reached.

    Alternates large-star and small-star steps over the pairs (columns a, b) until nothing changes; each round is
    written to the shared folder, and only a count and a checksum reach the driver.
    """
    state = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    edges = materialize(pairs.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = state(edges)
    for _ in range(rounds if before[0] else 0):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written, so that both sides of the joins are plain shuffles and a node with very many neighbours can be split
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m")))
        large = materialize(both.filter("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m"))
        small = large.join(least, F.col("u") == F.col("w")).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        edges = materialize(small.filter("u <> v").distinct())
        after = state(edges)
        if after == before:
            break
        before = after
    else:
        if before[0]:
            raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, *, shingle: int = 3, budget: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp and component_id of every row.

    Rows are linked if their fingerprints differ in at most `budget` bits; component_id is the smallest doc_id that can
    be reached over links, the row's own included. A null, empty or blank text has fingerprint 0 and is linked like any
    other. Equal fingerprints collapse into one trie member before any join, so copies cost nothing; repeated rows keep
    their own result rows; a null id is never a component_id unless no row of the component has an id. Empty table: no
    rows. Other columns are not read.
    """
    found = materialize(fingerprints(docs, shingle=shingle, seed=seed, id_col=id_col, text_col=text_col))
    classes = found.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(classes.select("fp"), budget, buckets(docs)))
    rooted = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    # written, so that both sides of the join are plain shuffles and a large component can be split
    smallest = materialize(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    named = rooted.join(smallest, "root").select(F.col("fp").alias("__fp"), "component_id")
    return found.join(named, found["fp"] == named["__fp"]).select("doc_id", "fp", "component_id")


def sketches(docs: DataFrame, *, shingle: int, keys: int, sketch: int, seed: int, id_col: str, text_col: str) -> DataFrame:
    """__d, __t, k (a digest of the shingle set), fp, m (the first `keys` MinHash values) and sketch (a byte of each of `sketch` MinHash values) of every row."""
    turns = np.random.default_rng(seed).integers(0, 1 << 63, (2, max(keys, sketch)), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_sketched(x or b"", shingle, seed, turns) for x in batch.column(2).to_pylist()]
            prints, digests = (np.array([f[i] for f in found], np.uint64).view(np.int64) for i in (0, 2))
            least = pa.array([m[:keys].view(np.int64) for _, m, _ in found], pa.list_(pa.int64()))
            bytes_ = pa.array([(m[:sketch] & np.uint64(0xFF)).astype(np.uint8).tobytes() for _, m, _ in found], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests), pa.array(prints), least, bytes_], ["__d", "__t", "k", "fp", "m", "sketch"])

    texts = docs.select(*keyed(docs, id_col, text_col), docs[text_col].cast("string").cast("binary").alias("text"))
    return texts.mapInArrow(lean(run), "__d long, __t long, k long, fp long, m array<long>, sketch binary")


def wide_links(distinct: DataFrame, budget: int, least: int, keys: int = KEYS, partitions: int = 1, most: int = PAIR_ROWS) -> DataFrame:
    """(a, b) pairs of nodes that span the groups of fingerprints within a budget too wide for shared blocks of bits.

    distinct: k (the node), fp, m, sketch. Two documents alike enough share two MinHash values or more; so each node
    goes to one trie for every pair of its values, and meets there only what shares that pair. There the tries are joined
    within the Hamming budget, and a pair counts if `least` bytes of its sketches agree. Dealt by value pair over
    `partitions` tasks or more; a pair that more than `most` nodes share is split into cells. A cell emits at most one
    link for each node it holds.
    """
    pairs = [(i, j) for j in range(keys) for i in range(j)]
    spread = F.explode(F.array(*(F.xxhash64(F.lit(i), F.lit(j), F.col("m")[i], F.col("m")[j]) for i, j in pairs))).alias("key")
    dealt, cells = split_hot(distinct.select("k", "fp", "sketch", spread), "key", "k", most)
    dealt = dealt.repartition(partitions + cells, "key", "cell").select("key", "cell", "fp", "k", "sketch")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(*(x.column(i).to_numpy() for i in range(4)), np.frombuffer(b"".join(x.column(4).to_pylist()), np.uint8).reshape(x.num_rows, -1)) for x in batches if x.num_rows]
        if not held:
            return
        key, cell, value, node, sketch = (np.concatenate([h[i] for h in held]) for i in range(5))
        held.clear()
        value = value.view(np.uint64)
        order = np.lexsort((value, cell, key))
        key, cell, value, node, sketch = (x[order] for x in (key, cell, value, node, sketch))
        cuts = np.flatnonzero((np.diff(key) != 0) | (np.diff(cell) != 0)) + 1
        alike = lambda i, j: np.concatenate([(sketch[i[a : a + 65536]] == sketch[j[a : a + 65536]]).sum(axis=1) >= least for a in range(0, len(i), 65536)])
        parent = trie_links(value, np.r_[0, cuts], np.r_[cuts, len(key)], 0, budget, alike)
        child = np.flatnonzero(parent != np.arange(len(key)))
        yield pa.RecordBatch.from_arrays([pa.array(node[child]), pa.array(node[parent[child]])], ["a", "b"])

    return dealt.mapInArrow(lean(run), "a long, b long").filter("a <> b").distinct()


def similar(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Whether the Jaccard index of two sorted sets is `similarity` or more; two empty sets are equal."""
    if min(len(x), len(y)) < similarity * max(len(x), len(y)) - 1e-9:
        return False
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return shared >= similarity * (len(x) + len(y) - shared) - 1e-9


def confirmed_roots(nodes: list[int], sketch: np.ndarray, sets: list[np.ndarray], least: int, similarity: float) -> np.ndarray:
    """For each node the index of the least one that it reaches over exact links: pairs with `least` equal sketch bytes are
    compared as sets, unless they are joined already. nodes are in order."""
    parent = np.arange(len(nodes))
    for i in range(len(nodes) - 1):
        for j in i + 1 + np.flatnonzero((parent[i + 1 :] != parent[i]) & ((sketch[i + 1 :] == sketch[i]).sum(axis=1) >= least)):
            if parent[i] != parent[j] and similar(sets[i], sets[j], similarity):
                lo, hi = sorted((parent[i], parent[j]))
                parent[parent == hi] = lo
    return parent


def confirm(docs: DataFrame, roots: DataFrame, classes: DataFrame, *, least: int, similarity: float, shingle: int, seed: int, id_col: str, text_col: str, most: int = SET_BYTES) -> DataFrame:
    """(node, root) of the components that stay when each link is an exact Jaccard index of `similarity` or more.

    roots: components of the candidate links; an exact component lies within one of them. Every node's set is compared
    with its root's first; a component that this confirms as a whole is done, however large. The others go to
    confirmed_roots: in one task up to `most` bytes of sets, beyond that in cells in which any two of its nodes meet and
    whose links are joined to components again.
    """
    linked = classes.join(roots.select("node", "root").unionByName(roots.select(F.col("root").alias("node"), "root").distinct()), F.col("k") == F.col("node")).select("k", "root", "sketch", F.col("least.__d").alias("__cd"), F.col("least.__t").alias("__ct"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [np.unique(np.concatenate([*shingle_hashes(x or b"", shingle, seed), np.empty(0, "<u8")])).tobytes() for x in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(made, pa.binary())], ["k", "root", "sketch", "hashes"])

    texts = docs.select(*keyed(docs, id_col, text_col), docs[text_col].cast("string").cast("binary").alias("text"))
    texts = texts.join(linked, (F.col("__d") == F.col("__cd")) & (F.col("__t") == F.col("__ct"))).select("k", "root", "sketch", "text")
    sets = materialize(texts.mapInArrow(lean(run), "k long, root long, sketch binary, hashes binary"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [similar(np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8"), similarity) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok, pa.bool_())], ["node", "root", "ok"])

    # written, so that both sides of the join are plain shuffles and a large component can be split
    pivots = materialize(sets.filter("k = root").dropDuplicates(["root"]).select(F.col("root").alias("p"), F.col("hashes").alias("of_root")))
    star = sets.filter("k <> root").join(pivots, F.col("root") == F.col("p")).select("k", "root", "hashes", "of_root")
    star = materialize(star.mapInArrow(lean(compare), "node long, root long, ok boolean"))
    open_ = star.filter("not ok").select(F.col("root").alias("o")).distinct()

    def settle(group: pa.Table) -> pa.Table:
        at = np.argsort(group.column("k").to_numpy())
        nodes, first = np.unique(group.column("k").to_numpy()[at], return_index=True)
        rows = group.take(pa.array(at[first]))
        sketch = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint8).reshape(len(nodes), -1)
        parent = confirmed_roots(nodes, sketch, [np.frombuffer(x.as_buffer(), "<u8") for x in rows.column("hashes")], least, similarity)
        child = np.flatnonzero(parent != np.arange(len(nodes)))
        return pa.table({"node": nodes[child], "root": nodes[parent[child]], "cell": np.full(len(child), group.column("cell")[0].as_py())})

    doubtful, cells = split_hot(sets.join(open_, F.col("root") == F.col("o"), "left_semi"), "root", "k", most, F.length("hashes") + NODE)
    settled = doubtful.groupBy("root", "cell").applyInArrow(settle, "node long, root long, cell long")
    if cells:
        settled = materialize(settled)
        split = components(settled.filter("cell > 0").select(F.col("node").alias("a"), F.col("root").alias("b")))
        settled = settled.filter("cell = 0").select("node", "root").unionByName(split)
    whole = star.join(open_, F.col("root") == F.col("o"), "left_anti").select("node", "root").distinct()
    return materialize(whole.unionByName(settled.select("node", "root")))


def drop_near_duplicates(docs: DataFrame, *, shingle: int = 5, similarity: float = 0.8, budget: int = 18, keys: int = KEYS, sketch: int = 128, slack: float = 0.09, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of near duplicates: that with the smallest id.

    Near duplicates have a Jaccard similarity of their word shingles of `similarity` or more, which at 64 bits may put
    their fingerprints `budget` bits apart (see wide_links). `sketch` MinHash bytes estimate the similarity, and
    similarity - slack of the estimate, two and a half standard errors below, makes a candidate; a candidate is a link
    only if its shingle sets confirm it (see confirm). Texts with equal shingle sets are one node.
    Rows with a null id come after all others (of two, the one whose text hash is smaller stays); of rows equal in id
    and text one stays. Blank texts are duplicates of each other. Every column stays; an empty table gives no rows.
    """
    found = materialize(sketches(docs, shingle=shingle, keys=keys, sketch=sketch, seed=seed, id_col=id_col, text_col=text_col))
    classes = found.groupBy("k").agg(F.min(F.struct("__d", "__t")).alias("least"), F.min(F.struct("fp", "m", "sketch")).alias("one")).select("k", "least", "one.*")
    agreed = int(np.ceil((similarity - slack) * sketch))
    roots = components(wide_links(classes.select("k", "fp", "m", "sketch"), budget, agreed, keys, buckets(docs)))
    roots = confirm(docs, roots, classes, least=agreed, similarity=similarity, shingle=shingle, seed=seed, id_col=id_col, text_col=text_col)
    rooted = classes.join(roots, classes["k"] == roots["node"], "left").select("k", "least", F.coalesce("root", "k").alias("root"))
    # written, so that both sides of the join are plain shuffles and a large component can be split
    smallest = materialize(rooted.groupBy("root").agg(F.min("least").alias("first")))
    named = rooted.join(smallest, "root").select(F.col("k").alias("__k"), "first")
    rows = found.groupBy("__d", "__t", "k").agg(F.count(F.lit(1)).alias("n")).join(named, F.col("k") == F.col("__k"))
    rows = materialize(rows.select("__d", "__t", "n", (F.struct("__d", "__t") == F.col("first")).alias("stays")))
    gone = rows.filter("not stays").select(F.col("__d").alias("__gd"), F.col("__t").alias("__gt"))
    d, t = keyed(docs, id_col, text_col)
    kept = docs.withColumns({"__d": d, "__t": t}).join(gone, (F.col("__d") == F.col("__gd")) & (F.col("__t") == F.col("__gt")), "left_anti")
    if rows.filter("stays and n > 1").limit(1).count():
        kept = kept.dropDuplicates(["__d", "__t"])
    return kept.drop("__d", "__t")

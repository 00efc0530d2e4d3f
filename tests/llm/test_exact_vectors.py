"""op11 and op12 against brute force, with bad vectors, ties, repeated rows and ids, and clashing columns."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.llm import heap_lloyd, topk

SCHEMA = "vec_id long, embedding array<float>, label int"


def usable(x):
    return x is not None and len(x) > 0 and all(c is not None and math.isfinite(c) for c in x)


def whole(x):
    return [math.floor(1024 * float(np.float32(c))) for c in x]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 10))
    found = [(i, [float(c) for c in np.float32(centres[i % 6] + 0.2 * rng.normal(size=10))], i % 4 if i % 7 else None) for i in range(330)]
    found += [(400 + i, found[0][1], 1) for i in range(40)]  # many copies of a query's vector
    found += [(100, found[5][1], 2), (100, found[5][1], 2), (7, found[8][1], 3), (7, found[8][1], 3)]  # repeated ids, of queries and of others
    found += [(1000, [0.0] * 10, 2), (1001, [-c for c in found[0][1]], 1), (None, found[1][1], None), (None, found[0][1], 0)]
    bad = [(1100, None, 1), (1200, [], 1), (1300, [1.0] * 9 + [float("nan")], 1), (1400, [float("inf")] + [1.0] * 9, 1), (1500, [1.0, None] + [1.0] * 8, 1)]
    return found + bad


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def brute_top(rows, k=10, modulus=100):
    kept = [(n, i, whole(x)) for n, (i, x, _) in enumerate(rows) if usable(x)]
    out = []
    for n, i, q in kept:
        if i is None or i % modulus:
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, c, strict=True)), math.inf if j is None else j) for m, j, c in kept if m != n and len(c) == len(q))
        out += [(i, at + 1, None if j == math.inf else j, -s) for at, (s, j) in enumerate(scored[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize(("parts", "block", "query_block"), [(2, 1 << 13, 512), (3, 64, 2), (12, 200, 512)])
def test_op11_equals_brute_force(spark, rows, parts, block, query_block):
    found = topk.top_inner_products(frame(spark, rows), lambda i: i % 100 == 0, parts=parts, block=block, query_block=query_block)
    assert found.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    assert sorted(map(tuple, found.collect()), key=str) == brute_top(rows)


def test_op11_few_rows_clashes_lengths_and_overflow(spark, rows):
    query = lambda i: i % 100 == 0
    few = rows[:4]
    clashing = frame(spark, few).withColumns({n: F.lit("x") for n in ("g", "r", "j", "s", "n", "__r", "own", "best", "score", "query_id", "cutoff", "share", "at", "x")})
    assert sorted(map(tuple, topk.top_inner_products(clashing, query).collect()), key=str) == brute_top(few)
    assert topk.top_inner_products(frame(spark, few).limit(0), query).count() == 0
    assert topk.top_inner_products(frame(spark, [(100, None, 1)]), query).count() == 0
    mixed = [*rows[:20], *((2000 + i, [0.5 * i, 1.0], 1) for i in range(5))]
    assert sorted(map(tuple, topk.top_inner_products(frame(spark, mixed), query).collect()), key=str) == brute_top(mixed)
    large = [(100 * i, [2.0**18 * (i + 1), -(2.0**17)], 1) for i in range(4)]  # products beyond 2**53
    assert sorted(map(tuple, topk.top_inner_products(frame(spark, large), query).collect()), key=str) == brute_top(large)
    with pytest.raises(ValueError, match="do not fit"):
        topk.top_inner_products(frame(spark, [(100, [1e30, 1.0], 1)]), query)


def test_op11_sends_only_entries_above_their_share(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 64)) / 8
    x[1:30] = x[0] + rng.normal(size=(29, 64)) / 80
    table = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = topk.top_inner_products(table, lambda i: i == 0).collect()
    ints = np.floor(1024 * x).astype(np.int64)
    scores = ints @ ints[0]
    assert [r.vec_id for r in sorted(found, key=lambda r: r.rank)] == sorted(range(1, 3000), key=lambda i: (-scores[i], i))[:10]
    eleventh = int(np.sort(scores)[-11])
    shares = sum(int((ints[:, a : a + 32] @ ints[0, a : a + 32] >= eleventh // 2).sum()) for a in (0, 32))
    assert shares < 0.05 * 2 * 3000


def brute_codes(rows, parts=4, size=256, rounds=4):
    kept = [(i, whole(x), label) for i, x, label in rows if usable(x)]
    dims = max(len(x) for _, x, _ in kept)
    kept = [r for r in kept if len(r[1]) == dims]
    width = -(-dims // parts)
    pad = lambda x: np.array(x + [0] * (parts * width - dims), dtype=np.int64).reshape(parts, width)
    first = sorted(kept, key=lambda r: (math.inf if r[0] is None else r[0], r[1]))[:size]
    books = np.array([pad(x) for _, x, _ in first]).transpose(1, 0, 2)
    x = np.array([pad(v) for _, v, _ in kept])
    for step in range(rounds + 1):
        away = ((x[:, :, None, :] - books[None]) ** 2).sum(axis=3)
        own = away.argmin(axis=2)
        if step < rounds:
            for j in range(parts):
                for e in set(own[:, j].tolist()):
                    its = x[own[:, j] == e, j]
                    books[j, e] = its.sum(axis=0) // len(its)
    error = away.min(axis=2).sum(axis=1).tolist()
    by_label = {}
    for (_, _, label), e in zip(kept, error, strict=True):
        by_label[label] = by_label.get(label, 0) + e
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    return sorted(((i, label, bytes(o).hex(), e, by_label[label], digest) for (i, _, label), o, e in zip(kept, own.tolist(), error, strict=True)), key=str)


@pytest.mark.parametrize(("parts", "size", "rounds"), [(4, 256, 4), (5, 16, 6), (2, 1, 2), (5, 40, 0)])
def test_op12_equals_brute_force(spark, rows, monkeypatch, parts, size, rounds):
    monkeypatch.setattr(heap_lloyd, "BLOCK", 70)
    clashing = frame(spark, rows).withColumns({n: F.lit("x") for n in ("code", "error", "at", "i", "c", "s", "n", "ids", "labels", "__v", "label_error")})
    found = heap_lloyd.compress(clashing, parts=parts, size=size, rounds=rounds)
    assert sorted(map(tuple, found.collect()), key=str) == brute_codes(rows, parts, size, rounds)


def test_op12_edges(spark, rows):
    assert heap_lloyd.compress(frame(spark, rows).limit(0)).count() == 0
    assert heap_lloyd.compress(frame(spark, rows[-5:])).columns == ["vec_id", "label", "code", "error", "label_error", "codebooks_sha256"]
    one = [(3, [0.25, -0.1, 7.0], None)]
    assert sorted(map(tuple, heap_lloyd.compress(frame(spark, one)).collect())) == brute_codes(one)
    mixed = [*rows[:9], (50, [1.0, 2.0], 1)]  # of another length than the commonest
    assert sorted(map(tuple, heap_lloyd.compress(frame(spark, mixed)).collect()), key=str) == brute_codes(mixed)
    with pytest.raises(ValueError, match="do not fit"):
        heap_lloyd.compress(frame(spark, [(1, [1e30], 1)]))


def test_heaps_pop_only_what_the_drift_has_violated():
    rng = np.random.default_rng(11)
    x = rng.integers(-2000, 2000, size=(4000, 4, 6)) + 9000 * rng.integers(0, 12, size=(4000, 4, 1))
    books = heap_lloyd.Codebooks.first(x[:40].transpose(1, 0, 2).copy())
    owners, heaps, _, scanned = heap_lloyd.reassign(x, None, None, books)
    assert scanned == 16_000
    rescanned = []
    for _ in range(8):
        entries = books.entries.copy()
        for j in range(4):
            for e in set(owners[:, j].tolist()):
                entries[j, e] = x[owners[:, j] == e, j].sum(axis=0) // (owners[:, j] == e).sum()
        books = books.moved(entries)
        owners, heaps, _, scanned = heap_lloyd.reassign(x, owners, heaps, books)
        rescanned.append(scanned)
        for j in range(4):
            assert (owners[:, j] == heap_lloyd.two_nearest(x[:, j], entries[j])[0]).all()
            for h in np.split(heaps[j].keys, np.cumsum(heaps[j].sizes)[:-1]):
                assert all(h[(i - 1) // 2] <= h[i] for i in range(1, len(h)))
    assert rescanned[-1] < 0.6 * 16_000 and sum(rescanned) < 8 * 16_000


def test_ties_are_always_rescanned():
    x = np.array([[[0]], [[10]], [[5]]])  # the last is as near to either entry
    books = heap_lloyd.Codebooks.first(np.array([[[0], [10]]]))
    owners, heaps, _, _ = heap_lloyd.reassign(x, None, None, books)
    assert owners.ravel().tolist() == [0, 1, 0]
    owners, _, _, scanned = heap_lloyd.reassign(x, owners, heaps, books.moved(books.entries))
    assert owners.ravel().tolist() == [0, 1, 0] and scanned == 1

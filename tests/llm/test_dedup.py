import hashlib
from collections import defaultdict

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from lexloom.llm import simhash, substring_dedup, suffix_dedup
from lexloom.llm.common import NO_ID
from tests.llm.conftest import prose


def distinct_documents(corpus):
    """(id, text) of the distinct documents in order; texts that share an id keep apart."""
    return sorted({(NO_ID if d is None else d, t or "") for d, t, *_ in corpus})


def brute_op2(documents, length=100):
    seen, out = set(), {}
    for d, t in documents:
        b = t.encode()
        hit = np.zeros(len(b) + 1, int)
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            if w in seen:
                hit[k] += 1
                hit[k + length] -= 1
            seen.add(w)
        gone = np.cumsum(hit)[: len(b)] > 0
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out[d, t] = (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize(("hot", "shard"), [(256, 1 << 20), (10**9, 1500), (2, 1500)])
def test_op2_equals_brute_force(spark, corpus, docs, hot, shard):
    found = defaultdict(list)
    for r in suffix_dedup.removal_report(docs, hot=hot, shard=shard).collect():
        found[NO_ID if r.doc_id is None else r.doc_id].append(tuple(r)[1:])
    for (d, _), want in brute_op2(distinct_documents(corpus)).items():
        if d not in (8, NO_ID):  # two texts share id 8, two have none
            assert all(x == want for x in found[d]), d
    assert sum(map(len, found.values())) == len(corpus)
    null = {x[0]: x[1] for x in found[NO_ID]}
    copied = len(corpus[3][1])
    assert null[copied] == copied  # a null id comes after its copy
    assert len(found[7]) == 3


def test_op2_arrays_decide_anchors_with_many_contexts(spark):
    """A passage in 300 texts over many tasks: its outer anchors have some 300 contexts each, all sent to the arrays."""
    rows = [(i, f"{prose(90_000 + i, 12)} {prose(5, 24)} {prose(91_000 + i, 12)}") for i in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    told = suffix_dedup._told(suffix_dedup._asked(frame, "doc_id", "text", suffix_dedup.HOT, 8), suffix_dedup.HOT, 8).collect()
    by = defaultdict(int)
    for r in told:
        by[r.k] += r.kind == 1
    assert max(by.values()) >= 290 and not any(r.kind == 2 for r in told)
    want = brute_op2(rows)
    assert {(r.doc_id, *r[1:]) for r in suffix_dedup.removal_report(frame, shard=20_000).collect()} == {(d, *want[d, t]) for d, t in rows}


def test_op2_long_texts_in_pieces_equal_whole():
    rng = np.random.default_rng(3)
    text = rng.integers(97, 105, 60_000).astype(np.uint8)
    text[40_000:41_000] = text[5_000:6_000]
    offsets = np.array([0, len(text)])
    sets = []
    for run in (1 << 20, 7_000):
        e = list(suffix_dedup.entries(text, offsets, run))
        sets.append({(int(k), int(x), int(s), int(n)) for p in e for k, x, s, n in zip(p["k"], p["x"], p["s"], p["l"])})
    assert sets[0] == sets[1]


def test_suffix_array_and_common_prefixes_equal_sorting():
    rng = np.random.default_rng(5)
    sizes = np.array([40, 1, 9, 60, 25])
    data = rng.choice(np.array([0, 97, 98], np.uint8), sizes.sum())
    data[60:85] = data[5:30]
    starts = np.cumsum(sizes) - sizes
    left = np.repeat(starts + sizes, sizes) - np.arange(len(data))
    word = suffix_dedup.big_endian(data)
    sa = suffix_dedup.suffix_array(word, left)
    suffix = [bytes(data[i : i + left[i]]) for i in range(len(data))]
    assert list(sa) == sorted(range(len(data)), key=lambda i: (suffix[i], i))
    lcp = suffix_dedup.common_prefixes(word, left, sa, starts, sizes, 30)
    for r in range(1, len(sa)):
        a, b = suffix[sa[r - 1]], suffix[sa[r]]
        n = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
        assert lcp[r] == min(n, 30)


def test_op2_edges(empty, clashing, corpus):
    assert suffix_dedup.removal_report(empty).count() == 0
    assert suffix_dedup.removal_report(clashing).count() == len(corpus)


def test_op3_removes_repeats_only(spark, corpus, docs):
    chunker = substring_dedup.Chunker()
    rows = substring_dedup.report(substring_dedup.keyed_bytes(docs), substring_dedup.repeated(docs, chunker), chunker.least).collect()
    assert len(rows) == len(corpus)
    by = {r.doc_id: r for r in rows}
    assert by[100].n_removed == 0
    passage = len(prose(1000, 90)) + 2  # and the spaces around it
    for i in range(101, 112):
        assert passage - 2 <= by[i].n_removed <= passage + 8, i
    for i in range(200, 206):
        assert by[i].n_removed == by[i].n_bytes
    for i in (0, 1, 2, 400, 401, 402, 403, 404, 405):
        assert by[i].n_removed == 0
    assert len([r for r in rows if r.doc_id == 7 and r.n_removed == 0]) == 3


def brute_op3(documents, chunker):
    """From chunk bytes: the first place of each, runs of later places, extended byte by byte without a limit."""
    texts, first, out = [t.encode() for _, t in documents], {}, {}
    for i, text in enumerate(texts):
        cuts = chunker.cut(np.frombuffer(text, np.uint8), np.array([0, len(text)])).tolist() if text else [0]
        runs = []
        for a, b in zip(cuts[:-1], cuts[1:]):
            place = first.setdefault(text[a:b], (i, a))
            if place != (i, a):
                if runs and runs[-1][-1][1] == a:
                    runs[-1].append((a, b, *place))
                else:
                    runs.append([(a, b, *place)])
        gone = np.zeros(len(text) + 1, int)
        for run in runs:
            gone[run[0][0] : run[-1][1]] = 1
            for a, b, f, at in run:
                if a < run[0][0] + 64:
                    x, z = a, at
                    while x > 0 and z > 0 and text[x - 1] == texts[f][z - 1]:
                        x, z = x - 1, z - 1
                    gone[x:a] = 1
                if b > run[-1][1] - 64:
                    y, z = b, at + b - a
                    while y < len(text) and z < len(texts[f]) and text[y] == texts[f][z]:
                        y, z = y + 1, z + 1
                    gone[b:y] = 1
        edges = np.diff(np.r_[0, gone])
        spans = [(a, b) for a, b in zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist()) if b - a >= chunker.least]
        kept = b"".join(text[a:b] for a, b in zip([0, *(b for _, b in spans)], [*(a for a, _ in spans), len(text)]))
        out[documents[i]] = (len(text), sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("parts", [1, 7])
def test_op3_equals_brute_force(spark, corpus, docs, parts):
    chunker = substring_dedup.Chunker()
    rows = substring_dedup.report(substring_dedup.keyed_bytes(docs.repartition(parts)), substring_dedup.repeated(docs.repartition(parts), chunker), chunker.least).collect()
    documents = sorted({(NO_ID if d is None else d, t or "") for d, t, *_ in corpus}, key=lambda x: (x[0], text_key(spark, x[1])))
    want = brute_op3(documents, chunker)
    got = sorted((NO_ID if r.doc_id is None else r.doc_id, *r[1:]) for r in rows)
    assert got == sorted((NO_ID if d is None else d, *want[NO_ID if d is None else d, t or ""]) for d, t, *_ in corpus)
    assert sum(r.n_removed > 0 for r in rows) > 20


def text_key(spark, text, known={}):
    from pyspark.sql import functions as F

    if text not in known:
        known[text] = spark.range(1).select(F.xxhash64(F.lit(text))).first()[0]
    return known[text]


def test_op3_tells_structured_chunks_apart():
    """Thue-Morse texts and their complements agree in polynomial hashes of odd base modulo 2**64."""
    bits = [bin(i).count("1") & 1 for i in range(1024)]
    a, b = (np.frombuffer("".join(pair[i] for i in bits).encode(), np.uint8) for pair in (" V", "V "))
    one = np.array([0]), np.array([1024])
    assert [x[0] for x in substring_dedup.digests(a, *one)] != [x[0] for x in substring_dedup.digests(b, *one)]


def test_op3_finds_passages_to_their_ends(spark):
    """Of passages of 51 words between other texts, nearly all go, whole."""
    rows = [(10 * i + j, f"{prose(20_000 + 10 * i + j, 30)} {prose(7000 + i, 51)} {prose(40_000 + 10 * i + j, 30)}") for i in range(200) for j in range(2)]
    kept = {r.doc_id: r.text for r in substring_dedup.dedupe(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    passages = {i: f" {prose(7000 + i, 51)} " for i in range(200)}
    whole = sum(len(kept[10 * i + 1]) <= len(rows[2 * i + 1][1]) - len(passages[i].strip()) for i in range(200))
    assert whole >= 196
    assert all(kept[10 * i] == rows[2 * i][1] for i in range(200))


def test_op3_removed_bytes_occur_earlier(corpus):
    chunker = substring_dedup.Chunker(least=50)
    documents = distinct_documents(corpus)
    texts = [t.encode() for _, t in documents]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    parts = list(substring_dedup._chunks(data, offsets, chunker))
    e = {n: np.concatenate([p[n] for p in parts]) for n in parts[0]}
    e |= {"d": e["row"].astype(np.int64), "t": np.zeros(len(e["k"]), np.int64)}
    assert sum(e["l"]) == len(data)
    order, copy = substring_dedup.first_seen(e, ("k", "x"))
    first = {}
    for i in sorted(range(len(e["k"])), key=lambda i: (e["d"][i], e["s"][i])):
        chunk = texts[e["d"][i]][e["s"][i] : e["s"][i] + e["l"][i]]
        assert (chunk in first) == bool(copy[np.flatnonzero(order == i)[0]])
        first.setdefault(chunk, i)


def test_op3_pieces_of_a_long_text_cover_it(monkeypatch):
    rng = np.random.default_rng(9)
    text = np.concatenate([rng.integers(97, 123, 50_000).astype(np.uint8), np.full(5000, 97, np.uint8)])
    monkeypatch.setattr(substring_dedup, "RUN", 4096)
    parts = list(substring_dedup._chunks(text, np.array([0, len(text)]), substring_dedup.Chunker()))
    s, n = (np.concatenate([p[k] for p in parts]).astype(int) for k in ("s", "l"))
    assert s[0] == 0 and (s[1:] == (s + n)[:-1]).all() and s[-1] + n[-1] == len(text)
    assert n.max() <= 1024


def test_op3_shift_resistance():
    rng = np.random.default_rng(1)
    text = rng.integers(97, 123, 20_000).astype(np.uint8)
    chunker = substring_dedup.Chunker()
    moved = np.concatenate([text[:7000], np.frombuffer(b"inserted!", np.uint8), text[7000:]])
    sets = []
    for t in (text, moved):
        cuts = chunker.cut(t, np.array([0, len(t)]))
        sets.append({bytes(t[a:b]) for a, b in zip(cuts[:-1], cuts[1:])})
    assert len(sets[1] - sets[0]) <= 4


def test_op3_texts_and_columns(clashing, empty, corpus):
    kept = substring_dedup.dedupe(clashing)
    assert kept.columns == clashing.columns and kept.count() == len(corpus)
    texts = {r.doc_id: r.text for r in kept.collect()}
    source = {d: t for d, t, *_ in corpus}
    assert texts[0] == source[0] and texts[200] == "" and texts[400] is None
    assert substring_dedup.dedupe(empty).count() == 0


def brute_fingerprint(text, size=3):
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words, word = [], ""
    for c in (text or "").translate(table) + " ":
        if c in "\x20\x09\x0a\x0b\x0c\x0d":
            if word:
                words.append(word)
            word = ""
        else:
            word += c
    shingles = [" ".join(words[k : k + size]) for k in range(len(words) - size + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, budget):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= budget:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(prints))]


def test_op7_equals_brute_force(corpus, docs):
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == len(corpus)
    prints = [brute_fingerprint(t) for _, t, *_ in corpus]
    roots = brute_components(prints, 3)
    least = {}
    for (d, *_), root in zip(corpus, roots):
        if d is not None:
            least[root] = min(d, least.get(root, d))
    want = sorted(((d if d is not None else -1), p, least.get(r, -1)) for (d, *_), p, r in zip(corpus, prints, roots))
    got = sorted(((r.doc_id if r.doc_id is not None else -1), r.fp % (1 << 64), -1 if r.component_id is None else r.component_id) for r in rows)
    assert got == want


@pytest.mark.parametrize("budget", [0, 1, 3, 5])
def test_trie_join_finds_every_pair(spark, budget):
    rng = np.random.default_rng(budget)
    base = rng.integers(0, 1 << 62, 40, dtype=np.uint64)
    values = [base]
    for _ in range(12):
        flips = np.zeros(40, np.uint64)
        for _ in range(int(rng.integers(1, 4))):
            flips |= np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)
        values.append(values[-1] ^ flips)
    values = np.unique(np.concatenate(values))
    df = spark.createDataFrame([(int(x),) for x in values.view(np.int64)], "fp long")
    pairs = simhash.components(simhash.links(df, budget)) if budget else None
    roots = brute_components([int(x) for x in values], budget)
    if budget:
        found = {r.node: r.root for r in pairs.collect()}
        groups = defaultdict(set)
        for x, r in zip(values.view(np.int64).tolist(), roots):
            groups[r].add(x)
        for g in groups.values():
            assert {found.get(x, x) for x in g} == {min(g)}
    else:
        assert simhash.links(df, 0).count() == 0


def test_trie_of_dense_cluster():
    values = np.unique(np.array([(5 << 50) ^ (i * 7 % 4096) for i in range(3000)], np.uint64))
    parent = simhash.trie_links(values, np.array([0]), np.array([len(values)]), 0, 3)
    assert set(parent.tolist()) == set(brute_components([int(x) for x in values[:0]], 3)) | {0}


def test_components_of_a_long_path(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(-40, 40)], "a long, b long")
    assert {r.root for r in simhash.components(path).collect()} == {-40}
    assert simhash.components(path.limit(0)).count() == 0


def jaccard(a, b, size=5):
    def shingles(text):
        w = text.lower().split()
        return {" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))}

    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


def test_stage_keeps_one_of_each_group(spark):
    import random

    from tests.llm.conftest import prose

    rng, rows = random.Random(5), []
    for g in range(25):
        words = prose(5000 + g, 300).split()
        rows.append((10 * g, " ".join(words)))
        for k in range(1, 5):  # near copies: similarity around 0.9
            copy = list(words)
            for _ in range(3):
                copy[rng.randrange(300)] = "edit%d" % rng.randrange(10**6)
            rows.append((10 * g + k, " ".join(copy)))
    rows += [(1000 + i, prose(9000 + i, 120)) for i in range(60)]
    assert min(jaccard(rows[0][1], rows[k][1]) for k in range(1, 5)) >= 0.8
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = {r.doc_id for r in simhash.drop_near_duplicates(docs).collect()}
    assert kept == {10 * g for g in range(25)} | {1000 + i for i in range(60)}


def test_stage_confirms_links_exactly(spark):
    from tests.llm.conftest import prose

    rows, under, near = [], set(), set()
    for g in range(40):  # 1 to 13 of 300 words differ: similarities from 0.64 to 0.97
        words = prose(7000 + g, 300).split()
        rows.append((10 * g, " ".join(words)))
        edits = 1 + g % 13
        copy = list(words)
        for k in range(edits):
            copy[10 + 22 * k] = f"edit{g}x{k}"
        rows.append((10 * g + 1, " ".join(copy)))
        (near if jaccard(rows[-2][1], rows[-1][1]) >= 0.8 else under).add(10 * g + 1)
    assert len(near) > 10 and len(under) > 10
    # equal fingerprints, different sets: one repeated shingle decides every bit
    loud = "again " * 400
    rows += [(1000, loud + prose(1, 60)), (1001, loud + prose(2, 60))]
    assert simhash.fingerprint(rows[-1][1].encode(), 5) == simhash.fingerprint(rows[-2][1].encode(), 5)
    assert jaccard(rows[-1][1], rows[-2][1]) < 0.8
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = {r.doc_id for r in simhash.drop_near_duplicates(docs).collect()}
    assert kept == {d for d, _ in rows} - near


def test_confirmed_roots_join_over_a_chain():
    chain = [np.arange(a, a + 100, dtype=np.uint64) for a in (0, 10, 20, 60)]
    same = np.zeros((4, 8), np.uint8)
    assert simhash.confirmed_roots([1, 2, 3, 4], same, chain, 8, 0.8).tolist() == [0, 0, 0, 3]


def test_hot_keys_split_into_cells_lose_no_link(spark, corpus, docs, monkeypatch):
    from functools import partial

    from tests.llm.conftest import prose

    # one component of candidates that is no star around its root: 60 versions of a text, each edited after the one before
    rows, words = [], prose(1, 300).split()
    for g in range(60):
        words = list(words)
        words[5 * g % 290 + 3] = f"edit{g}"
        rows.append((g, " ".join(words)))
    rows += [(100 + g, prose(100 + g, 80)) for g in range(20)]
    versions = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want_prints = sorted(simhash.near_duplicates(docs).collect(), key=str)
    want_kept = {r.doc_id for r in simhash.drop_near_duplicates(versions).collect()}
    assert want_kept == {0} | {100 + g for g in range(20)} and jaccard(rows[0][1], rows[59][1]) < 0.8
    for name, most in (("links", 4), ("wide_links", 8), ("confirm", 40_000)):
        monkeypatch.setattr(simhash, name, partial(getattr(simhash, name), most=most))
    assert sorted(simhash.near_duplicates(docs).collect(), key=str) == want_prints
    assert {r.doc_id for r in simhash.drop_near_duplicates(versions).collect()} == want_kept


def test_cells_of_a_hot_key_hold_every_two_of_its_rows(spark):
    from itertools import combinations

    from lexloom.llm.common import split_hot

    rows = [(7, n) for n in range(50)] + [(8, n) for n in range(3)]
    dealt, cells = split_hot(spark.createDataFrame(rows, "key long, k long"), "key", "k", 10)
    held = defaultdict(set)
    for r in dealt.collect():
        held[r.key, r.cell].add(r.k)
    assert cells == 45 and held[8, 0] == {0, 1, 2} and max(len(x) for x in held.values()) < 30
    assert {p for (key, _), x in held.items() if key == 7 for p in combinations(sorted(x), 2)} == set(combinations(range(50), 2))


def test_op7_edges(clashing, empty, corpus):
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.drop_near_duplicates(clashing)
    assert kept.columns == clashing.columns
    rows = [(r.doc_id, r.text) for r in kept.select("doc_id", "text").collect()]
    assert len(rows) == len(set(rows)) and len({t for _, t in rows if t}) == len([t for _, t in rows if t])
    ids = [d for d, _ in rows]
    assert not set(range(200, 206)) & set(ids) and {0, 1, 2, 3} <= set(ids) and ids.count(None) == 1
    assert len({400, 401, 402} & set(ids)) == 1 and not set(range(300, 306)) & set(ids)
    assert simhash.drop_near_duplicates(empty).count() == 0

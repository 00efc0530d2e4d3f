import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lexloom.llm import ann, decontaminate, language_id, packing, quality, token_counts, url_filter
from lexloom.llm.common import NO_ID

WORD, BYTE = "word_bpe_49k.json", "byte_bpe_50k.json"
HARD = ["", "a", "<|endoftext|>", "x<|endoftext|>y <|startoftext|>" * 40, "é" * 500, "e\u0301\u0327" * 300, "a b" * 900, "don't we'll " * 300, "!!'s??'re" * 200, "abc" * 2000, "12 345 " * 300, "\u00a0\u2003 x" * 400, "İıſ ﬁ" * 200, "한국어 텍스트" * 200, "🙂🏽" * 300, "\x00\x01 ends"]


# ---- token counts


@pytest.mark.parametrize(("chunk", "overlap"), [(64, 8), (257, 40), (1000, 2)])
def test_spliced_encodings_equal_whole_ones(chunk, overlap):
    for path in (WORD, BYTE):
        tokenizer = token_counts.load(public_tokenizers.path(path))
        encode = lambda text: tokenizer.encode(text, add_special_tokens=False)  # noqa: E731, B023
        for text in [*HARD, " ".join(HARD)]:
            assert token_counts.encode_long(text, encode, chunk, overlap) == encode(text).ids


def test_counts_from_pieces_equal_whole_encodings(corpus, monkeypatch):
    tokenizer = token_counts.load(public_tokenizers.path(WORD))
    assert token_counts.drops_space(tokenizer) and not token_counts.drops_space(token_counts.load(public_tokenizers.path(BYTE)))
    monkeypatch.setattr(token_counts, "KEPT", 3000)
    monkeypatch.setattr(token_counts, "LONGEST", 6)
    monkeypatch.setattr(token_counts, "JOINED", 300)
    count = token_counts.counter(public_tokenizers.path(WORD), 1 << 15, 256)
    texts = [*HARD, *(t for _, t, *_ in corpus if t), "a\x1cb\x1d c\x85d\u2028e\u00a0f\u180eg", "x \u0301y \u200bz <|endoftext|>\n<|endoftext|>", "İ \u0130 Σ ς ΑΣ ﬀ"]
    for at in range(0, len(texts), 7):
        assert count(texts[at : at + 7]) == [len(tokenizer.encode(t, add_special_tokens=False).ids) for t in texts[at : at + 7]]


def test_op1_equals_the_library(docs, clashing, empty, corpus):
    tokenizer = token_counts.load(public_tokenizers.path(WORD))
    want = sorted((-1 if d is None else d, len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for d, t, *_ in corpus)
    for table in (docs, clashing):
        rows = token_counts.token_counts(table, public_tokenizers.path(WORD), chunk=5000).collect()
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_tokens) for r in rows) == want
        assert all(r.over_limit == (r.n_tokens > 2048) for r in rows)
    assert token_counts.token_counts(empty, public_tokenizers.path(WORD)).count() == 0


def test_op1_sentencepiece(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = spark.createDataFrame([(1, "some text of words"), (2, None)], "doc_id long, text string")
    assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(texts, path).collect()} == {1: len(model.encode("some text of words")), 2: 0}


# ---- packing


def test_quick_encoder_gives_the_tokenizers_ids(corpus):
    both = [packing.encoder(public_tokenizers.path(BYTE), ranks) for ranks in (None, public_tokenizers.path("byte_bpe_50k.tiktoken"))]
    for text in [*HARD, *(t for _, t, *_ in corpus if t)]:
        assert list(both[0](text)) == list(both[1](text))


def test_long_runs_and_stretches_give_the_tokenizers_ids():
    path = public_tokenizers.path(BYTE)
    quick, whole = packing.encoder(path, public_tokenizers.path("byte_bpe_50k.tiktoken")), token_counts.load(path)
    n = 2_000_000
    texts = [" " * n, "\n" * n, "a" * n, f"start{' ' * n}<|endoftext|>{'z' * 300_000} end", "many short words, it's 12 of them<|endoftext|> " * 9000, "word \n  word\t" * 20_000, "é naïve " * 40_000, "中文 ab " * 30_000]
    for text in texts:
        assert quick(text).tolist() == whole.encode(text, add_special_tokens=False).ids
    assert "".join(packing.stretches(texts[4], 100)) == texts[4] and max(map(len, packing.stretches(texts[4], 100))) < 200


@pytest.mark.parametrize("size", [16, 1024])
def test_op10_round_trip(clashing, empty, corpus, size):
    path = public_tokenizers.path(BYTE)
    rows = packing.pack(clashing, path, ranks=public_tokenizers.path("byte_bpe_50k.tiktoken"), size=size, with_ids=True).collect()
    encode = packing.encoder(path, None)
    want = sorted((-1 if d is None else d, [*encode(t or "").tolist(), 0]) for d, t, *_ in corpus)
    line = sorted(rows, key=lambda r: (r.sequence_id, r.offset))
    documents, place = [], 0
    for r in line:
        assert r.sequence_id * size + r.offset == place and r.length > 0 and r.offset + r.length <= size
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids)
        place += r.length
        if not r.start:
            documents.append((-1 if r.doc_id is None else r.doc_id, []))
        assert r.start == len(documents[-1][1])
        documents[-1][1].extend(r.ids)
        assert len(documents[-1][1]) <= r.doc_tokens
    assert sorted(documents) == want
    assert packing.pack(empty, path).count() == 0


# ---- nearest neighbours


def brute_nearest(rows, k):
    out = {}
    for q, x in rows:
        if q % 20 == 0:
            scored = sorted((-float(np.dot(np.array(x, float), np.array(y, float))), i) for i, y in rows if i != q)[:k]
            out[q] = scored
    return out


def test_op4_recall_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(np.float32(c)) for c in rng.standard_normal(70)]) for i in range(600)]
    rows[41] = (41, rows[40][1])
    rows[43] = (43, rows[42][1])
    bad = [(700, None), (720, [0.0] * 70), (740, [float("nan")] * 70), (760, [1.0] * 69 + [float("inf")]), (780, [1.0] * 5), (800, [None] + [1.0] * 69), (None, [1.0] * 70), (820, [])]
    table = spark.createDataFrame([(*r, "x") for r in [*rows, rows[41], *bad]], "vec_id long, embedding array<float>, score string").repartition(4)
    found = ann.nearest(table, lambda i: i % 20 == 0).collect()
    want = brute_nearest(rows, 20)
    assert {r.query_id for r in found} == set(want)
    hits = 0
    for q, best in want.items():
        mine = sorted((r for r in found if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 21))
        assert [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)
        hits += len({r.vec_id for r in mine} & {i for _, i in best})
    assert hits >= 0.95 * 20 * len(want)


def test_op4_any_finite_scale(spark):
    """Components of 1e200 and 1e-200 beside ordinary ones: each query's nearest are those of brute force."""
    rng = np.random.default_rng(3)
    rows = [(i, (rng.standard_normal(64) * (1.0 if i % 20 == 0 else 1e200 if i % 7 == 3 else 1e-200 if i % 7 == 5 else 1.0)).tolist()) for i in range(400)]
    found = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda i: i % 20 == 0).collect()
    for q, best in brute_nearest(rows, 20).items():
        mine = [r.vec_id for r in sorted((r for r in found if r.query_id == q), key=lambda r: r["rank"])]
        assert len(set(mine) & {i for _, i in best}) >= 18 and mine[0] == best[0][1]


def test_op4_rows_that_share_an_id_count_one_by_one(spark):
    """Every row but the query's own is a candidate: the other row of its id too, and each of the two asks."""
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(16).tolist()) for i in range(60)]
    rows += [(20, rng.standard_normal(16).tolist()), (21, rows[21][1]), (40, rows[40][1])]
    found = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda i: i % 20 == 0, epsilon=9.0).collect()
    want = []
    for n, (q, x) in enumerate(rows):
        if q % 20 == 0:
            scored = sorted((-float(np.dot(x, y)), i) for m, (i, y) in enumerate(rows) if m != n)[:20]
            want += [(q, at + 1, i, round(-s, 9)) for at, (s, i) in enumerate(scored)]
    assert sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in found) == sorted(want)


def test_op4_reranks_a_part_of_the_candidates_only(spark):
    rng = np.random.default_rng(6)
    vectors, turn = rng.standard_normal((6000, 64)) / 8, ann.rotation(64)
    codes, rows = ann.Codes(*ann.encode(vectors, turn)), np.arange(6000)
    hits = reranked = 0
    for q, ids, _, scored in ann.search(rows[:60], vectors[:60], rows, rows, vectors, codes, 20, turn):
        exact = vectors @ vectors[q[0]]
        exact[q[0]] = -np.inf
        hits += len(set(ids.tolist()) & set(np.argsort(-exact)[:20].tolist()))
        reranked += scored
    assert hits >= 0.97 * 20 * 60 and reranked <= 0.5 * 6000 * 60


def test_op4_few_candidates(spark):
    table = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (20, [0.0, 2.0])], "vec_id long, embedding array<double>")
    found = sorted(tuple(r) for r in ann.nearest(table, lambda i: i % 20 == 0).collect())
    assert found == [(0, 1, 1, 0.5), (0, 2, 20, 0.0), (20, 1, 1, 1.0), (20, 2, 0, 0.0)]
    assert ann.nearest(table.limit(0), lambda i: i % 20 == 0).count() == 0


def test_one_bit_estimates_lie_within_their_bounds():
    rng = np.random.default_rng(0)
    vectors, turn = rng.standard_normal((2000, 64)), ann.rotation(64)
    codes = ann.Codes(*ann.encode(vectors, turn))
    outside = 0
    for q in rng.standard_normal((20, 64)):
        about, error = codes.estimate(q, turn, 3.0)
        outside += int((np.abs(about - vectors @ q) > error).sum())
    assert outside < 0.01 * 40_000


# ---- decontamination


def brute_contaminated(documents, items, threshold=0.8):
    import regex

    def shingles(text):
        w = regex.findall(r"[\p{L}\p{N}]+", (text or "").lower())
        return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = {}
    for i, t in items:
        if i is not None:
            sets.setdefault(i, set()).update(shingles(t))
    return {(d, i) for d, t in documents for i, s in sets.items() if s and len(s & shingles(t)) / len(s) >= threshold}


def test_op5_equals_brute_force(spark, corpus, docs, clashing, empty):
    words = corpus[25][1].split()
    broken = list(words[20:80])
    broken[30] = "other"
    items = [(1, " ".join(words[10:50])), (2, " ".join(broken)), (3, corpus[31][1].upper()), (4, "nothing that any document has in it at all"), (5, None), (6, ""), (7, "Two, words"), (8, "a"), (None, corpus[0][1]), (9, " ".join(words[3:9])), (9, " ".join(words[3:9]))]
    benchmark = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, h int")
    want = brute_contaminated([(NO_ID if d is None else d, t) for d, t, *_ in corpus], items)
    assert want
    for table in (docs, clashing):
        for limit in (10**6, 0):
            found = decontaminate.contaminated(table, benchmark, broadcast_rows=limit).collect()
            assert {(r["__d"], r["item_id"]) for r in found} == want and all(r.containment >= 0.8 for r in found)
    kept = decontaminate.drop_contaminated(clashing, benchmark)
    assert kept.columns == clashing.columns
    gone = {d for d, _ in want}
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(d for d, *_ in corpus if d is not None and d not in gone)
    assert decontaminate.contaminated(empty, benchmark).count() == 0
    assert decontaminate.contaminated(docs, benchmark.limit(0)).count() == 0


# ---- quality


def test_op6_learns_and_handles_edges(spark):
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    good = [(i, " ".join(word() for _ in range(80))) for i in range(0, 300)]
    bad = [(i, " ".join(word().upper() + "!!" for _ in range(80))) for i in range(300, 450)]
    extra = [(900, None), (901, ""), (None, "abc"), (902, good[0][1] * 40)]
    docs = spark.createDataFrame([(*r, "x") for r in [*good, *bad, *extra]], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad] + [(None, 1), (3, None), (5, 7)], "doc_id long, quality int")
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))
    model = quality.fit(docs, labels, ~held)
    rows = quality.score(docs.withColumn("held_out", held), model).collect()
    assert len(rows) == 454 and all(0 <= r.score <= 1 for r in rows)
    tested = [r for r in rows if r.held_out and r.doc_id is not None and r.doc_id < 450]
    assert np.mean([(r.score >= 0.5) == (r.doc_id < 300) for r in tested]) > 0.95
    assert quality.score(docs.limit(0), model).count() == 0
    blank = quality.fit(docs, labels.limit(0), ~held)
    assert {r.score for r in quality.score(docs, blank).collect()} == {0.5}


def test_op6_scores_equal_their_definition(spark):
    """Sizes under either dictionary, block by block, and the logistic of their difference, worked out here."""
    import math

    import zstandard

    rng = np.random.default_rng(14)
    text = lambda letters, n: " ".join("".join(rng.choice(list(letters), 5)) for _ in range(n))
    rows = [(i, text("abcdef" if i % 2 else "uvwxyz", 150), i % 2) for i in range(240)] + [(500, None, 1), (501, "", 0), (502, text("abcxyz", 9000), 1), (7, "another text under a known id", 1)]
    docs = spark.createDataFrame([r[:2] for r in rows] * 2, "doc_id long, text string")  # every row twice
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows[:240]], "doc_id long, quality int")
    model = quality.fit(docs, labels, F.lit(True))
    assert model.slope > 0

    def size(data, block):
        return len(zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False, write_dict_id=False, dict_data=zstandard.ZstdCompressionDict(data)).compress(block))

    for r in quality.score(docs, model).collect():
        raw = (r.text or "").encode()
        blocks = [raw[a : a + 4096] for a in range(0, len(raw), 4096)]
        x = sum(size(model.bad, b) - size(model.good, b) for b in blocks) / max(1, len(raw))
        assert abs(r.score - 1 / (1 + math.exp(-(model.slope * x + model.intercept)))) < 1e-12


def test_samples_are_bounded_whatever_is_repeated(spark):
    """A drawn id that thousands of rows carry gives one text."""
    rows = [(i, f"text of {i} and more", "en") for i in range(20)] + [(3, f"text {n} under one id", "en") for n in range(5000)] + [(3, f"texte {n}", "fr") for n in range(5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    assert len(quality.sample(docs, labels, F.lit(True), 2000, 1 << 15, "doc_id", "text", "quality")) == 20
    assert len(language_id.sample(docs, F.lit(True), 500, 1 << 16, "doc_id", "text", "lang")) == 21


def test_op6_scores_keep_the_class_shares_beyond_the_cap(spark):
    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    rows = [(i, " ".join(word() for _ in range(40)), int(i % 6 > 0)) for i in range(1440)]  # labels that no text tells apart
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] < 720], "doc_id long, quality int")
    for cap in (2000, 60):
        model = quality.fit(docs, labels, F.lit(True), per_class=cap)
        scores = [r.score for r in quality.score(docs.filter("doc_id >= 720"), model).collect()]
        assert abs(np.mean(scores) - 5 / 6) < 0.06, (cap, np.mean(scores))


# ---- url filters


def brute_rule(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fit = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p or "")]
    best = max(fit, default=None)
    return host, path, best and best[3], best[4] if best else "allow"


@pytest.mark.parametrize("limit", [100_000, 0])
def test_op8_equals_brute_force(spark, limit):
    rules = [("org", "/", "allow"), ("Example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"), ("net", None, "block"), (None, "/", "block"), ("", "/", "block"), ("com", "/de/", "block")]
    urls = [None, "", "no scheme", "http://", "http://org", "http://ORG/x", "https://a.b.Example.ORG/es/1?x#y", "http://example.org/en/12", "http://badexample.org/en/12", "http://x.com/fr/a/de/", "http://com/de/", "a://b://c.net/x", "http://x.net?q=/fr/", "http://x.com./fr/", "http://x.com:80/fr/", "http://ä.com/fr/\nz", "http://..com/de/"]
    pages = spark.createDataFrame([(i, u, "r") for i, u in enumerate([*urls, urls[7], urls[7]])] + [(None, urls[9], "r")], "page_id long, url string, rule string")
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    rows = url_filter.judge(pages, table, broadcast_rules=limit).collect()
    assert len(rows) == len(urls) + 3
    named = [((h or "").lower(), p or "", v) for h, p, v in rules]
    for r in rows:
        url = urls[9] if r.page_id is None else [*urls, urls[7], urls[7]][r.page_id]
        assert (r.host, r.path, r.rule, r.verdict) == brute_rule(url, named), url
    assert {r.verdict for r in url_filter.judge(pages, table.limit(0), default="block").collect()} == {"block"}
    assert url_filter.judge(pages.limit(0), table).count() == 0


# ---- language identification


def test_op9_learns_and_handles_edges(spark):
    rng = np.random.default_rng(6)
    sounds = {"aa": "ba be bi bo".split(), "bb": "xu xo zi zu".split(), "cc": "тра ла на".split()}
    say = lambda lang, n: " ".join("".join(rng.choice(sounds[lang], 3)) for _ in range(n))
    rows = [(i, say(lang, 60), lang) for i in range(150) for lang in [list(sounds)[i % 3]]]
    edges = [(900, None, "aa"), (901, "", None), (902, "12 ... !", "bb"), (903, "ж", "cc"), (904, say("bb", 200_000), "bb"), (None, say("cc", 5), "cc"), (905, say("aa", 9), None)]
    docs = spark.createDataFrame([(*r, "x") for r in [*rows, *edges]], "doc_id long, text string, lang string, score string")
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
    model = language_id.fit(docs, ~held)
    found = {r.doc_id: r for r in language_id.predict(docs, model).collect()}
    assert np.mean([found[i].lang_pred == lang for i, _, lang in rows]) > 0.99
    assert [found[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3
    assert found[903].lang_pred in sounds and found[904].lang_pred == "bb" and found[905].lang_pred == "aa"
    assert all(0 <= r.score <= 1 for r in found.values())
    assert {r.lang_pred for r in language_id.predict(docs, language_id.fit(docs.limit(0), ~held)).collect()} == {"und"}
    assert language_id.predict(docs.limit(0), model).count() == 0


def test_op9_scores_equal_their_definition(spark):
    """The share of the winner's n-grams, less its false positives, with n-grams, filters and counts worked out here."""
    rng = np.random.default_rng(16)
    sounds = {"aa": "ba be bi bo", "bb": "xu xo zi ba", "cc": "тра ла на zi"}
    say = lambda lang, n: " ".join("".join(rng.choice(sounds[lang].split(), 3)) for _ in range(n))
    rows = [(i, say(lang, 50), lang) for i in range(90) for lang in [list(sounds)[i % 3]]]
    rows += [(200, "ba--BA  xu\nтра, zi!", None), (201, "ж", None), (202, say("aa", 30) + say("bb", 31), None), (203, "q w e", None)]
    docs = spark.createDataFrame(rows * 2, "doc_id long, text string, lang string")
    model = language_id.fit(docs, F.lit(True))

    def held(gram, lang):
        slots = language_id._rows(np.array([int.from_bytes(gram, "little")], np.uint32), model.slices)
        return all(int(model.tables[0][int(row[0])]) >> lang & 1 for row in slots)

    for r in language_id.predict(docs, model).collect():
        folded = bytearray()
        for b in r.text.encode():
            c = b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20
            if not (c == 0x20 and folded and folded[-1] == 0x20):
                folded.append(c)
        grams = [bytes(folded[i : i + 4]) for i in range(len(folded) - 3)]
        true = [max(0.0, (sum(held(g, k) for g in grams) - len(grams) * f) / (1 - f)) for k, f in enumerate(model.false_rate)]
        best = max(range(3), key=lambda k: (true[k], -k))
        want = (model.languages[best], true[best] / sum(true)) if sum(true) > 0 else (model.languages[model.prior], 0.0)
        assert r.lang_pred == want[0] and abs(r.score - want[1]) < 1e-9


def test_filters_return_every_language_of_an_ngram():
    model = language_id.train([("aa", "shared only"), ("bb", "shared other")], least=1)
    h, _ = language_id.grams(np.frombuffer(b"shared", np.uint8), np.array([0, 6]))
    assert set(model.masks(h)[0].tolist()) == {3}


def test_more_languages_than_a_word_of_a_mask_holds(spark):
    rng = np.random.default_rng(8)
    words = {f"l{i:03d}": ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(12)] for i in range(70)}
    rows = [(100 * n + j, " ".join(rng.choice(w, 30)), lang) for n, (lang, w) in enumerate(words.items()) for j in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    model = language_id.fit(docs, F.lit(True))
    assert len(model.tables) == 2 and len(model.languages) == 70
    found = language_id.predict(docs, model).collect()
    assert all(r.lang_pred == r.lang for r in found) and len(found) == 350


def test_a_long_text_in_pieces_has_the_counts_of_the_whole(monkeypatch, spark):
    texts = [("aa", "lorem ipsum dolor " * 400), ("bb", "quick brown foxes " * 400)]
    model = language_id.train(texts)
    whole = np.frombuffer((texts[0][1] + texts[1][1]).encode(), np.uint8)
    t, f = model.counts(whole, np.array([0, len(whole)]))
    parts = [model.counts(whole[a : a + 1000 + 3], np.array([0, len(whole[a : a + 1003])])) for a in range(0, len(whole), 1000)]
    assert abs(sum(p[0] for p in parts) - t).max() <= len(parts) and abs(sum(p[1] for p in parts) - f).max() <= len(parts)


def test_op6_and_op9_on_held_out_documents(spark):
    """The registered queries over a supplied table: texts that nothing was learned from."""
    import zlib

    from lexloom.llm import queries

    sf = "/root/testdata/sf0.01"
    quality_ = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rest = lambda d, n: zlib.crc32(str(d).encode()) % n
    scored = queries.op6_quality(spark, sf).collect()
    assert all(r.held_out == (rest(r.doc_id, 3) == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in scored) and len(scored) == len(lang)
    tried = [r for r in scored if r.held_out and r.doc_id in quality_]
    assert np.mean([r.predicted == quality_[r.doc_id] for r in tried]) >= 0.9
    told = queries.op9_language_id(spark, sf).collect()
    assert all(r.held_out == (rest(r.doc_id, 4) == 2) and 0 <= r.score <= 1 for r in told) and len(told) == len(lang)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in told if r.held_out and lang[r.doc_id]]) >= 0.97

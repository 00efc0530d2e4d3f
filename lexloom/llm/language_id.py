"""Language identification (op9): bit-sliced Bloom filters answer, for an n-gram, with the bitmask of its languages."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import bytes_of, lean, materialize, runs, sampled

UNDETERMINED = "und"
#: Bytes of an n-gram.
N = 4
#: Languages a word of a bitmask holds; more languages take more words.
WIDE = 64
#: Texts are looked up in runs of so many bytes; a longer text in pieces that overlap by N - 1.
RUN = 1 << 21

_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x80:] = np.arange(0x80, 0x100)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)


def grams(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, piece) of every n-gram of pieces that lie end to end in data; starts has n + 1 entries.

    ASCII letters are lower-cased, other ASCII bytes become spaces, runs of spaces one; no n-gram crosses pieces.
    """
    piece = np.repeat(np.arange(len(starts) - 1, dtype=np.int32), np.diff(starts))
    folded = _FOLD[data]
    kept = folded != 0x20
    keep = kept.copy()
    keep[1:] |= kept[:-1]
    first = starts[:-1][np.diff(starts) > 0]
    keep[first] = True
    folded, piece = folded[keep], piece[keep]
    if len(folded) < N:
        return np.empty(0, np.uint32), np.empty(0, np.int32)
    h = folded.astype(np.uint32)
    h = h[:-3] | h[1:-2] << np.uint32(8) | h[2:-1] << np.uint32(16) | h[3:] << np.uint32(24)
    inside = piece[:-3] == piece[3:]
    return h[inside], piece[:-3][inside]


def _rows(grams_: np.ndarray, slices: int) -> list[np.ndarray]:
    """The three filter rows of each n-gram."""
    x = grams_.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    shift, mask = np.uint64(64 - slices), np.uint64((1 << slices) - 1)
    return [x >> shift, x >> np.uint64(20) & mask, x & mask]


@dataclass
class Model:
    """languages in order; prior: the commonest; tables: bit l of row r of table w is set if an n-gram of language WIDE * w + l has row r."""

    languages: list[str]
    prior: int
    slices: int
    tables: list[np.ndarray]
    false_rate: np.ndarray

    def masks(self, grams_: np.ndarray) -> list[np.ndarray]:
        """For each n-gram the bitmask of its languages, WIDE of them a word."""
        a, b, c = _rows(grams_, self.slices)
        return [table[a] & table[b] & table[c] for table in self.tables]

    def counts(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per piece: n-grams, and n-grams whose mask has language l."""
        h, piece = grams(data, starts)
        n = len(starts) - 1
        found = np.zeros((n, len(self.languages)), np.int64)
        for w, masks in enumerate(self.masks(h)):
            for i in range(WIDE * w, min(WIDE * (w + 1), len(self.languages))):
                found[:, i] = np.bincount(piece[(masks >> np.array(i - WIDE * w, masks.dtype) & np.array(1, masks.dtype)).astype(bool)], minlength=n)
        return np.bincount(piece, minlength=n).astype(np.int64), found

    def decide(self, total: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Popcounts less their expected false positives; the largest wins (ties: the first language; none: the prior)."""
        true = np.maximum(0, (found - total[:, None] * self.false_rate) / (1 - self.false_rate))
        best, all_ = true.argmax(axis=1), true.sum(axis=1)
        score = np.divide(true[np.arange(len(best)), best], all_, out=np.zeros(len(best)), where=all_ > 0)
        return np.where(all_ > 0, best, self.prior), score


def train(texts: list[tuple[str, str]], share: float = 0.05, least: int = 2, commonest: str | None = None) -> Model | None:
    """Build the filters from (language, text) pairs; commonest: the prior language (None: that of most texts).

    An n-gram is a language's own if it occurs there `least` times or more and at least `share` times as often (per
    n-gram of text) as in the language that uses it most; so borrowed passages leave no trace. None without texts.
    """
    languages = sorted({lang for lang, _ in texts})
    if not languages:
        return None
    sets, sizes = [], []
    for lang in languages:
        blobs = [text.encode() for x, text in texts if x == lang]
        h, _ = grams(np.frombuffer(b"".join(blobs), np.uint8), np.cumsum([0, *map(len, blobs)]))
        gram, n = np.unique(h, return_counts=True)
        sets.append((gram, n / max(1, len(h)), n))
        sizes.append(len(blobs))
    every = np.unique(np.concatenate([g for g, _, _ in sets]))
    most = np.zeros(len(every))
    for gram, rate, _ in sets:
        np.maximum.at(most, np.searchsorted(every, gram), rate)
    own = [gram[(rate >= share * most[np.searchsorted(every, gram)]) & (n >= min(least, max(1, n.max(initial=0))))] for gram, rate, n in sets]
    slices = max(12, int(np.ceil(np.log2(24 * max(1, max(map(len, own)))))))
    tables = []
    for w in range(0, len(own), WIDE):
        kind = next(k for k, bits in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32), (np.uint64, 64)) if len(own[w : w + WIDE]) <= bits)
        tables.append(np.zeros(1 << slices, kind))
        for i, gram in enumerate(own[w : w + WIDE]):
            for rows in _rows(gram, slices):
                np.bitwise_or.at(tables[-1], rows, kind(1 << i))
    fill = np.array([np.count_nonzero(tables[i // WIDE] >> tables[i // WIDE].dtype.type(i % WIDE) & tables[i // WIDE].dtype.type(1)) for i in range(len(own))]) / (1 << slices)
    return Model(languages, languages.index(commonest) if commonest in languages else int(np.argmax(sizes)), slices, tables, fill**3)


def sample(docs: DataFrame, usable: Column, per_language: int, longest: int, id_col: str, text_col: str, lang_col: str) -> list[tuple[str, str]]:
    """(language, text) of at most per_language usable documents a language, of at most `longest` bytes each.

    The ids are drawn by hash without reading texts; then only their texts are read, of rows that share id and language
    one (the least by hash), so that the bound holds whatever is repeated.
    """
    size = F.octet_length(text_col)
    able = docs.filter(usable & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & (size > 0) & (size <= longest))
    ids = materialize(sampled(able.select(id_col, lang_col).distinct(), lang_col, id_col, per_language).select(F.col(id_col).alias("__drawn")).distinct())
    drawn = able.join(ids, able[id_col] == ids["__drawn"], "left_semi")
    rows = drawn.groupBy(id_col, lang_col).agg(F.min_by(text_col, F.struct(F.xxhash64(text_col), F.col(text_col)))).collect()
    return [(r[1], r[2]) for r in sorted(rows, key=lambda r: (r[1], r[0], r[2]))]


def fit(docs: DataFrame, usable: Column, *, per_language: int = 500, longest: int = 1 << 16, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """A model of the languages of the usable rows (see sample for its bound, train for its rule)."""
    known = docs.filter(usable & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull())
    commonest = known.groupBy(lang_col).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), lang_col).first()
    return train(sample(docs, usable, per_language, longest, id_col, text_col, lang_col), commonest=commonest and commonest[0])


def predict(docs: DataFrame, model: Model | None, *, text_col: str = "text", label: str = "lang_pred", score: str = "score") -> DataFrame:
    """Every row of docs with its predicted language and a score from 0 to 1.

    Whole texts are looked up. A null text, or one without a letter, is UNDETERMINED with score 0, as is every text if
    nothing could be learned. A text whose letters match no filter gets the commonest language with score 0. Rows are
    decided one by one, so ties, repeated rows and null ids need no rule.
    """
    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    schema = StructType([f for f in docs.schema.fields if f.name not in (label, score)] + [StructField(label, StringType()), StructField(score, DoubleType())])
    kept = [f.name for f in schema.fields[:-2]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text_col))
            data, offsets = bytes_of(column)
            labels, scores = [], []
            for i, j in runs(offsets, RUN):
                total, found = np.zeros(j - i, np.int64), np.zeros((j - i, len(model.languages) if model else 1), np.int64)
                if model:
                    for at in range(int(offsets[i]), int(offsets[j]), RUN) if j == i + 1 else [int(offsets[i])]:
                        ends = np.array([at, min(int(offsets[j]), at + RUN + N - 1)]) if j == i + 1 else offsets[i : j + 1]
                        t, f = model.counts(data[ends[0] : ends[-1]], ends - ends[0])
                        total, found = total + t, found + f
                    best, value = model.decide(total, found)
                part = data[offsets[i] : offsets[j]]
                ascii_ = np.concatenate([[0], np.cumsum((_FOLD[part] != 0x20) & (part < 0x80))])
                ascii_ = ascii_[offsets[i + 1 : j + 1] - offsets[i]] - ascii_[offsets[i:j] - offsets[i]]
                for k in range(j - i):
                    lettered = model is not None and (ascii_[k] > 0 or any(map(str.isalpha, column[i + k].as_py() or "")))
                    labels.append(model.languages[best[k]] if lettered else UNDETERMINED)
                    scores.append(float(value[k]) if lettered else 0.0)
            columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(labels, pa.string()), pa.array(scores, pa.float64())], [*kept, label, score])

    return docs.select(*kept).mapInArrow(lean(run), schema)

"""Quality classifier (op6): how much better a text compresses with the dictionary of good texts than with that of bad ones."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import lean, sampled

#: A text is compressed in blocks of so many bytes, each from the dictionary alone, so that long texts are judged by it too.
BLOCK = 4096


def dictionary(texts: list[bytes], size: int) -> bytes:
    """A zstandard dictionary of texts; too few texts to train one serve as they are."""
    import zstandard

    if not texts:
        return b""
    try:
        return zstandard.train_dictionary(size, [t[a : a + BLOCK] for t in texts for a in range(0, len(t), BLOCK)]).as_bytes()
    except zstandard.ZstdError:
        return b"".join(texts)[-size:]


@dataclass
class Model:
    """Two dictionaries, and slope and intercept that turn the size difference into a probability."""

    good: bytes
    bad: bytes
    slope: float = 0.0
    intercept: float = 0.0
    level: int = 3

    def differ(self, texts: list[bytes]) -> np.ndarray:
        """(size with the bad dictionary - size with the good one) / bytes, over all blocks of each whole text; empty: 0."""
        import zstandard

        sizes = []
        for data in (self.bad, self.good):
            held = {"dict_data": zstandard.ZstdCompressionDict(data)} if data else {}
            squeeze = zstandard.ZstdCompressor(level=self.level, write_content_size=False, write_checksum=False, write_dict_id=False, **held).compress
            sizes.append(np.array([sum(len(squeeze(t[a : a + BLOCK])) for a in range(0, len(t), BLOCK)) for t in texts], float))
        n = np.array([max(1, len(t)) for t in texts], float)
        return (sizes[0] - sizes[1]) / n if texts else np.empty(0)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * x + self.intercept, -30, 30)))


def calibrate(x: np.ndarray, y: np.ndarray, steps: int = 50, ridge: float = 1e-3, weights: np.ndarray | None = None) -> tuple[float, float]:
    """Slope and intercept of a logistic fit by Newton steps on the standardised difference; one class only: its smoothed share.

    weights: what each row stands for, relative to the others (None: the same).
    """
    if not len(y) or y.min() == y.max():
        p = (y.sum() + 1) / (len(y) + 2)
        return 0.0, float(np.log(p / (1 - p)))
    mean, spread = x.mean(), x.std() or 1.0
    z = np.column_stack([(x - mean) / spread, np.ones(len(x))])
    w, v = np.zeros(2), np.ones(len(x)) if weights is None else weights / weights.mean()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hessian = (z * (v * p * (1 - p))[:, None]).T @ z + ridge * np.eye(2)
        step = np.linalg.solve(hessian, z.T @ (v * (y - p)) - ridge * w)
        w += step
        if abs(step).max() < 1e-9:
            break
    return float(w[0] / spread), float(w[1] - w[0] * mean / spread)


def train(rows: list[tuple[int, bytes]], size: int = 1 << 16, level: int = 3, counts: dict[int, int] | None = None) -> Model:
    """Fit on (label, text) rows: two of three rows make the dictionaries, the third calibrates the score.

    counts: the documents of each class that the rows were drawn from; the calibration gives each class that weight, so
    the score does not depend on how many were drawn (None: the rows are all there are).
    """
    parts: dict[int, list[bytes]] = {0: [], 1: []}
    for label, text in rows:
        parts[label].append(text)
    held = [(y, t) for y, texts in parts.items() for t in texts[::3]]
    made = {y: dictionary([t for i, t in enumerate(texts) if i % 3] or texts, size) for y, texts in parts.items()}
    model = Model(made[1], made[0], level=level)
    x = model.differ([t for _, t in held])
    stands = {y: (counts[y] if counts else len(texts)) / len(parts[y][::3]) for y, texts in parts.items() if texts}
    model.slope, model.intercept = calibrate(x, np.array([y for y, _ in held], float), weights=np.array([stands[y] for y, _ in held]))
    return model


def marked(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """__d and __y: the label of each labelled document (the lowest of several), without null or other labels."""
    return labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("__d")).agg(F.min(label_col).alias("__y"))


def counted(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str, label_col: str) -> dict[int, int]:
    """How many usable documents of each class there are, whatever their size. Texts are not read."""
    ids = docs.filter(usable).select(F.col(id_col).cast("long").alias("__d")).distinct()
    return {int(r[0]): r[1] for r in ids.join(marked(labels, id_col, label_col), "__d").groupBy("__y").agg(F.count(F.lit(1))).collect()}


def sample(docs: DataFrame, labels: DataFrame, usable: Column, per_class: int, longest: int, id_col: str, text_col: str, label_col: str) -> list[tuple[int, bytes]]:
    """(label, text) of at most per_class labelled documents of either class that are usable and at most `longest` bytes.

    A document with several labels counts by the lowest, a row with a null or other label not at all. Ids are drawn by
    hash from the labels and document sizes; then only their texts are read, of rows that share an id one (the least by
    hash), so that the bound holds whatever is repeated.
    """
    marks = marked(labels, id_col, label_col)
    texts = docs.filter(usable & (F.octet_length(text_col) <= longest)).select(F.col(id_col).cast("long").alias("__d"), F.col(text_col).alias("__text"))
    ids = {r[0]: int(r[1]) for r in sampled(texts.select("__d").join(marks, "__d").distinct(), "__y", "__d", per_class).select("__d", "__y").collect()}
    if not ids:
        return []
    rows = texts.filter(F.col("__d").isin(list(ids))).groupBy("__d").agg(F.min_by("__text", F.struct(F.xxhash64("__text"), "__text"))).collect()
    return [(ids[d], text.encode()) for d, text in sorted((r[0], r[1]) for r in rows)]


def fit(docs: DataFrame, labels: DataFrame, usable: Column, *, per_class: int = 2000, longest: int = 1 << 15, size: int = 1 << 16, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """A model of label_col of the usable rows, from a sample bounded by per_class and longest (64 MiB a class at most by default).

    The sample is weighted by the classes' counts over all usable rows.
    """
    rows = sample(docs, labels, usable, per_class, longest, id_col, text_col, label_col)
    return train(rows, size, counts=counted(docs, labels, usable, id_col, label_col) if rows else None)


def score(docs: DataFrame, model: Model, *, text_col: str = "text", column: str = "score") -> DataFrame:
    """Every row of docs with the calibrated probability that its whole text is good.

    A null or empty text has difference 0 and so the score of that; other columns pass through, one named `column` is
    replaced. Rows are scored one by one, so repeated rows, ties and null ids need no rule.
    """
    from pyspark.sql.types import DoubleType, StructField, StructType

    schema = StructType([f for f in docs.schema.fields if f.name != column] + [StructField(column, DoubleType())])
    kept = [f.name for f in schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [(x or "").encode() for x in part.column(part.schema.get_field_index(text_col)).to_pylist()]
                found = pa.array(model.score(model.differ(texts)), pa.float64())
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in kept), found], [*kept, column])

    return docs.select(*dict.fromkeys([*kept, text_col])).mapInArrow(lean(run), schema)

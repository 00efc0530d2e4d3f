"""A stored index of vectors: an inverted file of lists around centroids, product-quantised residuals within.

A folder of Parquet tables:

* `model`: the centroids and the codebooks of the residuals' parts, fitted once on a bounded sample (SAMPLE_PER_LIST rows a
  list and ENTRY_SAMPLE an entry).
* `entries`, by generation and list: every row with its code, how far the code is off, and its vector. A search reads the
  lists that it probes; where a list meets its questions, codes choose the rows whose vectors are compared.
* `lists`: rows and radius of each list of each generation.

Rows are appended as a new generation under the same model, nothing is rebuilt. Similarities are cosines; vectors are
indexed at length 1.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, StructField, StructType

from lexloom.functions.vectors import cosine, is_embedded
from lexloom.operators.retrieval import VECTOR_LIMIT, nearest_by_cosine, top
from lexloom.session import broadcast_if_small, materialize

#: Bounds of the model, which every task gets: lists at most, rows of the sample for each list and for each entry.
MAX_LISTS, SAMPLE_PER_LIST, ENTRY_SAMPLE = 4096, 64, 64
#: Rows of a list, components of their vectors, and questions, that one task compares at most.
SLICE, SLICE_COMPONENTS, QUESTION_BLOCK = 1 << 16, 1 << 24, 1 << 12


@dataclass
class Model:
    """centroids (lists, dims), books (parts, entries, width) of residuals; dims are filled up with zeros to whole parts."""

    centroids: np.ndarray
    books: np.ndarray
    dims: int

    @property
    def shape(self) -> tuple[int, int]:
        return self.books.shape[0], self.books.shape[2]

    def units(self, vectors: np.ndarray) -> np.ndarray:
        """Vectors at length 1, filled up."""
        out = np.zeros((len(vectors), self.centroids.shape[1]))
        length = np.linalg.norm(vectors, axis=1, keepdims=True)
        out[:, : self.dims] = vectors / np.where(length > 0, length, 1)
        return out

    def encode(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(list, code, distance from the centroid, distance from what the code stands for)."""
        parts, width = self.shape
        home = nearest(units, self.centroids)
        rest = (units - self.centroids[home]).reshape(-1, parts, width)
        code = np.stack([nearest(rest[:, j], self.books[j]) for j in range(parts)], axis=1).astype(np.uint8)
        off = rest - self.books[np.arange(parts), code]
        return home.astype(np.int32), code, np.sqrt((rest**2).sum(axis=(1, 2))), np.sqrt((off**2).sum(axis=(1, 2)))


def nearest(rows: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """The index of each row's nearest entry."""
    lengths, step = (entries**2).sum(axis=1), max(1, (1 << 22) // len(entries))
    return np.concatenate([np.empty(0, np.int64), *((lengths - 2 * rows[i : i + step] @ entries.T).argmin(axis=1) for i in range(0, len(rows), step))])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def k_means(rows: DataFrame, books: np.ndarray, rounds: int) -> np.ndarray:
    """Books (parts, entries, width) after so many rounds over rows (v: array of parts * width doubles).

    A round is one aggregation: each task sums its rows by entry, the sums are added up by entry and component, and only
    these, as many numbers as the books hold, come to the driver. Entries without rows stay.
    """
    parts, entries, width = books.shape

    for _ in range(rounds):

        def sums(batches: Iterator[pa.RecordBatch], books: np.ndarray = books) -> Iterator[pa.RecordBatch]:
            held = np.zeros((parts, entries, 1 + width))
            for batch in batches:
                x = _matrix(batch.column(0)).reshape(-1, parts, width)
                for j in range(parts):
                    own = nearest(x[:, j], books[j])
                    np.add.at(held[j], own, np.c_[np.ones(len(own)), x[:, j]])
            cell = np.flatnonzero(held[:, :, 0].reshape(-1))
            flat = held.reshape(-1, 1 + width)[cell]
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.FixedSizeListArray.from_arrays(pa.array(flat.reshape(-1)), 1 + width).cast(pa.list_(pa.float64()))], ["cell", "sums"])

        added = rows.mapInArrow(sums, "cell int, sums array<double>").select("cell", F.posexplode("sums").alias("c", "s")).groupBy("cell", "c").agg(F.sum("s").alias("s"))
        total = np.zeros((parts * entries, 1 + width))
        for r in added.collect():
            total[r["cell"], r["c"]] = r["s"]
        books = np.where(total[:, :1] > 0, total[:, 1:] / np.maximum(total[:, :1], 1), books.reshape(-1, width)).reshape(books.shape)
    return books


def _usable(chunks: DataFrame, dims: int) -> DataFrame:
    x = F.col("embedding").cast("array<double>")
    return chunks.select("id", x.alias("embedding")).filter(is_embedded(F.col("embedding")) & (F.size("embedding") == dims) & F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("embedding", lambda c: c != 0))


def fit(chunks: DataFrame, dims: int, lists: int | None = None, parts: int = 8, entries: int = 64, rounds: int = 5, seed: int = 5) -> Model:
    """A model of chunks' vectors (id, embedding) from a sample whose bound follows from the model's size, not from the corpus.

    lists: about the square root of the rows if not given, MAX_LISTS at most.
    """
    rows = _usable(chunks, dims)
    n = rows.count()
    lists = max(1, min(lists or math.isqrt(n), MAX_LISTS, n))
    entries = max(1, min(entries, 256, n))
    width = -(-dims // parts)
    if not n:
        return Model(np.zeros((1, parts * width)), np.zeros((parts, 1, width)), dims)
    wanted = max(SAMPLE_PER_LIST * lists, ENTRY_SAMPLE * entries)
    turn = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 40))
    chosen = rows.withColumn("turn", turn).filter(F.col("turn") < int((1 << 40) * min(1.0, 1.1 * wanted / max(1, n))) + 1)
    empty = Model(np.zeros((lists, parts * width)), np.zeros((parts, entries, width)), dims)
    units = _arrow(chosen, empty.units)
    sample = materialize(units)
    first = sample.orderBy("turn").limit(max(lists, entries)).collect()  # as many vectors as the model holds
    start = np.array([r["v"] for r in first], float).reshape(len(first), parts * width)
    centroids = k_means(sample.select("v"), start[None, :lists], rounds)[0]
    rest = _arrow(sample.withColumnRenamed("v", "embedding"), lambda x: x - centroids[nearest(x, centroids)])
    books = (start - centroids[nearest(start, centroids)])[:entries].reshape(-1, parts, width).transpose(1, 0, 2)
    return Model(centroids, k_means(rest.select("v"), books, rounds), dims)


def _arrow(rows: DataFrame, turned) -> DataFrame:
    """(turn, v): rows' embeddings after a function over matrices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = turned(_matrix(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), x.shape[1]).cast(pa.list_(pa.float64()))], ["turn", "v"])

    return rows.select("turn", "embedding").mapInArrow(run, "turn long, v array<double>")


def save(model: Model, spark: SparkSession, path: str) -> None:
    rows = [("centroid", i, [float(x) for x in c], model.dims) for i, c in enumerate(model.centroids)]
    rows += [(f"book {j}", i, [float(x) for x in e], model.dims) for j, book in enumerate(model.books) for i, e in enumerate(book)]
    spark.createDataFrame(rows, "kind string, place int, v array<double>, dims int").coalesce(1).write.mode("error").parquet(f"{path}/model")


def load(spark: SparkSession, path: str) -> Model:
    rows = spark.read.parquet(f"{path}/model").orderBy("kind", "place").collect()  # bounded by MAX_LISTS and 256 entries
    books: dict[int, list[list[float]]] = {}
    for r in rows:
        if r["kind"] != "centroid":
            books.setdefault(int(r["kind"].split()[1]), []).append(r["v"])
    return Model(np.array([r["v"] for r in rows if r["kind"] == "centroid"]), np.array([books[j] for j in sorted(books)]), rows[0]["dims"])


def build(chunks: DataFrame, path: str, dims: int, **how) -> None:
    """Fit a model on chunks (id, embedding) and index them all; path must be new."""
    spark = chunks.sparkSession
    save(fit(chunks, dims, **how), spark, path)
    append(chunks, path, 0)


def append(chunks: DataFrame, path: str, generation: int) -> None:
    """Index more chunks as a generation of its own; one that comes again takes its own place. Ids must be new.

    Rows whose vector has another length, no direction or a component that is no number are not indexed.
    """
    spark = chunks.sparkSession
    model = load(spark, path)
    rows = _usable(chunks, model.dims)
    schema = StructType([rows.schema["id"], StructField("embedding", ArrayType(DoubleType())), StructField("list", IntegerType()), StructField("code", BinaryType()), StructField("away", DoubleType()), StructField("off", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            home, code, away, off = model.encode(model.units(_matrix(batch.column(1))))
            blobs = pa.array([c.tobytes() for c in code], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home), blobs, pa.array(away), pa.array(off)], schema.names)

    # rebalanced by list: a list is few files, and a large one is cut between tasks
    encoded = rows.mapInArrow(run, schema).hint("rebalance", "list").withColumn("generation", F.lit(generation))
    encoded.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("generation", "list").parquet(f"{path}/entries")
    stored = spark.read.schema(encoded.schema).parquet(f"{path}/entries")  # only the columns that follow are read
    mine = stored.filter(F.col("generation") == generation).groupBy("generation", "list").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius"))
    mine.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("generation").parquet(f"{path}/lists")


def search(questions: DataFrame, path: str, limit: int = VECTOR_LIMIT, probes: int = 8, shortlist: int = 8, exact: bool = False, places: int = 6) -> DataFrame:
    """(question_id, id, semantic, rank) of the nearest rows of each question (question_id, vector).

    Each question probes the lists of its `probes` nearest centroids, scores their codes, and has the vectors of the best
    `shortlist` * limit rows of each slice of a list compared. exact: a second pass takes the least of these cosines as a
    bar, probes all lists whose radius lets them reach it, and has all rows compared whose code and error may reach it; so
    nothing that is nearer can be missed, at the price of more lists. Ranks follow the rounded cosine, ties the id.
    Questions whose vector has another length than the index or no direction get no rows.

    Lists that no question probes are not read (partitions pruned by what is probed). Questions and lists meet in slices
    of SLICE rows by QUESTION_BLOCK questions, whatever their numbers.
    """
    spark = questions.sparkSession
    model = load(spark, path)
    try:
        entries, slices, radius = _stored(spark, path, model)
    except AnalysisException as e:  # nothing was usable, so nothing was written
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return questions.select("question_id").limit(0).select("question_id", F.lit(None).cast("long").alias("id"), F.lit(0.0).alias("semantic"), F.lit(1).alias("rank"))
    number = F.col("vector")
    asked = materialize(questions.select("question_id", number.cast("array<double>").alias("vector")).filter((F.size("vector") == model.dims) & F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("vector", lambda c: c != 0)))
    near = _compared(_scored(asked.withColumn("bar", F.lit(None).cast("double")), entries, model, slices, radius, probes, shortlist * limit, limit, places), asked, entries, places)
    if exact:
        # rounding may lift a row by half a unit of the last place to the bar, or lower it to it
        found = top(near, "question_id", [F.desc("semantic"), F.col("id")], limit).groupBy("question_id").agg(F.count(F.lit(1)).alias("n"), F.min("semantic").alias("least"))
        bars = asked.join(found, "question_id", "left").withColumn("bar", F.when(F.col("n") == limit, F.col("least") - 10.0**-places).otherwise(F.lit(-2.0)))
        near = _compared(_scored(materialize(bars.select("question_id", "vector", "bar")), entries, model, slices, radius, None, None, limit, places), asked, entries, places)
    return top(near, "question_id", [F.desc("semantic"), F.col("id")], limit).select("question_id", "id", "semantic", "rank")


def probes_for(spark: SparkSession, path: str, recall: float = 0.97, asked: int = 64, limit: int = VECTOR_LIMIT, shortlist: int = 8) -> int:
    """The least number of probes, doubled from 4, at which about `asked` indexed rows find that share of their nearest rows.

    The questions are a bounded sample of the index (by hash of the id), each compared with its nearest rows by a scan. One
    search over all lists tells which of these the codes let through; how many probes each takes is the place of its list.
    If no smaller number reaches the share, that of all lists is returned.
    """
    model = load(spark, path)
    entries, slices, radius = _stored(spark, path, model)
    live = np.flatnonzero(slices)
    turn = F.pmod(F.xxhash64("id", F.lit(23)), F.lit(1 << 40))
    n = spark.read.parquet(f"{path}/lists").agg(F.sum("n").alias("n")).first()["n"]
    few = materialize(entries.select(F.col("id").alias("question_id"), F.col("embedding").alias("vector"), turn.alias("turn")).filter(F.col("turn") < int((1 << 40) * min(1.0, asked / n)) + 1).drop("turn"))
    wanted = materialize(nearest_by_cosine(few, entries, limit).select("question_id", "id"))
    found = _scored(few.withColumn("bar", F.lit(None).cast("double")), entries, model, slices, radius, len(live), shortlist * limit, limit)
    hits = found.join(wanted, ["question_id", "id"], "left_semi").select("question_id", "list").collect()  # about asked * limit rows
    vectors = {r["question_id"]: r["vector"] for r in few.collect()}
    places = {}
    for q, v in vectors.items():
        about = model.units(np.array([v])) @ model.centroids[live].T
        places[q] = {int(live[at]): place for place, at in enumerate(_closest(about, len(live))[0])}
    needed = np.sort([places[r["question_id"]][r["list"]] + 1 for r in hits])
    bar, probes = recall * wanted.count(), 4
    while probes < len(live):
        if np.searchsorted(needed, probes, "right") >= bar:
            return probes
        probes *= 2
    return len(live)


def _stored(spark: SparkSession, path: str, model: Model) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(entries, slices of each list, radius of each list)."""
    sizes = spark.read.parquet(f"{path}/lists").groupBy("list").agg(F.sum("n").alias("n"), F.max("radius").alias("radius")).collect()  # MAX_LISTS rows at most
    slices, radius = np.zeros(len(model.centroids), np.int64), np.full(len(model.centroids), -np.inf)
    most = max(1, min(SLICE, SLICE_COMPONENTS // model.centroids.shape[1]))
    for r in sizes:
        slices[r["list"]], radius[r["list"]] = -(-r["n"] // most), r["radius"]
    return spark.read.parquet(f"{path}/entries"), slices, radius


def _closest(about: np.ndarray, most: int) -> np.ndarray:
    """The places of each row's highest similarities, highest first."""
    return np.argsort(-about, axis=1, kind="stable")[:, :most]


def _scored(asked: DataFrame, entries: DataFrame, model: Model, slices: np.ndarray, radius: np.ndarray, probes: int | None, keep: int | None, limit: int, places: int = 6) -> DataFrame:
    """(question_id, list, id): of each question's rows the best `keep` by their vectors, of which a cell compares those of its
    `keep` best codes; or of all whose codes may reach its bar those whose vectors do. Either way a cell gives about `limit`
    rows a question at most, which hold its share of the nearest."""
    question, key = asked.schema["question_id"], entries.schema["id"]
    live = np.flatnonzero(slices)
    probe = StructType([question, StructField("q", BinaryType()), StructField("bar", DoubleType()), StructField("list", IntegerType()), StructField("slice", IntegerType()), StructField("near", DoubleType())])

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = model.units(_matrix(batch.column(1)))
            about = units @ model.centroids[live].T
            bars = batch.column(2).to_numpy(zero_copy_only=False).astype(float)
            if probes is None:
                row, at = np.nonzero(about + radius[live] + 1e-9 >= bars[:, None])
            else:
                most = min(probes, len(live))
                at = _closest(about, most).reshape(-1)
                row = np.repeat(np.arange(len(units)), most)
            cells = slices[live[at]]
            row, at, slice_ = np.repeat(row, cells), np.repeat(at, cells), np.concatenate([np.empty(0, np.int64), *(np.arange(c) for c in cells)])
            blobs = pa.array([u.tobytes() for u in units], pa.binary()).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), blobs, pa.array(bars[row]), pa.array(live[at].astype(np.int32)), pa.array(slice_.astype(np.int32)), pa.array(about[row, at])], probe.names)

    blocks = max(1, -(-asked.count() // QUESTION_BLOCK))
    block = F.pmod(F.xxhash64("question_id"), F.lit(blocks)).cast("int")
    probes_ = materialize(asked.select("question_id", "vector", "bar").mapInArrow(probed, probe).withColumn("block", block))
    wanted = probes_.select("list").filter("list >= 0").distinct()  # MAX_LISTS rows at most; its filter lets Spark prune partitions by it
    spread = entries.sparkSession.createDataFrame([(int(i), int(slices[i])) for i in live], "list int, slices int")
    kept = ["id", "list", "code", "off", "embedding"]
    held = entries.select(*kept).join(F.broadcast(wanted), "list", "left_semi").join(F.broadcast(spread), "list")
    held = held.select(*kept, F.pmod(F.xxhash64("id"), F.col("slices")).cast("int").alias("slice"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    out = StructType([question, StructField("list", IntegerType()), key, StructField("about", DoubleType())])
    parts, width = model.shape

    def scored(rows: pa.Table, questions: pa.Table) -> pa.Table:
        rows, questions = rows.combine_chunks(), questions.combine_chunks()
        who, which, about = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
        if rows.num_rows and questions.num_rows:
            code = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8).reshape(-1, parts).astype(np.int64)
            off, near, bars = (t.column(c).to_numpy() for t, c in ((rows, "off"), (questions, "near"), (questions, "bar")))
            flat = code + np.arange(parts) * model.books.shape[1]
            units = model.units(_matrix(rows.column("embedding").combine_chunks()))
            order = np.argsort(np.argsort(rows.column("id").to_numpy(), kind="stable"), kind="stable")
            for i, blob in enumerate(questions.column("q").to_pylist()):
                table = np.einsum("jw,jew->je", np.frombuffer(blob).reshape(parts, width), model.books).reshape(-1)
                score = near[i] + table[flat].sum(axis=1)
                if keep is None:
                    chosen = np.flatnonzero(score + off + 1e-9 >= bars[i])
                else:
                    chosen = np.argpartition(-score, keep)[:keep] if len(score) > keep else np.arange(len(score))
                u = np.frombuffer(blob)
                score[chosen] = (units @ u)[chosen] if 4 * len(chosen) > len(units) else units[chosen] @ u
                if keep is None:
                    chosen = chosen[score[chosen] + 1e-9 >= bars[i]]
                chosen = _share(chosen, score, order, limit, places)
                who.append(np.full(len(chosen), i))
                which.append(chosen)
                about.append(score[chosen])
        q, r = pa.array(np.concatenate(who)), pa.array(np.concatenate(which))
        return pa.table([questions.column("question_id").take(q), rows.column("list").take(r), rows.column("id").take(r), pa.array(np.concatenate(about))], names=out.names)

    cell = ["list", "slice", "block"]
    found = held.groupBy(*cell).cogroup(probes_.groupBy(*cell)).applyInArrow(scored, out)
    if keep is not None:
        found = top(found, "question_id", [F.desc("about"), F.col("id")], keep)
    return found.select("question_id", "list", "id")


def _share(chosen: np.ndarray, score: np.ndarray, order: np.ndarray, limit: int, places: int) -> np.ndarray:
    """Of chosen rows those that may be among the `limit` best by rounded score, then order: these by the scores at hand, and
    rows so close to where rounding turns that a sum in another order may round them otherwise."""
    if len(chosen) <= limit:
        return chosen
    scaled = score[chosen] * 10.0**places
    best = np.lexsort((order[chosen], -np.round(scaled)))[:limit]
    unsure = (np.abs(scaled - np.floor(scaled) - 0.5) < 1e-4) & (scaled >= np.round(scaled[best[-1]]) - 1)
    return chosen[np.union1d(best, np.flatnonzero(unsure))]


def _compared(found: DataFrame, asked: DataFrame, entries: DataFrame, places: int) -> DataFrame:
    """(question_id, id, semantic): found rows with the exact cosine. Only lists that hold found rows are read; where few are
    found they travel to the vectors, not the vectors to them."""
    short = materialize(found)
    vectors = entries.select("list", "id", "embedding").join(F.broadcast(short.select("list").filter("list >= 0").distinct()), "list", "left_semi")
    rows = vectors.join(broadcast_if_small(short, 200_000, 64 << 20), ["list", "id"])
    return rows.join(broadcast_if_small(asked.select("question_id", "vector"), 10_000, 64 << 20), "question_id").select("question_id", "id", F.round(cosine(F.col("embedding"), F.col("vector")), places).alias("semantic"))

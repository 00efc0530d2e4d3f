"""Exact top-k search (op11): three-phase uniform threshold over lists of local scores, one list for each part of the vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm.common import materialize
from lexloom.llm.integer_vectors import MOST, floors, largest, usable

#: Scores that one step of a cell holds at once.
HELD = 1 << 21
#: A cell of the grid: length of the vectors, part, block of candidates, block of queries.
CELL = ["__d", "__j", "__b", "__q"]


def _matrix(table: pa.Table) -> np.ndarray:
    """The parts of a cell's rows, one below the other."""
    return table.column("__p").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)


def local_scores(group: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(query keys, candidate keys, cutoffs, exact local scores) of a cell, some queries at a time.

    Products go through doubles where all sums are below 2**53 and so exact there, else through longs.
    """
    asks = np.asarray(group.column("__ask"))
    if not asks.any() or asks.all():
        return
    queries, rows = group.filter(pa.array(asks)), group.filter(pa.array(~asks))
    q, c = _matrix(queries), _matrix(rows)
    top = int(np.abs(q).max(initial=0)) * int(np.abs(c).max(initial=0)) * q.shape[1]
    kind = np.float64 if top < 1 << 53 else np.int64
    q, c = q.astype(kind), np.ascontiguousarray(c.astype(kind).T)
    keys, others, cuts = queries.column("__r").to_numpy(), rows.column("__r").to_numpy(), queries.column("__cut").to_numpy()
    step = max(1, HELD // len(others))
    for at in range(0, len(keys), step):
        yield keys[at : at + step], others, cuts[at : at + step], (q[at : at + step] @ c).astype(np.int64)


def top_inner_products(
    vectors: DataFrame, is_query: Callable[[Column], Column], *, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024, parts: int = 2, block: int = 1 << 13, query_block: int = 1 << 9
) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest integer inner products of each query row with all other rows.

    is_query: from the id column to the condition that a row is a query.

    Every component x counts as floor(scale * x). Vectors are cut into `parts`; a part's inner products are a list of local
    scores, and a score is the sum of its local ones. Lists are worked out in cells, a block of rows by a block of queries.

    1. Each list gives its best entries of every query. Their whole scores are worked out, and the least of the best is
       the safe cutoff: no row below it can be in the result.
    2. Each query carries its cutoff into all cells, divided evenly between the lists. A list gives all entries that reach
       its share. A row that gives none lies below the cutoff in sum.
    3. Rows whose known entries and shares in place of the others reach the cutoff ask the other lists for their entries.
       Scores at the cutoff or above are ranked.

    Equal vectors are one query; of equal vectors only the k + 1 rows of the smallest ids can be in a result and are
    candidates, so copies cost no entries. A candidate travels once a phase for every `query_block` different queries.
    The entries of the second phase are those above their share; their number depends on the data and has no cap.

    A row is excluded from its own result, not other rows of its id: rows that share an id are candidates one by one, and
    if they are queries each gets its own rows. Ties go to the smaller id, null ids last; null ids are no queries. Vectors
    that are null, empty or hold null or non-finite components take no part. Vectors of different lengths have no product;
    each query sees those of its own length. Fewer candidates than k: all are returned. Other columns are ignored. Where
    scores might not fit into a long, a ValueError says so.
    """
    kept = k + 1
    found = usable(vectors, id_col, vector_col)
    seen = found.agg(largest(scale).alias("most"), F.coalesce(F.max(F.size("__x")), F.lit(0)).alias("dims")).first()
    if seen["most"] ** 2 * seen["dims"] >= MOST:
        raise ValueError(f"components up to {seen['most']:g} in vectors of {seen['dims']} make scores that do not fit into a long")
    rows = materialize(found.select(F.monotonically_increasing_id().alias("__r"), "__id", floors(scale, seen["most"]).alias("__v")))
    near = F.row_number().over(Window.partitionBy("__v").orderBy(F.col("__id").asc_nulls_last(), "__r"))
    candidates = materialize(rows.withColumn("__n", near).filter(F.col("__n") <= kept).drop("__n"))
    asking = rows.filter(is_query(F.col("__id")))
    asked = materialize(asking.groupBy("__v").agg(F.min("__r").alias("__r")).select("__r", "__v"))
    blocks, query_blocks = max(1, -(-candidates.count() // block)), max(1, -(-asked.count() // query_block))
    if blocks * query_blocks * parts < 12:  # few cells: cut finer, so that all cores have work
        blocks = -(-12 // (query_blocks * parts))

    def spot(key: str, salt: int, n: int) -> Column:
        return F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(n)).cast("int")

    def cut(table: DataFrame, ask: bool, *more: Column) -> DataFrame:
        """A row for each part of a vector."""
        size = F.size("__v")
        edge = lambda j: F.floor(size * j / parts).cast("int")
        pieces = F.explode(F.array(*(F.struct(F.lit(j).alias("j"), F.slice("__v", edge(j) + 1, edge(j + 1) - edge(j)).alias("p")) for j in range(parts))))
        return table.select("__r", size.alias("__d"), F.lit(ask).alias("__ask"), *more, pieces.alias("__s")).select("*", F.col("__s.j").alias("__j"), F.col("__s.p").alias("__p")).drop("__s")

    def grid(bars: DataFrame | None = None) -> DataFrame:
        """The parts of candidates and queries, dealt to cells; bars: the queries' cutoffs."""
        told = asked.withColumn("__cut", F.lit(None).cast("long")) if bars is None else asked.join(bars.select("__r", F.col("share").alias("__cut")), "__r", "left")
        held = cut(candidates, False, F.lit(None).cast("long").alias("__cut"), spot("__r", 1, blocks).alias("__b"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("__q"))
        ask = cut(told, True, F.coalesce("__cut", F.lit(-MOST)).alias("__cut"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("__b"), spot("__r", 2, query_blocks).alias("__q"))
        return held.unionByName(ask)

    entry = "g long, r long, j int, s long"

    def table(j: int, found_: list[tuple[np.ndarray, ...]]) -> pa.Table:
        empty = (np.empty(0, np.int64),) * 3
        g, r, s = (np.concatenate(x) for x in zip(empty, *found_, strict=True))
        return pa.table({"g": g, "r": r, "j": np.full(len(g), j, np.int32), "s": s})

    def best(key: tuple, group: pa.Table) -> pa.Table:
        found_ = []
        for g, r, _, s in local_scores(group):
            n = min(kept, len(r))
            at = np.argpartition(-s, n - 1, axis=1)[:, :n]
            found_.append((np.repeat(g, n), r[at].ravel(), np.take_along_axis(s, at, axis=1).ravel()))
        return table(key[1].as_py(), found_)

    def above(key: tuple, group: pa.Table) -> pa.Table:
        found_ = []
        for g, r, bars, s in local_scores(group):
            i, at = np.nonzero(s >= bars[:, None])
            found_.append((g[i], r[at], s[i, at]))
        return table(key[1].as_py(), found_)

    def answer(key: tuple, group: pa.Table, wanted: pa.Table) -> pa.Table:
        found_ = []
        if wanted.num_rows:
            g_, r_ = wanted.column("g").to_numpy(), wanted.column("r").to_numpy()
            for g, r, _, s in local_scores(group):
                mine = np.isin(g_, g)
                by_g, by_r = np.argsort(g), np.argsort(r)
                i, at = by_g[np.searchsorted(g, g_[mine], sorter=by_g)], by_r[np.searchsorted(r, r_[mine], sorter=by_r)]
                found_.append((g_[mine], r_[mine], s[i, at]))
        return table(key[1].as_py(), found_)

    # the first phase: the best of each list, their whole scores, the cutoff
    place = F.row_number().over(Window.partitionBy("g", "j").orderBy(F.desc("s"), "r"))
    gathered = grid().groupBy(*CELL).applyInArrow(best, entry).withColumn("n", place).filter(F.col("n") <= kept).select("g", "r").distinct()
    both = gathered.join(candidates.select(F.col("__r").alias("r"), F.col("__v").alias("c")), "r").join(asked.select(F.col("__r").alias("g"), F.col("__v").alias("q")), "g")
    whole = both.select("g", F.aggregate(F.zip_with("q", "c", lambda a, b: a.cast("long") * b), F.lit(0).cast("long"), lambda a, b: a + b).alias("s"))
    last = F.row_number().over(Window.partitionBy("g").orderBy(F.desc("s")))
    bars = materialize(whole.withColumn("n", last).filter(F.col("n") <= kept).groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("s").alias("cutoff")).filter(F.col("n") == kept).select(F.col("g").alias("__r"), "cutoff", F.expr(f"(cutoff - pmod(cutoff, {parts})) div {parts}").alias("share")))

    # the second: what reaches its share
    known = grid(bars).groupBy(*CELL).applyInArrow(above, entry).groupBy("g", "r").agg(F.sum("s").alias("s"), *(F.count_if(F.col("j") == j).alias(f"has{j}") for j in range(parts)), F.count(F.lit(1)).alias("n"))
    known = known.join(bars.withColumnRenamed("__r", "g"), "g", "left")
    known = materialize(known.filter(F.col("cutoff").isNull() | (F.col("n") == parts) | (F.col("s") + (parts - F.col("n")) * (F.col("share") - 1) >= F.col("cutoff"))))

    # the third: the entries that are missing
    lacking = known.select("g", "r", F.explode(F.array(*(F.when(F.col(f"has{j}") == 0, F.lit(j)) for j in range(parts)))).alias("__j")).filter(F.col("__j").isNotNull())
    sizes = asked.select(F.col("__r").alias("g"), F.size("__v").alias("__d"))
    wanted = lacking.join(sizes, "g").select("g", "r", "__d", "__j", spot("r", 1, blocks).alias("__b"), spot("g", 2, query_blocks).alias("__q"))
    resolved = grid().groupBy(*CELL).cogroup(wanted.groupBy(*CELL)).applyInArrow(answer, entry)
    total = known.select("g", "r", "s", "cutoff").unionByName(resolved.select("g", "r", "s", F.lit(None).cast("long").alias("cutoff"))).groupBy("g", "r").agg(F.sum("s").alias("score"), F.max("cutoff").alias("cutoff"))
    reached = total.filter(F.col("cutoff").isNull() | (F.col("score") >= F.col("cutoff"))).join(candidates.select(F.col("__r").alias("r"), F.col("__id").alias("vec_id")), "r")

    order = [F.desc("score"), F.col("vec_id").asc_nulls_last(), F.col("r")]
    ranked = reached.withColumn("n", F.row_number().over(Window.partitionBy("g").orderBy(*order))).filter(F.col("n") <= kept)
    lists = ranked.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("n", "r", "vec_id", "score"))).alias("best"))
    mine = asking.join(asked.select("__v", F.col("__r").alias("g")), "__v").select("g", F.col("__r").alias("own"), F.col("__id").alias("query_id")).join(lists, "g")
    others = F.slice(F.filter("best", lambda x: x["r"] != F.col("own")), 1, k)
    return mine.select("query_id", F.posexplode(others).alias("at", "x")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))

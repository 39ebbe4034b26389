"""Exact top-k search by no-random-access aggregation (Fagin, Lotem and Naor, 2003).

Rows are dealt into blocks, and every block stores its rows as sorted lists,
one for each component. A query reads the lists of a block in step, a list
from its high end where the query's component is positive and from its low end
where it is negative. Of a row it knows the products read so far; each unread
component lies between the list's other end and the last value read. That
gives every row a lower and an upper bound. A query stops with a block when
all but a few rows have an upper bound below its ``k``-th best lower bound
(scores from earlier blocks count too); the rows left are scored in full.

Queries go to the lists in blocks of bounded size, so no task holds more than
one block of queries and one block of rows; no pair of rows is written.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from possum.llm.common import Scratch, ship

ROWS, QUERIES, AT_ONCE = 4096, 2048, 256
DEPTHS = (1 / 16, 1 / 8, 1 / 4, 3 / 8, 1 / 2, 3 / 4, 1)
OPEN_ROWS = 64  # a query leaves the lists with so many rows undecided
LARGEST = 1 << 24  # of a scaled component; beyond it scores could leave 64 bits
LAST = (1 << 63) - 1  # a null id sorts here
NEVER = -(1 << 62)


def undecided(queries: np.ndarray, own: np.ndarray, order: np.ndarray, values: np.ndarray, bar: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) pairs that may be among a query's best ``k`` of all scores seen, by reading lists.

    ``order``, ``values``: (components, rows), a row of each being a list by
    ascending value. ``own`` marks pairs that don't count. ``bar``: a score
    that a query's row must reach.
    """
    dims, n = order.shape
    kind = np.float64 if dims * float(abs(queries).max(initial=0)) * float(abs(values).max(initial=0)) < 1 << 50 else np.int64
    values, queries = values.astype(kind), queries.astype(kind)
    pos, neg = np.maximum(queries, 0), np.minimum(queries, 0)
    at, column = np.arange(len(queries)), np.arange(dims)[:, None]
    known = np.zeros((len(queries), n), kind)
    high, low = np.zeros((n, dims), kind), np.zeros((n, dims), kind)  # 1 where a list has shown the row
    found_q, found_r, read = [], [], 0
    for depth in DEPTHS:
        to = max(read + 1, min(n, math.ceil(depth * n)))
        for side, part, seen in ((slice(n - to, n - read), pos, high), (slice(read, to), neg, low)):
            new = np.zeros((n, dims), kind)
            new[order[:, side], column] = values[:, side]
            seen[order[:, side], column] = 1
            known += part[at] @ new.T
        p, q = pos[at], neg[at]

        def bound(for_pos: np.ndarray, for_neg: np.ndarray) -> np.ndarray:
            """Known products, and for what is unread the component's bound."""
            a, b = p * for_pos, q * for_neg
            return known + (a + b).sum(axis=1)[:, None] - a @ high.T - b @ low.T

        lower, upper = bound(values[:, 0], values[:, -1]), bound(values[:, n - to], values[:, to - 1])
        lower[own[at]] = upper[own[at]] = NEVER
        need = bar[at].astype(kind)
        if n >= k:
            need = np.maximum(need, np.partition(lower, n - k, axis=1)[:, n - k])
        open_ = (upper >= need[:, None]) & ~own[at]
        done = open_.sum(axis=1) <= OPEN_ROWS if to < n else np.ones(len(at), bool)
        a, b = np.nonzero(open_[done])
        found_q.append(at[done][a])
        found_r.append(b)
        at, known, read = at[~done], known[~done], to
        if not len(at) or to == n:
            break
    return np.concatenate(found_q), np.concatenate(found_r)


class _Best:
    """The best ``k`` rows of every query, by score and then smallest id."""

    def __init__(self, n: int, k: int):
        self.k, self.bar = k, np.full(n, NEVER, np.int64)
        self.query, self.score, self.id = (np.empty(0, np.int64) for _ in range(3))

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        query, score, ids = np.concatenate([self.query, query]), np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        order = np.lexsort((ids, -score, query))
        query = query[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        top = place < self.k
        self.query, self.score, self.id = query[top], score[order[top]], ids[order[top]]
        full = place[top] == self.k - 1
        self.bar[self.query[full]] = self.score[full]


def _sorted_lists(rows: DataFrame) -> DataFrame:
    """(width, ids, row_of, value): blocks of at most ``ROWS`` rows as lists by ascending value."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def block(width: int, parts: list) -> pa.RecordBatch:
            ids, x = (np.concatenate(p) for p in zip(*parts, strict=True))
            order = np.argsort(x, axis=0, kind="stable").T.astype("<i4")
            value = np.take_along_axis(x.T, order, axis=1).astype("<i4")
            made = [[width], [ids.astype("<i8").tobytes()], [order.tobytes()], [value.tobytes()]]
            return pa.record_batch([pa.array(c, t) for c, t in zip(made, (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["width", "ids", "row_of", "value"])

        for b in batches:
            widths = np.asarray(pc.list_value_length(b.column("v")))
            for width in np.unique(widths).tolist():
                part = b.filter(pa.array(widths == width))
                ids, x = np.asarray(part.column("last")), np.asarray(part.column("v").flatten()).reshape(-1, width)
                for at in range(0, len(ids), ROWS):
                    kept = held.setdefault(width, [])
                    free = ROWS - sum(len(i) for i, _ in kept)
                    kept.append((ids[at : at + free], x[at : at + free]))
                    rest = ids[at + free : at + ROWS], x[at + free : at + ROWS]
                    if sum(len(i) for i, _ in kept) == ROWS:
                        yield block(width, held.pop(width))
                        if len(rest[0]):
                            held[width] = [rest]
        for width, parts in held.items():
            yield block(width, parts)

    return rows.mapInArrow(build, "width int, ids binary, row_of binary, value binary")


def _search(lists: DataFrame, queries: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], n_queries: int, k: int) -> DataFrame:
    """Every task's best ``k`` rows a query: (i, score, last). ``queries``: by width, their numbers, ids and vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(n_queries, k)
        for b in batches:
            for width, *lists_of in zip(*(b.column(c).to_pylist() for c in ("width", "ids", "row_of", "value")), strict=True):
                if width not in queries:
                    continue
                ids = np.frombuffer(lists_of[0], "<i8")
                order, value = (np.frombuffer(x, "<i4").reshape(width, -1) for x in lists_of[1:])
                whole = np.empty((len(ids), width), np.int64)
                whole[order, np.arange(width)[:, None]] = value
                number, own_id, vectors = queries[width]
                for at in range(0, len(number), AT_ONCE):
                    part = slice(at, at + AT_ONCE)
                    q, r = undecided(vectors[part], own_id[part, None] == ids[None], order, value, best.bar[number[part]], k)
                    best.add(number[part][q], np.einsum("ij,ij->i", vectors[part][q], whole[r]), ids[r])
        yield pa.record_batch([pa.array(best.query), pa.array(best.score), pa.array(best.id)], names=["i", "score", "last"])

    return lists.mapInArrow(run, "i long, score long, last long")


def exact_top_k(df: DataFrame, k: int = 5, every: int = 50, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding", block_queries: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row whose id is divisible by ``every``, the ``k`` other rows of largest integer inner product.

    A component x counts as floor(scale * x), x as double; ranks run from 1
    by score, equal scores by ascending vec_id, null ids last. Vectors that
    are null, empty or hold null or non-finite parts take no part, nor do
    those with a scaled part of 2^24 or more, for which a 64-bit score isn't
    sure to hold. Only vectors of one length are compared. A query's own are
    all rows of its id; rows that repeat both id and vector count once, rows
    that share an id only are queries of their own. Other columns are not
    read. An empty table gives an empty result.

    Of equal vectors only the ``k + 1`` smallest ids can be among anyone's
    best ``k``, so only these enter the lists.
    """
    spark = df.sparkSession
    ship(spark)
    scratch = Scratch(spark, "topk")
    x = F.transform(F.col(f"`{vec_col}`"), lambda c: c.cast("double") * F.lit(float(scale)))
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), x.alias("x"))
    fits = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float(LARGEST))))
    rows = rows.where((F.size("x") > 0) & fits).select("vec_id", F.transform("x", lambda c: F.floor(c).cast("int")).alias("v")).distinct()
    rows = scratch.save(rows.withColumn("last", F.coalesce("vec_id", F.lit(LAST))))
    place = F.row_number().over(Window.partitionBy("v").orderBy("last"))
    listed = rows.withColumn("place", place).where(F.col("place") <= k + 1).select("last", "v")
    tasks = max(spark.sparkContext.defaultParallelism, math.ceil(rows.count() / (8 * ROWS)))
    lists = scratch.save(_sorted_lists(listed.repartition(tasks, "last")))

    asked = scratch.save(rows.where(F.col("vec_id") % every == 0).select(F.monotonically_increasing_id().alias("q"), "vec_id", "v"))
    blocks = math.ceil(asked.count() / block_queries)
    found = spark.createDataFrame([], "q long, score long, last long, rank int")
    for i in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == i).collect()
        if not block:
            continue
        queries = {}
        for width in {len(r["v"]) for r in block}:
            own = [(n, r) for n, r in enumerate(block) if len(r["v"]) == width]
            queries[width] = np.array([n for n, _ in own]), np.array([r["vec_id"] for _, r in own], np.int64), np.array([r["v"] for _, r in own], np.int64)
        each = _search(lists, queries, len(block), k)
        top = each.withColumn("rank", F.row_number().over(Window.partitionBy("i").orderBy(F.desc("score"), "last"))).where(F.col("rank") <= k)
        numbers = spark.createDataFrame([(n, r["q"]) for n, r in enumerate(block)], "i long, q long")
        found = found.unionByName(scratch.save(top.join(numbers, "i").select("q", "score", "last", "rank")))
    return found.join(asked.select("q", F.col("vec_id").alias("query_id")), "q").select(
        "query_id", F.col("rank").cast("int").alias("rank"), F.nullif("last", F.lit(LAST)).alias("vec_id"), "score")

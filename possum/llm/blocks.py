"""Pairs inside buckets without emitting all pairs of a bucket.

Rows that share a bucket key are compared inside tasks, in blocks of bounded
size. A bucket above the block size is dealt to chunks, and every pair of
chunks becomes a block of its own, so a hot bucket spreads over many tasks and
every pair of its rows still meets in exactly one block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_ROWS = 1024


def deal(rows: DataFrame, node: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(key, node, ...) -> rows of buckets with two rows or more, with block columns c1 <= c2 and own chunk c0."""
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    chunks = F.ceil(F.col("_n") / F.lit(block_rows)).cast("int")
    own = F.when(F.col("_k") > 1, F.pmod(F.xxhash64(F.lit(17), F.col(node)), F.col("_k")).cast("int")).otherwise(F.lit(0))
    return (
        rows.join(sizes, "key")
        .withColumn("_k", chunks)
        .withColumn("c0", own)
        .withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
        .withColumn("c1", F.least("c0", "_o"))
        .withColumn("c2", F.greatest("c0", "_o"))
        .drop("_n", "_k", "_o")
    )


def whole_blocks(batches: Iterator[pa.RecordBatch], rows_at_once: int = 1 << 16) -> Iterator[pa.Table]:
    """Regroups sorted batches (by key, c1, c2) so that no block is cut in two."""
    held: list[pa.Table] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        n += batch.num_rows
        if n < rows_at_once:
            continue
        t = pa.concat_tables(held).combine_chunks()
        cols = [t.column(c).to_numpy() for c in ("key", "c1", "c2")]
        same = np.ones(t.num_rows, bool)
        for c in cols:
            same &= c == c[-1]
        cut = t.num_rows - int(np.argmin(same[::-1])) if not same.all() else 0
        if cut:
            yield t.slice(0, cut)
        held, n = [t.slice(cut)], t.num_rows - cut
    if n:
        yield pa.concat_tables(held).combine_chunks()


def pairs_in(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of rows in one block, offset by offset; chunks against each other only across."""
    key, c0, c1, c2 = (table.column(c).to_numpy() for c in ("key", "c0", "c1", "c2"))
    first = np.ones(len(key), bool)
    first[1:] = (key[1:] != key[:-1]) | (c1[1:] != c1[:-1]) | (c2[1:] != c2[:-1])
    block = np.cumsum(first)
    cross = c1 != c2
    at, d = np.arange(len(key)), 1
    while True:
        at = at[at + d < len(key)]
        at = at[block[at] == block[at + d]]
        if not len(at):
            return
        mate = at + d
        ok = ~cross[at] | (c0[at] != c0[mate])
        yield at[ok], mate[ok]
        d += 1


class Forest:
    """Union-find over row indices by array operations: keeps a spanning forest, not the pairs."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.root[a], self.root[b]
            apart = ra != rb
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            if not len(a):
                return
            np.minimum.at(self.root, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up

    def links(self) -> np.ndarray:
        return np.flatnonzero(self.root != np.arange(len(self.root)))

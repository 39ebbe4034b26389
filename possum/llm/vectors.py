"""Embedding near-dedup: cross-polytope hashing after fast Hadamard rotations.

A vector is rotated pseudo-randomly (three rounds of random signs and a fast
Walsh-Hadamard transform), and hashed to the signed axis nearest to it
(Andoni et al., "Practical and Optimal LSH for Angular Distance", 2015). A
table joins two such hashes. Multiprobe: a vector is stored under the
``probes`` best keys of each table. Vectors that share a key are compared.

What meets under a key are vectors rounded to 16 bits a part, a quarter of the
doubles, as every vector travels to all its keys. The rounding moves a cosine by less than
a proven bound (``rounding``): pairs further from the threshold are decided by
it, and only the few nearer ones are compared again in double precision.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from possum.llm.blocks import Forest, deal, pairs_in, whole_blocks
from possum.llm.common import Scratch, ship
from possum.llm.components import components

TABLES, PROBES, SEED = 10, 4, 20240229
SCALE = 32767  # of a part of a unit vector, rounded to 16 bits
WIDE = 1_000_003  # keys of different lengths differ in the remainder by it


def axes(dim: np.ndarray | int) -> np.ndarray | int:
    """Signed axes that a vector of ``dim`` parts can hash to: twice the next power of two, at least 4."""
    return 2 << np.maximum(1, np.ceil(np.log2(np.maximum(dim, 1)))).astype(np.int64)


def rounding(dim: np.ndarray | int) -> np.ndarray | float:
    """Bound on the change of a cosine: each part is off by at most 1 / (2 SCALE), and the parts of a unit vector sum up to at most sqrt(dim)."""
    off = 0.5 / SCALE
    return 2 * np.sqrt(dim) * off + dim * off * off + 1e-12


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of the rows; their length is a power of two."""
    x, h = x.copy(), 1
    n = x.shape[1]
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def signatures(vectors: np.ndarray, tables: int, probes: int, seed: int = SEED) -> np.ndarray:
    """(rows, tables * probes) keys; a table's keys are its best pairs of signed axes."""
    rng = np.random.default_rng(seed)
    n, dim = vectors.shape
    size = int(axes(dim)) // 2
    padded = np.zeros((n, size))
    padded[:, :dim] = vectors
    keys = np.empty((n, tables * probes), np.int64)
    rows = np.arange(n)[:, None]
    near = min(probes, 2 * size)
    for t in range(tables):
        halves = []
        for _ in range(2):
            y = padded
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], size))
            both = np.concatenate([y, -y], axis=1)
            axis = np.argsort(-both, axis=1, kind="stable")[:, :near]
            halves.append((axis, both[rows, axis[:, :1]] - both[rows, axis]))  # what a probe loses
        (a, la), (b, lb) = halves
        loss = (la**2)[:, :, None] + (lb**2)[:, None, :]
        best = np.argsort(loss.reshape(n, -1), axis=1, kind="stable")[:, :probes]
        code = (np.int64(t) * 2 * size + a[rows, best // near]) * 2 * size + b[rows, best % near]
        keys[:, t * probes : t * probes + best.shape[1]] = code
        keys[:, t * probes + best.shape[1] : (t + 1) * probes] = code[:, :1]
    return keys


def _matrix(col: pa.Array | pa.ChunkedArray, kind: type) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    n = len(col)
    return np.asarray(col.flatten(), dtype=kind).reshape(n, -1) if n else np.empty((0, 0), kind)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, where a lambda of ``use`` would compute it for every element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def near_vectors(df: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding", tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    Two rows link if their vectors share a key and their cosine in double
    precision is ``threshold`` or more. Equal vectors are one class with a
    count, so copies need no pairs; a class counts its links to other classes
    inside the tasks and hands on a spanning forest. Vectors that are null,
    zero or hold null or non-finite parts link with nothing and are their own
    component; vectors of different length never link. ``component_id`` is
    the smallest vec_id reachable; null ids count as rows but not as smallest.
    Rows that repeat a vec_id each count. An empty table gives an empty result.
    """
    spark = df.sparkSession
    ship(spark)
    scratch = Scratch(spark, "vectors")
    vec = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), vec.alias("v"))
    norm2 = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(finite & (F.size("v") > 0) & F.exists("v", lambda x: x != 0), F.lit(False))
    # scaled by the largest part first, so that squares neither overflow nor vanish
    top = F.array_max(F.transform("v", lambda x: F.abs(x)))
    unit = rows.withColumn("ok", usable).withColumn("v", F.when(F.col("ok"), _once(top, lambda m: F.transform("v", lambda x: x / m + 0.0))))
    unit = unit.withColumn("v", F.when(F.col("ok"), _once(F.sqrt(norm2), lambda m: F.transform("v", lambda x: x / m))))
    names = [F.when(F.col("ok"), F.xxhash64(F.lit(seed), "v")).alias(h) for h, seed in (("h1", 1), ("h2", 2))]  # 128 bits
    unit = scratch.save(unit.select("vec_id", "ok", "v", *names))
    grouped = unit.where("ok").groupBy("h1", "h2").agg(F.first("v").alias("v"), F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"))
    classes = scratch.save(grouped.select(F.monotonically_increasing_id().alias("cid"), "*"))  # numbered once, as it is written
    widest = classes.agg(F.max(F.size("v")).alias("w")).first()["w"] or 1
    code = next(np.dtype(t) for t in ("u2", "u4", "i8") if int(axes(widest)) ** 2 <= 1 << (8 * np.dtype(t).itemsize - (t == "i8")))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths = np.diff(np.asarray(b.column(1).offsets))
            for width in np.unique(lengths):
                part = b.take(pa.array(np.flatnonzero(lengths == width)))
                v = _matrix(part.column(1), np.float64)
                keys = signatures(v, tables, probes)
                codes = (keys % int(axes(width)) ** 2).astype(code)
                short = np.round(v * SCALE).astype(np.int16)
                keys = keys * WIDE + int(width)  # a length has its own keys
                bytes_of = lambda m: pa.array([x.tobytes() for x in m], pa.binary())
                yield pa.record_batch([part.column(0), part.column(2), pa.array(list(keys), pa.list_(pa.int64())), bytes_of(codes), bytes_of(short)], names=["cid", "n", "keys", "codes", "short"])

    signed = scratch.save(classes.select("cid", "v", "n").mapInArrow(sign, "cid long, n long, keys array<long>, codes binary, short binary"))
    dealt = deal(signed.select("cid", F.explode(F.array_distinct("keys")).alias("key")), "cid")
    full = dealt.join(signed.select("cid", "n", "codes", "short"), "cid")
    ready = full.repartition("key", "c1", "c2").sortWithinPartitions("key", "c1", "c2", "cid").select("key", "c0", "c1", "c2", "cid", "n", "codes", "short")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_blocks(batches, 1 << 14):
            key, cid, n = (t.column(c).to_numpy() for c in ("key", "cid", "n"))
            codes, _ = _rows_of(t.column("codes"), code)
            v, width = _rows_of(t.column("short"), np.dtype(np.int16))
            v, codes = v / SCALE, codes.astype(np.int64)
            forest, count, doubts = Forest(len(cid)), np.zeros(len(cid), np.int64), []
            for a, b in pairs_in(t):
                cosine, bound = np.einsum("ij,ij->i", v[a], v[b]), rounding(width[a])
                close = cosine >= threshold - bound
                a, b, sure = a[close], b[close], (cosine >= threshold + bound)[close]
                if not len(a):
                    continue
                forest.join(a[sure], b[sure])
                # a pair that shares several keys counts in the block of the least one
                low, square = np.full(len(a), np.iinfo(np.int64).max), axes(width[a]) ** 2
                for p in range(tables):
                    ka, kb = (codes[x, p * probes : (p + 1) * probes] for x in (a, b))
                    shared = (ka[:, :, None] == kb[:, None, :]).any(axis=2)
                    least = np.where(shared, ka, np.iinfo(np.int64).max).min(axis=1)
                    low = np.where(shared.any(axis=1), np.minimum(low, (p * square + least) * WIDE + width[a]), low)
                once = low == key[a]
                np.add.at(count, a[once & sure], n[b[once & sure]])
                np.add.at(count, b[once & sure], n[a[once & sure]])
                doubts.append((cid[a[once & ~sure]], cid[b[once & ~sure]]))
            at = np.flatnonzero((forest.root != np.arange(len(cid))) | (count > 0))
            yield _found(cid[at], cid[forest.root[at]], count[at], True)
            for a, b in doubts:
                yield _found(a, b, np.zeros(len(a), np.int64), False)

    found = scratch.save(ready.mapInArrow(compare, "a long, b long, links long, sure boolean"))
    exact = F.aggregate(F.zip_with("va", "vb", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    ends = [classes.select(F.col("cid").alias(c), F.col("v").alias(f"v{c}"), F.col("n").alias(f"n{c}")) for c in ("a", "b")]
    proven = scratch.save(found.where("not sure").select("a", "b").join(ends[0], "a").join(ends[1], "b").where(exact >= threshold).select("a", "b", "na", "nb"))
    certain = found.where("sure")
    roots = components(certain.select("a", "b").union(proven.select("a", "b")), scratch)
    each = certain.select("a", "links").union(proven.select("a", "nb")).union(proven.select("b", "na"))
    links = each.groupBy(F.col("a").alias("cid")).agg(F.sum("links").alias("links"))
    named = scratch.save(classes.select("cid", "h1", "h2", "rep", "n").join(roots, F.col("cid") == F.col("node"), "left").select("cid", "h1", "h2", "rep", "n", F.coalesce("root", "cid").alias("root")))
    least = scratch.save(named.groupBy("root").agg(F.min("rep").alias("component_id")))
    known = named.join(least, "root").join(links, "cid", "left").select("h1", "h2", "component_id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    return unit.select("vec_id", "h1", "h2").join(known, ["h1", "h2"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"),
        (F.col("vec_id") == F.coalesce("component_id", "vec_id")).alias("kept"),
    )


def _found(a: np.ndarray, b: np.ndarray, links: np.ndarray, sure: bool) -> pa.RecordBatch:
    return pa.record_batch([pa.array(a), pa.array(b), pa.array(links), pa.array(np.full(len(a), sure))], names=["a", "b", "links", "sure"])


def _rows_of(col: pa.ChunkedArray, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a binary column as numbers, padded with zeros, and their lengths."""
    rows = col.combine_chunks().to_pylist()
    lengths = np.array([len(r) for r in rows], np.int64) // kind.itemsize
    flat = np.frombuffer(b"".join(rows), kind)
    out = np.zeros((len(rows), lengths.max(initial=0)), kind)
    row = np.repeat(np.arange(len(rows)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out, lengths

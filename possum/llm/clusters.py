"""Centroid clustering in JVM expressions.

Vectors are integers, so distances, sums and centroids are exact and the same
on any cluster. The centroids stand in the plan as literal arrays; ``zip_with``
and ``aggregate`` give a vector's squared distance to each, ``array_min`` over
(distance, number) structs picks the nearest. New centroids come from one
column sum for each component, grouped by cluster: partial sums in generated
code, so a task hands on one row a cluster, however large the cluster.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from possum.llm.common import Scratch

LARGEST = 1 << 27  # of a scaled component; beyond it a squared distance could leave 64 bits
TASK_ROWS = 100_000

Centroids = list[list[int]]


def nearest(v: Column, centroids: Centroids) -> Column:
    """(distance, cluster) of the nearest centroid; equal distances take the smaller number."""

    def distance(c: list[int]) -> Column:
        squares = F.zip_with(v, F.expr(f"array({', '.join(f'{x}L' for x in c)})"), lambda a, b: (a - b) * (a - b))
        return F.aggregate(squares, F.lit(0).cast("long"), lambda s, x: s + x)

    return F.array_min(F.array(*[F.struct(distance(c).alias("distance"), F.lit(i).alias("cluster")) for i, c in enumerate(centroids)]))


def moved(vectors: DataFrame, centroids: Centroids) -> Centroids:
    """The componentwise floor of every cluster's mean; an empty cluster's centroid stays."""
    parts = range(len(centroids[0]))
    sums = [F.sum(F.element_at("v", i + 1).cast("decimal(20,0)")).alias(f"s{i}") for i in parts]
    found = vectors.select("v", nearest(F.col("v"), centroids)["cluster"].alias("cluster")).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *sums).collect()
    out = [list(c) for c in centroids]
    for r in found:  # one row a centroid
        out[r["cluster"]] = [int(r[f"s{i}"]) // r["n"] for i in parts]
    return out


def cluster_vectors(df: DataFrame, k: int = 16, rounds: int = 3, width: int = 64, scale: int = 64, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector.

    Kept are vectors of exactly ``width`` parts, none null or non-finite; a
    part x counts as floor(scale * x), x as double. Vectors with a scaled part
    of 2^27 or more are left out too, as a 64-bit distance isn't sure to hold
    for them; an inertia beyond 64 bits is null. The first centroids are the
    ``k`` vectors (all, if fewer) with the smallest SHA-256 of ``1:<vec_id>``
    in that order; equal hashes go by the vector, a null id hashes as ``1:``.
    Rows that repeat an id or a vector each count. Other columns are not read.
    An empty table gives an empty result.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "clusters")
    x = F.transform(F.col(f"`{vec_col}`"), lambda c: c.cast("double") * F.lit(float(scale)))
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), x.alias("x"))
    fits = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float(LARGEST))))
    kept = rows.where((F.size("x") == width) & fits).select("vec_id", F.transform("x", lambda c: F.floor(c)).alias("v"))
    # a file of vectors is small for its work, so its rows are dealt out before the rounds read them
    tasks = max(spark.sparkContext.defaultParallelism, math.ceil(df.count() / TASK_ROWS))
    kept = scratch.save(kept.repartition(tasks, F.xxhash64("vec_id", "v")))

    draw = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    seeds = kept.select(draw.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    if not seeds:
        return kept.select("vec_id", F.lit(0).alias("cluster"), *[F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")], F.lit("").alias("centroid_sha256"))
    centroids = [list(r["v"]) for r in seeds]
    for _ in range(rounds):
        centroids = moved(kept, centroids)
    near = nearest(F.col("v"), centroids)
    assigned = scratch.save(kept.select("vec_id", near.alias("near")).select("vec_id", "near.cluster", "near.distance"))
    sums = {r["cluster"]: int(r["s"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    known = [(i, _long(s), _long(sum(sums.values())), digest[i]) for i, s in sums.items()]
    per_cluster = spark.createDataFrame(known, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(per_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _long(x: int) -> int | None:
    return x if x < 1 << 63 else None

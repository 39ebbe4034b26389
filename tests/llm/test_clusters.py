"""Centroid clustering against plain Python."""

import hashlib
import math
import random

import numpy as np
import pytest

from possum.llm import clusters

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, v int, distance int"


def plain(rows, k, rounds, width):
    kept = [(i, [math.floor(64 * float(np.float32(c))) for c in x]) for i, x in rows
            if x is not None and len(x) == width and all(c is not None and math.isfinite(c) and abs(c * 64) < 1 << 27 for c in x)]
    drawn = sorted((hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)
    centroids = [v for _, v in drawn[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        own = [[] for _ in centroids]
        for _, v in kept:
            own[near(v)[1]].append(v)
        centroids = [[sum(x) // len(vs) for x in zip(*vs)] if vs else c for c, vs in zip(centroids, own)]
    out = [(i, *reversed(near(v))) for i, v in kept]
    total = sum(d for *_, d in out)
    return sorted(((i, c, d, sum(y for _, x, y in out if x == c), total, hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for i, c, d in out), key=repr)


def found(spark, rows, **kwargs):
    df = spark.createDataFrame([(i, x, 1, "c", 2, 3) for i, x in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in clusters.cluster_vectors(df, **kwargs).collect()), key=repr)


@pytest.mark.parametrize("k,rounds", [(16, 3), (3, 1), (500, 2)])
def test_rounds(spark, k, rounds):
    r = random.Random(k)
    rows = [(i, [r.gauss(i % 4, 0.5) for _ in range(8)]) for i in range(300)]
    rows += [(i, rows[5][1]) for i in range(300, 420)]  # copies: a hot cluster, empty clusters where they are seeds
    assert found(spark, rows, k=k, rounds=rounds, width=8) == plain(rows, k, rounds, 8)


def test_odd_vectors(spark):
    rows = [
        (1, [0.5, -0.5]), (1, [0.5, -0.5]), (2, None), (3, []), (4, [1.0]), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [float("-inf"), 1.0]),
        (None, [2.0, 2.0]), (None, [-2.0, 2.0]), (8, [-0.001, 0.0]), (9, [3e38, 0.0]), (10, [0.0, 0.0]), (11, [0.0, 0.0]), (-3, [7.0, 9.0]), (12, [1.0, 2.0, 3.0]),
    ]
    for k in (1, 2, 4, 16):
        assert found(spark, rows, k=k, rounds=3, width=2) == plain(rows, k, 3, 2)


def test_nothing_to_cluster(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, [1.0]), (2, None)]) == []


def test_equal_distances_take_the_smaller_number(spark):
    v = spark.createDataFrame([([0, 0],)], "v array<long>")
    assert v.select(clusters.nearest(clusters.F.col("v"), [[1, 0], [0, -1], [0, 1]]).alias("n")).first()["n"].asDict() == {"distance": 1, "cluster": 0}

"""Exact top-k search against all inner products."""

import math
import random

import numpy as np
import pytest

from possum.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int, last string, v int, q int"


def ints(vector):
    if not vector or any(x is None or not math.isfinite(x) or abs(x * 256) >= 1 << 24 for x in vector):
        return None
    return tuple(math.floor(256 * float(np.float32(x))) for x in vector)


def plain(rows, k=5, every=50):
    held = {(i, v) for i, x in rows if (v := ints(x)) is not None}
    out = []
    for q, a in held:
        if q is None or q % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a, b)), math.inf if i is None else i) for i, b in held if i != q and len(a) == len(b))
        out += [(q, r + 1, None if i == math.inf else i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out, key=repr)


def found(spark, rows, **kwargs):
    df = spark.createDataFrame([(i, x, 1, "last", 2, 3) for i, x in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in topk.exact_top_k(df, **kwargs).collect()), key=repr)


def unit(r, dim, around=None, spread=1.0):
    x = np.array([r.gauss(0, 1) for _ in range(dim)]) * spread + (0 if around is None else around)
    return (x / np.linalg.norm(x)).tolist()


@pytest.mark.parametrize("block_queries", [2048, 3])
def test_all_inner_products(spark, block_queries):
    r = random.Random(3)
    centres = [np.array(unit(r, 16)) for _ in range(5)]
    rows = [(i, unit(r, 16, r.choice(centres), 0.1)) for i in range(900)]
    rows += [(i, rows[7][1]) for i in range(900, 1400)]  # a hot copy, query rows among its members
    assert found(spark, rows, block_queries=block_queries) == plain(rows)


def test_odd_vectors(spark):
    rows = [
        (0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [0.0, 1.0]), (50, None), (100, []), (150, [float("nan"), 1.0]), (200, [float("inf"), 1.0]), (250, [None, 1.0]),
        (300, [0.0, 0.0]), (350, [-1.0, -0.001]), (-50, [3e38, 1.0]), (None, [1.0, 1.0]), (None, [1.0, 1.0]), (1, [1.0]), (2, [1.0, 1.0]), (400, [2.0, 2.0, 2.0]), (3, [65535.9, -65535.9]),
    ]
    assert found(spark, rows) == plain(rows)


def test_empty_table(spark):
    assert found(spark, []) == []


@pytest.mark.parametrize("large", [False, True])
def test_lists_lose_no_row(large):
    """Whatever the bar, rows that may be among the best of all seen are found, in doubles and in long integers."""
    r = np.random.default_rng(1)
    x = r.integers(-300, 300, (500, 12)) * (1 << 15 if large else 1)
    x[100:200] = x[3]
    q = np.concatenate([r.integers(-300, 300, (20, 12)) * (1 << 15 if large else 1), x[:10]])
    order = np.argsort(x, axis=0, kind="stable").T
    own = np.zeros((30, 500), bool)
    own[np.arange(20, 30), np.arange(10)] = True
    scores = q @ x.T
    scores[own] = topk.NEVER
    best = np.sort(scores, axis=1)[:, -5]
    for bar in (np.full(30, topk.NEVER), best, best + 1):
        a, b = topk.undecided(q, own, order, np.take_along_axis(x.T, order, axis=1), bar, 5)
        want = set(zip(*np.nonzero((scores >= np.maximum(best, bar)[:, None]) & ~own)))
        assert want <= set(zip(a, b))
        assert not own[a, b].any()


def test_lists_are_left_early():
    r = np.random.default_rng(2)
    x = r.normal(size=(4096, 64))
    x = np.floor(256 * x / np.linalg.norm(x, axis=1)[:, None]).astype(int)
    order = np.argsort(x, axis=0, kind="stable").T
    near = x[:32] + r.integers(-4, 5, (32, 64))
    bar = np.einsum("ij,ij->i", near, x[:32])
    a, _ = topk.undecided(near, np.zeros((32, 4096), bool), order, np.take_along_axis(x.T, order, axis=1), bar, 5)
    assert len(a) <= 32 * topk.OPEN_ROWS

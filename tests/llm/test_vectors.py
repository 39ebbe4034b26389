import math

import numpy as np
from conftest import SF_ORACLE
from possum.llm import vectors
from possum.llm.queries import op9_vectors


def brute(rows, threshold=0.9):
    ok = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in rows]
    n = len(rows)
    link = [[False] * n for _ in range(n)]
    for i in range(n):
        for j in range(i):
            a, b = rows[i][1], rows[j][1]
            if ok[i] and ok[j] and len(a) == len(b):
                a, b = np.array(a, np.float64), np.array(b, np.float64)
                a, b = a / np.abs(a).max(), b / np.abs(b).max()
                link[i][j] = link[j][i] = bool(a @ b / np.sqrt((a @ a) * (b @ b)) >= threshold)
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            x = todo.pop()
            for j in range(n):
                if link[x][j] and j not in seen:
                    seen.add(j)
                    todo.append(j)
        comp = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((rows[i][0], sum(link[i]), comp, None if rows[i][0] is None or comp is None else rows[i][0] == comp))
    return sorted(out, key=repr)


def planted():
    r = np.random.default_rng(6)
    rows, i = [], 0
    for c in range(12):
        center = r.normal(size=24)
        for _ in range(int(r.integers(1, 9))):
            rows.append((i, (center + r.normal(size=24) * 0.15).astype(np.float32).tolist()))
            i += 1
        rows += [(i, rows[-1][1]), (i + 1, [2 * x for x in rows[-1][1]])]
        i += 2
    one = rows[0][1]
    odd = [None, [], [0.0] * 24, [None] + one[1:], [float("nan")] + one[1:], [float("inf")] + one[1:], one[:10], [x * 1e-30 for x in one], [x * 1e30 for x in one], [-x for x in one]]
    rows += [(1000 + k, v) for k, v in enumerate(odd)]
    return rows + [(None, one), (3, one), rows[5]]


def test_planted_groups(spark):
    rows = planted()
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "vec_id long, embedding array<float>, label int, key string").repartition(3)
    assert sorted((tuple(r) for r in vectors.near_vectors(df).collect()), key=repr) == brute([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows])


def test_empty(spark):
    assert vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_no_link_missed_on_the_table(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{SF_ORACLE}/embeddings.parquet").collect()]
    assert sorted((tuple(r) for r in op9_vectors(spark, SF_ORACLE).collect()), key=repr) == brute(rows)


def test_recall_at_the_threshold():
    """Pairs just above cosine 0.9, the hardest: keys are shared for nearly all."""
    r = np.random.default_rng(8)
    a = r.normal(size=(3000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = r.normal(size=(3000, 64))
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b = 0.9 * a + np.sqrt(1 - 0.81) * b / np.linalg.norm(b, axis=1, keepdims=True)
    ka, kb = (vectors.signatures(x, vectors.TABLES, vectors.PROBES) for x in (a, b))
    assert np.mean([len(np.intersect1d(x, y)) > 0 for x, y in zip(ka, kb, strict=True)]) >= 0.99


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(1).normal(size=(5, 32))
    assert np.allclose(np.linalg.norm(vectors.hadamard(x), axis=1), np.linalg.norm(x, axis=1))
    assert np.allclose(vectors.hadamard(vectors.hadamard(x)), x)


def near_threshold(dim, cosines, seed):
    """Pairs with these cosines, far from each other."""
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, 2 * len(cosines))))
    out = []
    for i, c in enumerate(cosines):
        a, b = q[:, 2 * i], q[:, 2 * i + 1]
        out += [a, c * a + math.sqrt(1 - c * c) * b]
    return [v.tolist() for v in out]


def test_pairs_that_rounding_cannot_decide(spark):
    cosines = [0.9 + s * d for d in (1e-9, 1e-7, 1e-5, 1e-4, 1e-3) for s in (-1, 1)]
    rows = list(enumerate(near_threshold(64, cosines, 2) + near_threshold(300, cosines, 3)))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = brute(rows)
    assert sum(n for _, n, *_ in want) == 2 * len(cosines)  # one of two each
    assert sorted((tuple(r) for r in vectors.near_vectors(df).collect()), key=repr) == want


def test_rounding_stays_inside_its_bound():
    r = np.random.default_rng(4)
    for dim in (1, 2, 24, 64, 1000):
        a, b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in r.normal(size=(2, 2000, dim)))
        short = lambda x: np.round(x * vectors.SCALE).astype(np.int16) / vectors.SCALE
        assert np.abs((a * b).sum(axis=1) - (short(a) * short(b)).sum(axis=1)).max() <= vectors.rounding(dim)
        assert vectors.axes(dim) == 2 << max(1, (dim - 1).bit_length())

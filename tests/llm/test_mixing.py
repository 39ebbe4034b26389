import math
import re
from collections import Counter

import numpy as np
import pytest
from conftest import SF_ORACLE
from llm_fixture import no_documents, odd_documents, odd_texts
from possum.llm import mixing


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, domain string")


def test_rates_reach_the_targets_and_the_optimum(spark):
    docs, marks = (spark.read.parquet(f"{SF_ORACLE}/{t}.parquet") for t in ("documents", "labels"))
    weights = {"clean": 0.9, "low": 0.07, "toxic": 0.03}
    rows = mixing.mixing_rates(docs, mixing.quality_domains(marks), weights).collect()
    t = np.array([r.n_words for r in rows], float)
    p = np.array([[r.p_clean, r.p_low, r.p_toxic] for r in rows])
    rate = np.array([r.rate for r in rows])
    assert len(rows) == docs.count() and (rate >= 0).all() and np.allclose(p.sum(axis=1), 1)
    got = (rate * t) @ p
    assert np.allclose(got, t.sum() * np.array(list(weights.values())), rtol=1e-6)
    # whole copies have the rates on average
    copies = np.array([r.copies for r in rows])
    assert (np.abs(copies - rate) < 1).all() and abs((copies * t).sum() / (rate * t).sum() - 1) < 0.05
    # held against the labels: the classifier tells toxic documents from clean ones
    toxic = {r.doc_id for r in marks.where("toxic = 1 and quality = 1").collect()}
    clean = {r.doc_id for r in marks.where("toxic = 0 and quality = 1").collect()}
    hit = [r.p_toxic > r.p_clean for r in rows if r.doc_id in toxic]
    miss = [r.p_toxic > r.p_clean for r in rows if r.doc_id in clean]
    assert np.mean(hit) > 0.6 and np.mean(miss) < 0.02


def plain_rates(t, p, targets, rounds=200_000):
    """Projected gradient with a fixed step on the same problem, in the scaled variables."""
    a = np.sqrt(t)[:, None] * p
    x = np.sqrt(t)
    step = 1 / np.linalg.eigvalsh(a.T @ a).max()
    for _ in range(rounds):
        x = np.maximum(0, x - step * (a @ (a.T @ x - targets)))
    return x / np.sqrt(t)


def test_fit_against_plain_projected_gradient(spark):
    r = np.random.default_rng(3)
    t, p = r.integers(1, 50, 40).astype(float), r.dirichlet([0.4, 0.4, 0.4], 40)
    soft = spark.createDataFrame([(int(a), *map(float, b)) for a, b in zip(t, p, strict=True)], "n_words long, p0 double, p1 double, p2 double")
    targets = np.array([300.0, 500.0, 20.0])
    got = np.array([x.rate for x in soft.select(mixing.fit_rates(soft, targets).alias("rate")).collect()])
    assert (got >= 0).all() and np.allclose((got * t) @ p, targets, rtol=1e-6)
    assert np.allclose((plain_rates(t, p, targets) * t) @ p, targets, rtol=1e-3)


def test_unreachable_targets_are_met_as_least_squares_does(spark):
    r = np.random.default_rng(5)
    t, p = r.integers(1, 50, 40).astype(float), r.dirichlet([2, 2, 2], 40)
    soft = spark.createDataFrame([(int(a), *map(float, b)) for a, b in zip(t, p, strict=True)], "n_words long, p0 double, p1 double, p2 double")
    for targets in np.array([[500.0, 300, 0], [0, 0, 1000], [0, 900, 0]]):
        got = np.array([x.rate for x in soft.select(mixing.fit_rates(soft, targets).alias("rate")).collect()])
        best = (plain_rates(t, p, targets) * t) @ p
        assert np.linalg.norm(best - targets) > 10  # not reachable
        assert (got >= 0).all() and np.linalg.norm((got * t) @ p - best) < 1e-3 * targets.max()


def test_rates_that_do_not_settle_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_STEPS", 1)
    monkeypatch.setattr(mixing, "STEP", 1.0)
    soft = spark.createDataFrame([(5, 0.5, 0.5), (7, 0.9, 0.1)], "n_words long, p0 double, p1 double")
    with pytest.raises(RuntimeError):
        mixing.fit_rates(soft, np.array([0.0, 100.0]))


def test_odd_documents(spark):
    known = labels(spark, [(4, "a"), (15, "a"), (6, "b"), (6, "a"), (None, "b"), (99, "b"), (7, None), (8, "other")])
    rows = mixing.mixing_rates(odd_documents(spark), known, {"a": 1.0, "b": 3.0}).collect()
    assert sorted(r.doc_id or 0 for r in rows) == sorted(i or 0 for i, _ in odd_texts())
    assert all(r.rate >= 0 and abs(r.p_a + r.p_b - 1) < 1e-9 for r in rows)
    assert {r.n_words for r in rows if r.doc_id in (1, 2, 3)} == {0}
    none = mixing.mixing_rates(odd_documents(spark), labels(spark, []), {"a": 1.0, "b": 1.0}).collect()
    assert all(abs(r.rate - 1) < 1e-6 and r.copies in (0, 1) and r.p_a == r.p_b for r in none)
    assert mixing.mixing_rates(no_documents(spark), known, {"a": 1.0}).count() == 0


def test_posteriors_against_a_plain_classifier(spark):
    """Bernoulli naive Bayes in plain Python over whole texts."""
    docs, marks = (spark.read.parquet(f"{SF_ORACLE}/{t}.parquet") for t in ("documents", "labels"))
    domains = ["clean", "low", "toxic"]
    rows = mixing.mixing_rates(docs, mixing.quality_domains(marks), dict.fromkeys(domains, 1.0)).collect()
    words = {r.doc_id: set(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in docs.collect()}
    kind = {r.doc_id: "toxic" if r.toxic == 1 else "low" if r.quality == 0 else "clean" for r in marks.collect()}
    known = [(words[i], domains.index(d)) for i, d in kind.items() if i in words]
    n = [sum(k == i for _, k in known) for i in range(3)]
    seen = [Counter(w for ws, k in known if k == i for w in ws) for i in range(3)]
    chosen = []
    for w in set().union(*seen):
        c = [s[w] for s in seen]
        share = sum(c) / len(known)
        gain = round(sum(x * math.log(x / m / share) for x, m in zip(c, n, strict=True) if x), 6)
        if gain >= mixing.MIN_GAIN and max(x / m for x, m in zip(c, n, strict=True)) / share >= mixing.MIN_LIFT:
            chosen.append((-gain, w))
    chosen = [w for _, w in sorted(chosen)[: mixing.FEATURES]]
    chance = {w: [(s[w] + 0.5) / (m + 1) for s, m in zip(seen, n, strict=True)] for w in chosen}
    assert len(chosen) > 10
    for r in rows:
        score = [math.log((m + 1) / (len(known) + 3)) + sum(math.log(p[i] if w in words[r.doc_id] else 1 - p[i]) for w, p in chance.items()) for i, m in enumerate(n)]
        odds = [math.exp(x - max(score)) for x in score]
        for d, o in zip(domains, odds, strict=True):  # the weights are whole millionths
            assert abs(r[f"p_{d}"] - o / sum(odds)) < 1e-3


def test_bounds_of_the_classifier(spark):
    docs = mixing._documents(odd_documents(spark), "doc_id", "text")
    known = labels(spark, [(4, "a"), (15, "a"), (6, "b"), (10, "b")])
    assert mixing.fit_classifier(docs, known, ["a", "b"], max_words=0)[0].count() == 0
    prior = mixing.fit_classifier(docs, known, ["a", "b"], labelled_rows=0)[1]
    assert prior["a"] == prior["b"]


def test_remix_repeats_whole_rows(spark):
    docs = odd_documents(spark)
    same = mixing.remix(docs, labels(spark, []), {"a": 2.0})
    assert same.columns == docs.columns and same.count() == 2 * docs.count()
    assert mixing.remix(no_documents(spark), labels(spark, []), {"a": 2.0}).count() == 0


def test_bad_weights(spark):
    with pytest.raises(ValueError):
        mixing.mixing_rates(no_documents(spark), labels(spark, []), {"a": -1.0})


def test_rows_stay_on_the_executors(spark):
    """The main path has no Python worker."""
    out = mixing.mixing_rates(odd_documents(spark), labels(spark, [(4, "a")]), {"a": 1.0, "b": 1.0})
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan

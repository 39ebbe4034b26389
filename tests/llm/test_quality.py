import math
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from conftest import SF_ORACLE
from llm_fixture import no_documents, odd_documents, odd_texts
from possum.llm import quality


def brute_base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), failed


def flat_model():
    return quality.QualityModel(np.zeros(quality.BUCKETS, np.int64), None)


def test_base_rules_on_odd_documents(spark):
    got = quality.score_quality(odd_documents(spark), flat_model()).collect()
    assert Counter(tuple(r)[:7] for r in got) == Counter((i, *brute_base(t)) for i, t in odd_texts())
    assert all(r.kept == (not r.base_failed) for r in got)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.judge_quality(no_documents(spark), none).count() == 0
    got = quality.judge_quality(odd_documents(spark), none).collect()  # without labels the base rules alone decide
    assert len(got) == len(odd_texts()) and all(r.kept == (not r.base_failed) for r in got)


def slow_buckets(text):
    """Word and word-pair buckets in whole numbers of Python."""
    m = 2**64

    def mix(x):
        x = (x ^ (x >> 29)) * 0xBF58476D1CE4E5B9 % m
        return x ^ (x >> 32)

    h = [xxhash.xxh64_intdigest(w.encode()) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return [mix(x) % quality.BUCKETS for x in h] + [mix((a * 0x9E3779B97F4A7C15 + b) % m) % quality.BUCKETS for a, b in zip(h, h[1:], strict=False)]


@pytest.fixture(scope="module")
def judged(spark):
    docs, labels = (spark.read.parquet(f"{SF_ORACLE}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit_quality(docs, labels)
    rows = quality.score_quality(docs, model).collect()
    return docs, labels, model, rows


def test_model_and_scores_against_plain_python(judged):
    docs, labels, model, rows = judged
    ids = {r.doc_id: r.held for r in quality.trusted_ids(labels).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    raw, target = Counter(), Counter()
    for i, t in texts.items():
        b = slow_buckets(t)
        raw.update(b)
        if ids.get(i) is False:
            target.update(b)
    n, m = sum(raw.values()), sum(target.values())
    ratio = [round(1e6 * (math.log((target[k] + 1) / (m + quality.BUCKETS)) - math.log((raw[k] + 1) / (n + quality.BUCKETS)))) for k in range(quality.BUCKETS)]
    assert np.abs(np.array(ratio) - model.ratio).max() <= 1
    for r in rows:
        b = slow_buckets(texts[r.doc_id])
        assert r.n_grams == len(b) and r.score == sum(int(model.ratio[k]) for k in b)
        assert r.kept == (not r.base_failed and r.score >= model.threshold * len(b))


def test_labels_are_told_apart(judged):
    """Good documents that pass the base rules stay, bad ones go."""
    *_, rows = judged
    marks = {r.doc_id: r.quality for r in judged[1].collect()}
    good = [r.kept for r in rows if marks.get(r.doc_id) == 1 and not r.base_failed]
    bad = [r.kept for r in rows if marks.get(r.doc_id) == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.1


def test_filter_keeps_the_same_rows(judged):
    docs, _, model, rows = judged
    kept = quality.keep_quality(docs, model)
    assert kept.schema == docs.schema
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in rows if r.kept)


def test_filter_on_odd_rows_and_clashing_names(spark):
    docs = odd_documents(spark).withColumnRenamed("fp", "kept").withColumnRenamed("key", "score")
    kept = quality.keep_quality(docs, flat_model())
    assert kept.schema == docs.schema
    assert Counter(r.doc_id for r in kept.collect()) == Counter(i for i, t in odd_texts() if not brute_base(t)[5])
    assert quality.keep_quality(no_documents(spark), flat_model()).count() == 0


def test_toxic_documents_are_not_told_by_the_mean_ratio(judged):
    """A stated limit: fluent toxic documents that pass the base rules stay."""
    *_, rows = judged
    toxic = {r.doc_id for r in judged[1].where("toxic = 1 and quality = 1").collect()}
    kept = [r.kept for r in rows if r.doc_id in toxic and not r.base_failed]
    assert len(kept) >= 20 and np.mean(kept) > 0.5


def test_bounds_of_the_samples(judged):
    _, labels, *_ = judged
    few = quality.trusted_ids(labels, trusted_rows=30, held_rows=10).collect()
    assert len(few) == 40 and {r.held for r in few} == {True, False}
    with pytest.raises(ValueError):
        quality.trusted_ids(labels, held_rows=0)


def test_every_trusted_document_counts(spark):
    """No bound on the labelled documents: all are in the target counts, all set the threshold."""
    labels = spark.range(30_000).selectExpr("id as doc_id", "1 as quality", "0 as toxic")
    ids = quality.trusted_ids(labels)
    assert ids.count() == 30_000 and ids.where("held").count() == 0


def test_lower_edge_counts_all_rows(spark):
    means = spark.range(1000).selectExpr("id * 1000 * 10 as score", "10L as n_grams")
    assert quality._lower_edge(means) == 5  # thousandths 0 to 4 are the 0.005 that may be lost
    assert quality._lower_edge(means.where("score < 0")) is None

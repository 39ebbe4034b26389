import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
import xxhash
from conftest import SF_SMALL
from llm_fixture import no_documents, odd_documents, odd_texts
from possum.llm import blocks, simhash
from possum.llm.queries import op1_simhash


def brute_fingerprint(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows, k=4, bits=4):
    """(id, fingerprint, smallest id of the component) by comparing all pairs."""
    fps = [brute_fingerprint(t, k) for _, t in rows]
    distinct = sorted(set(fps))
    root = {f: f for f in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    a = np.array(distinct, np.uint64)
    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= bits) + i + 1:
            root[find(distinct[j])] = find(distinct[i])
    least = {}
    for (i, _), f in zip(rows, fps, strict=True):
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    return Counter((i, f"{f:016x}", least.get(find(f))) for (i, _), f in zip(rows, fps, strict=True))


def test_odd_documents(spark):
    got = simhash.near_documents(odd_documents(spark))
    assert Counter(map(tuple, got.collect())) == brute(odd_texts())


def test_whole_table_against_all_pairs(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    assert Counter(map(tuple, op1_simhash(spark, SF_SMALL).collect())) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_empty(spark):
    assert simhash.near_documents(no_documents(spark)).count() == 0
    assert simhash.keep_one(no_documents(spark)).count() == 0


def test_keep_one_keeps_the_smallest_id_of_each_component(spark):
    docs = odd_documents(spark)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    want = {c for *_, c in brute(odd_texts())}
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(want - {None})


@pytest.mark.parametrize("width", [1, 3, 4, 8])
@pytest.mark.parametrize("bits", [0, 1, 4, 5, 7])
def test_posting_sets_meet_every_pair(bits, width):
    sets = simhash.posting_sets(bits, width)
    assert all(any(set(s) <= set(c) for s in sets) for c in combinations(range(8), 8 - bits))


@pytest.mark.parametrize("width", [1, 4])
def test_width_changes_no_result(spark, width):
    assert Counter(map(tuple, simhash.near_documents(odd_documents(spark), width=width).collect())) == brute(odd_texts())


def test_too_many_bits():
    with pytest.raises(ValueError):
        simhash.posting_sets(8)
    with pytest.raises(ValueError):
        simhash.posting_sets(4, 0)


def test_dense_bucket_in_small_blocks(spark, monkeypatch):
    """A bucket far above the block size: chunks against chunks lose no link."""
    base = 0x0123456789ABCDEF
    fps = sorted({base ^ (1 << i) ^ (1 << j) for i in range(40) for j in range(40)})
    rows = spark.createDataFrame([(f if f < 2**63 else f - 2**64,) for f in fps], "fp long")
    monkeypatch.setattr(blocks.deal, "__defaults__", (16,))
    links = simhash._links(rows, 4).collect()
    root = {r.fp: r.fp for r in rows.collect()}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in links:
        root[find(r.a)] = find(r.b)
    assert len({find(x) for x in root}) == 1

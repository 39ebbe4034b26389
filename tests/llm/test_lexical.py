"""Ranked lexical search against plain Python over every document."""

import math
import random
import re
from collections import Counter

import pytest

from llm_fixture import no_documents, odd_documents
from possum.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ITEM = "item_id long, text string, doc_id string, q int"


def words(text):
    return [w.translate(LOWER) for w in TERM.findall(text or "")]


def plain(docs, items, k=10):
    bags = [(i, words(t)) for i, t in docs]
    bags = [(i, w, Counter(w)) for i, w in bags if w]
    n, total = len(bags), sum(len(w) for _, w, _ in bags)
    df = Counter(t for *_, c in bags for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, w, c in bags:
            m = 100 - 75 + (75 * len(w) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in words(text) if t in c)
            if s > 0:
                scored.append((-s, math.inf if i is None else i))
        out += [(item, r + 1, None if i == math.inf else i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def ranked(docs, items, **kwargs):
    return sorted((tuple(r) for r in lexical.rank_documents(docs, items, **kwargs).collect()), key=repr)


ITEMS = [
    (1, "alra BETON Zélok one"), (1, "one"), (2, None), (3, "  ...  "), (4, "no such term anywhere"), (None, "two two one"),
    (5, "mail 10 0 255    odd"), (6, "deßu " * 50), (7, "x" * 1000),
]


@pytest.mark.parametrize("block_terms", [50_000, 3])
def test_odd_documents_and_items(spark, block_terms):
    docs = odd_documents(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    items = spark.createDataFrame([(i, t, "clash", 1) for i, t in ITEMS], ITEM)
    assert ranked(docs, items, block_terms=block_terms) == plain(rows, ITEMS)


def test_copies_and_ties(spark):
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(30)]
    bodies = [" ".join(r.choices(vocabulary, k=r.choice([3, 8, 20]))) for _ in range(40)]
    docs = [(i, bodies[0] if i % 3 else r.choice(bodies)) for i in r.sample(range(10_000), 600)]
    docs += [(d + 20_000, " ".join(reversed(t.split()))) for d, t in docs[:100]]  # other texts, equal bags
    items = [(i, " ".join(r.choices(vocabulary + ["unseen"], k=6))) for i in range(25)]
    got = ranked(spark.createDataFrame(docs, "doc_id long, text string").repartition(7), spark.createDataFrame(items, "item_id long, text string"))
    assert got == plain(docs, items)


def test_a_hash_shared_by_two_bags(spark, monkeypatch):
    monkeypatch.setattr(lexical.F, "xxhash64", lambda *c: lexical.F.lit(1).cast("long"))
    docs = [(1, "a b"), (2, "a b"), (3, "a c"), (4, "b c c"), (5, "a")]
    items = [(1, "a c"), (2, "b")]
    got = ranked(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), k=2)
    assert got == plain(docs, items, 2)


def test_sums_beyond_doubles(spark, monkeypatch):
    monkeypatch.setattr(lexical, "EXACT", 1)
    docs, items = [(1, "a b b"), (2, "a"), (3, "c")], [(1, "a a b"), (2, "c")]
    got = ranked(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert got == plain(docs, items)


def test_empty_tables(spark):
    items = spark.createDataFrame([(1, "one")], "item_id long, text string")
    assert ranked(no_documents(spark), items) == []
    assert ranked(odd_documents(spark), items.limit(0)) == []

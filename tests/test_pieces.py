"""Documents put together from the texts of their pieces: a zip's products are never rows of one task."""

import re

from pyspark.sql import functions as F

from conftest import SF_SMALL
from possum import registry
from possum.operators.collect import PIECE, PIECE_BITS, collect_pieces
from possum.plans import documents as D
from possum.sources.sinks import json_documents

FACTS = "zip string, ProductID long, ProductName string, TotalPurchases long, TotalSales decimal(18,2)"


def test_joined_text_is_the_documents_text(spark):
    ids = [-5000, -4096, -1, 0, 4095, 4096, 9000, 1 << 40]
    rows = [(z, i, None if i == 0 else f'na"me, {i}]', i % 7, None) for z in ("00001", "00002", "00009") for i in ids if z != "00002" or i > 0]
    facts = spark.createDataFrame(rows, FACTS)
    # a zip without facts, one without a City row, one with two that are equal
    city = spark.createDataFrame([("00001", "A", None), ("00002", "B,", "TX"), ("00002", "B,", "TX"), ("00003", "C", "TX")], "zip string, city string, state string")
    whole, joined = (sorted(map(tuple, json_documents(D.zip_documents(facts, city, pieces=p), D.DOC_FIELDS["custom1"], ["ZIP"]).collect()))
                     for p in (False, True))
    assert joined == whole and [z for z, _ in joined] == ["00001", "00002", "00002"]


def test_array_at_any_place_and_empty(spark):
    docs = spark.createDataFrame([(1, "x", 1, [3]), (1, "x", 0, [1, 2]), (2, "y", 0, [])], f"k long, s string, {PIECE} long, a array<long>")
    for fields, want in ((["a", "s"], ['{"a":[1,2,3],"s":"x"}', '{"a":[],"s":"y"}']), (["k", "a", "s"], ['{"k":1,"a":[1,2,3],"s":"x"}', '{"k":2,"a":[],"s":"y"}']),
                         (["a"], ['{"a":[1,2,3]}', '{"a":[]}'])):
        assert sorted(r["doc"] for r in json_documents(docs, fields, ["k"]).collect()) == sorted(want)


def test_a_piece_is_bounded(spark):
    rows = spark.range(-6000, 6000).select((F.col("id") % 1).alias("g"), F.col("id").alias("k"))
    pieces = collect_pieces(rows, ["g"], "k", F.col("k"), "a").orderBy(PIECE).collect()
    assert max(len(r["a"]) for r in pieces) == 1 << PIECE_BITS
    assert [k for r in pieces for k in r["a"]] == list(range(-6000, 6000))


def test_zip_popularity_collects_pieces(spark):
    plan = registry.zip_popularity(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    collected = re.findall(r"keys=\[(.*?)\], functions=\[(?:partial_)?collect_list\((.*)", plan)
    assert any(PIECE in keys for keys, _ in collected)
    # what a zip's task collects is text, not elements
    assert all("text" in value and "TotalSales" not in value for keys, value in collected if PIECE not in keys)

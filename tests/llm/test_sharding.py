import zlib
from collections import Counter

from llm_fixture import no_documents, odd_documents, odd_texts
from possum.llm import sharding
from possum.llm.queries import op6_sharding
from conftest import SF_SMALL
from pyspark.sql import functions as F


def test_odd_documents(spark):
    got = sharding.assign_shards(odd_documents(spark)).collect()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in odd_texts())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    by_id = {}
    for r in got:
        assert by_id.setdefault(r.doc_id, (r.shard, r.grown_shard)) == (r.shard, r.grown_shard)
    assert sharding.assign_shards(no_documents(spark)).count() == 0


def test_growth_takes_rows_only_into_the_new_shard(spark):
    got = op6_sharding(spark, SF_SMALL).collect()
    assert {r.shard for r in got} == set(range(8)) and 8 in {r.grown_shard for r in got}
    assert all(r.grown_shard in (r.shard, 8) for r in got)


def test_changed_weight_moves_rows_only_across_its_subtree(spark):
    ids = spark.range(20_000).withColumnRenamed("id", "doc_id")
    tree = sharding.Tree.of(8)
    rack = (("g0/k0", ((0, 1.0), (1, 1.0))), ("g0/k1", ((2, 1.0), (3, 3.0))))
    heavier = sharding.Tree((("g0", rack), tree.regions[1]))
    both = sharding.with_shard(sharding.with_shard(ids, "a", "doc_id", tree), "b", "doc_id", heavier)
    moved = {(r.a, r.b): r.n for r in both.groupBy("a", "b").agg(F.count("*").alias("n")).collect()}
    for a, b in moved:
        if a != b:  # into region 0; inside it into rack 1; inside that into shard 3
            assert b < 4 and (a >= 4 or b >= 2) and (a not in (2, 3) or b == 3)
    share = Counter()
    for (_, b), n in moved.items():
        share[b] += n / 20_000
    assert abs(share[3] - 3 / 10) < 0.02 and abs(share[4] - 1 / 10) < 0.02


def test_written_shards_read_back(spark, tmp_dir):
    docs = odd_documents(spark)
    sharding.write_shards(docs, f"{tmp_dir}/out")
    total = sum(sharding.read_shard(spark, f"{tmp_dir}/out", s).count() for s in range(8))
    assert total == docs.count()


def test_every_count_grows_into_the_new_shard_alone(spark):
    ids = spark.range(4_000).selectExpr("id AS doc_id", "'t' AS text")
    for n in (1, 3, 5, 7, 9):
        got = sharding.assign_shards(ids, shards=n).groupBy("shard", "grown_shard").count().collect()
        assert all(r.grown_shard in (r.shard, n) for r in got)
        into = sum(r["count"] for r in got if r.grown_shard == n)
        assert abs(into / 4_000 - 1 / (n + 1)) < 0.05
    tree = sharding.Tree.of(8)
    assert tree.grown() == sharding.Tree.of(9) and tree.grown().grown() != sharding.Tree.of(10)
    twice = sharding.with_shard(sharding.with_shard(ids, "a", "doc_id", tree.grown()), "b", "doc_id", tree.grown().grown())
    assert twice.where("a <> b and b <> 9").count() == 0 and twice.where("b = 9").count() > 0


def test_columns_of_the_caller_stay(spark, tmp_dir):
    docs = spark.createDataFrame([(i, "r", "k", 70 + i, i) for i in range(50)], "doc_id long, _region string, _rack string, shard int, Shard_ int")
    marked = sharding.with_shard(docs, "at", "doc_id", sharding.Tree.of(8))
    assert marked.columns == [*docs.columns, "at"] and marked.drop("at").exceptAll(docs).count() == 0
    sharding.write_shards(docs, f"{tmp_dir}/out")
    back = [r for s in range(8) for r in sharding.read_shard(spark, f"{tmp_dir}/out", s).select(*docs.columns).collect()]
    assert sorted(map(tuple, back)) == sorted(map(tuple, docs.collect()))

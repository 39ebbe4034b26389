"""CHK3 by digests: equal to the row comparison, and equal copies read no row."""

import random

from possum.operators import digests
from possum.operators.checks import table_diff

SCHEMA = "id long, name string, price decimal(6,2), at timestamp, raw binary, tags array<string>"


def rows(n, seed=1):
    import datetime as dt

    rng = random.Random(seed)
    pick = lambda *v: rng.choice(v)
    from decimal import Decimal

    at = dt.datetime(2024, 1, 1, 0, 0, 0)
    return [
        (pick(None, i, i % 7), pick(None, "", "a", "-", "1:a", "é"), pick(None, Decimal("1.10")), pick(None, at, at.replace(microsecond=rng.randrange(3))),
         pick(None, b"", b"\xff", b"\xfe"), pick(None, [], ["a", "b"], ["a, b"], [None]))
        for i in range(n)
    ]


def check(spark, a, b, depth=2):
    a, b = spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA)
    got = digests.table_diff_digests(a, b, depth)
    assert got.columns == table_diff(a, b).columns
    assert sorted(map(str, got.collect())) == sorted(map(str, table_diff(a, b).collect()))
    return got.count()


def test_equals_the_row_comparison(spark):
    base = rows(300)
    assert check(spark, base, random.Random(2).sample(base, len(base))) == 0
    assert check(spark, base, base[5:] + rows(6, seed=9)) > 0
    assert check(spark, base, base + base[:3]) == 3  # repeated rows count
    assert check(spark, base, []) == 300
    assert check(spark, [], []) == 0
    assert check(spark, base, base[:-1], depth=0) == 1


def test_values_that_look_alike_differ(spark):
    pairs = [("-", None), ("", None), ("1:a", "a"), ("a", "b")]
    for x, y in pairs:
        a = spark.createDataFrame([(x, y)], "p string, q string")
        b = spark.createDataFrame([(y, x)], "p string, q string")
        assert digests.table_diff_digests(a, b, 1).count() == 2


def test_equal_copies_exchange_digests_alone(spark, tmp_dir):
    df = spark.createDataFrame(rows(300), SCHEMA)
    for name in ("mine", "other"):
        df.repartition(3).write.parquet(f"{tmp_dir}/{name}")
    mine, other = (spark.read.parquet(f"{tmp_dir}/{name}") for name in ("mine", "other"))
    trees = []
    for name, copy in (("mine", mine), ("other", other)):
        digests.digest_tree(copy, 2).write.parquet(f"{tmp_dir}/{name}_tree")
        trees.append(spark.read.parquet(f"{tmp_dir}/{name}_tree"))
    same = digests.table_diff_digests(mine, other, 2, tuple(trees))
    assert same.count() == 0
    assert not same.inputFiles()  # the result's plan has no scan
    sizes = {r["level"]: r["n"] for r in trees[0].groupBy("level").sum("n").withColumnRenamed("sum(n)", "n").collect()}
    assert sizes == {0: 300, 1: 300, 2: 300}
    assert digests.differing_leaves(trees[0], digests.digest_tree(mine.where("id is not null or name is not null").limit(299), 2), 2).count() >= 1


def test_depth_follows_the_rows():
    assert [digests.leaf_depth(n, 10) for n in (0, 10, 11, 160, 161)] == [0, 0, 1, 1, 2]
    assert digests.leaf_depth(10**15) == digests.DEEPEST

"""DDL6: a lookup reads one row group of many, an absent id none."""

import pyarrow.parquet as pq

from possum.plans import catalog


def scanned(df):
    """Rows that the scan handed on; the lookup has no shuffle, so its plan is the executed one."""
    got = df.collect()
    leaf = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    return got, leaf.metrics().get("numOutputRows").get().value()


def lookup(spark, path, key):
    return scanned(spark.read.parquet(path).where(f"id = {key}"))


def written(spark, tmp_dir, n=40_000, **sizes):
    df = spark.range(n).selectExpr("(id * 7919) % 40000 * 2 AS id", "repeat(sha2(cast(id as string), 256), 2) AS name")
    catalog.write_lookup(df, "id", f"{tmp_dir}/t", **sizes)
    files = [pq.ParquetFile(f) for f in pq.ParquetDataset(f"{tmp_dir}/t").files]
    return files, [f.metadata.row_group(i) for f in files for i in range(f.metadata.num_row_groups)]


def test_one_row_group_of_many(spark, tmp_dir):
    files, groups = written(spark, tmp_dir, file_bytes=1 << 19, group_bytes=1 << 17)
    assert len(files) >= 4 and len(groups) >= 20
    largest = max(g.num_rows for g in groups)
    for key in (0, 2, 40_000, 79_998):
        got, rows = lookup(spark, f"{tmp_dir}/t", key)
        assert len(got) == 1 and 1 <= rows <= largest
    assert all(g.column(0).has_dictionary_page is False for g in groups)


def test_absent_ids_read_nothing(spark, tmp_dir):
    written(spark, tmp_dir, file_bytes=1 << 19, group_bytes=1 << 17)
    assert lookup(spark, f"{tmp_dir}/t", 80_001) == ([], 0)  # outside every range
    read = [lookup(spark, f"{tmp_dir}/t", key)[1] for key in range(1, 80_000, 4_002)]  # odd keys: inside ranges
    assert len(read) == 20 and sum(r > 0 for r in read) <= 3  # a filter errs in about one of a hundred


def test_ties_nulls_and_no_rows(spark, tmp_dir):
    df = spark.createDataFrame([(5, "a"), (5, "b"), (None, "c"), (7, "d")], "id long, name string")
    catalog.write_lookup(df, "id", f"{tmp_dir}/t")
    assert sorted(r["name"] for r in lookup(spark, f"{tmp_dir}/t", 5)[0]) == ["a", "b"]
    assert spark.read.parquet(f"{tmp_dir}/t").count() == 4
    catalog.write_lookup(df.limit(0), "id", f"{tmp_dir}/t")  # replaces
    assert spark.read.parquet(f"{tmp_dir}/t").count() == 0

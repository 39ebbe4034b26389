"""What an export moves and leaves on disk."""

import os
import time

import pytest
from pyspark.sql import functions as F

from pos_fixture import pos
from possum import schemas
from possum.operators.collect import collect_arrays, collect_in_order
from possum.plans import documents as D
from possum.plans import jobs
from possum.session import REMOVE_SHUFFLES, shuffles_removed
from possum.sources import sinks


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_in_order_equals_the_join(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (3, None), (None, "n")], "k long, name string")
    rows = [(k, i * 7 % 10, f"v{i}") for k in (1, 2, 9, None) for i in range(10)] + [(1, 3, "v9")]
    elements = spark.createDataFrame(rows, "k long, i long, v string").select("k", "i", F.struct("i", "v").alias("e"))
    got = collect_in_order(base, elements, "k", F.col("e"), "a")
    joined = base.join(collect_arrays(elements, ["k"], "i", F.col("e"), "a"), "k", "left")
    want = joined.withColumn("a", F.coalesce("a", F.array().cast(got.schema["a"].dataType)))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert got.columns == want.columns


@pytest.mark.parametrize("kind", jobs.EXPORT_ORDER)
def test_ordered_export_moves_rows_once(spark, kind):
    t = pos(spark)
    built = {way: jobs.build_documents(t, in_order=way)[kind] for way in (False, True)}
    text = plan(built[True].orderBy(jobs.EXPORT_ORDER[kind]))
    assert text.count("Exchange rangepartitioning") == 1
    # what moves by range is rows, not arrays: the order asks for no move above the lists
    assert text.index("collect_list") < text.index("Exchange rangepartitioning")
    one, two = (sorted(r["doc"] for r in sinks.json_documents(d, D.DOC_FIELDS[kind]).collect()) for d in built.values())
    assert one == two


def test_lines_of_an_order_move_as_rows(spark):
    t = pos(spark)
    text = plan(D.order_documents(t.order, t.orderline, t.product))
    assert "partial_collect_list" not in text[text.index("Exchange hashpartitioning(order_id"):]


def test_compressed_export_reads_back_and_plain_is_the_default(spark, tmp_dir):
    t = pos(spark)
    for name in ("customer", "city", "order", "orderline", "product"):
        getattr(t, name).write.parquet(f"{tmp_dir}/tables/{name}")
    found = {}
    for compression in ("none", "gzip"):
        root = f"{tmp_dir}/{compression}"
        jobs.run_export(spark, f"{tmp_dir}/tables", root, version="r", **({} if compression == "none" else {"compression": compression}))
        found[compression] = {k: sorted(map(str, df.collect())) for k, df in jobs.read_documents(spark, root).items()}
        parts = [f for f in os.listdir(f"{root}/cust/v=r") if f.startswith("part-")]
        assert parts and all(f.endswith(".gz") == (compression == "gzip") for f in parts)
    assert found["gzip"] == found["none"] and set(found["none"]) == set(schemas.DOCS) and all(found["none"].values())


def test_shuffle_files_go_with_their_query(spark):
    def files():
        blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {blocks.apply(i).getName() for i in range(blocks.size()) if blocks.apply(i).getName().startswith("shuffle_")}

    before, old = files(), spark.conf.get(REMOVE_SHUFFLES, None)
    with shuffles_removed(spark):
        spark.range(1000).repartition(4, "id").write.format("noop").mode("overwrite").save()
    end = time.time() + 20
    while files() - before and time.time() < end:
        time.sleep(0.2)
    assert not files() - before
    assert spark.conf.get(REMOVE_SHUFFLES, None) == old

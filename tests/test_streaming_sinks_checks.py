"""Streaming upkeep (CHG5, CHG7), publish and JSON sinks (SNK1-SNK5, SRC6), checks (CHK1-CHK3)."""

import dataclasses
import json
import os

import pytest

from pyspark.sql import functions as F

from possum import schemas
from possum.operators import checks
from possum.plans import changes, documents as D, views
from possum.sources import sinks
from possum.session import ensure_checkpoint_dir
from possum.streaming.change_table import ChangeTable, folders, remove
from possum.streaming.refresh import BuyerViewMaintainer, write_log
from pos_fixture import pos


def maintainer(spark, root, t):
    m = BuyerViewMaintainer(spark, root, lambda: t)
    m.bootstrap(t.orderline)
    return m


def lines(spark, *rows):
    return spark.createDataFrame(list(rows), schemas.ORDERLINE_CHANGE)


def same_as_rebuild(m, t, expect_ol):
    assert checks.table_diff(expect_ol, m.orderline()).count() == 0
    rebuilt = views.product_buyers(t.product, t.customer, t.order, expect_ol)
    return checks.table_diff(rebuilt, m.view()).count() == 0


def test_stream_equals_batch_and_replay_is_harmless(spark, tmp_dir):
    t = pos(spark)
    m = maintainer(spark, f"{tmp_dir}/state", t)
    log = lines(spark, (1, "I", 103, 1, 1), (2, "D", 100, 2, None), (3, "I", 104, 4, 2), (4, "D", 103, 1, None),
                (5, "I", 101, 2, 3), (6, "I", 100, 2, 1))
    write_log(log, f"{tmp_dir}/log", 3)
    m.start(f"{tmp_dir}/log", max_files_per_trigger=1).awaitTermination()
    names = folders(spark, f"{tmp_dir}/state/orderline/changes")
    assert len(names) == 3 and len({n.rsplit("-", 1)[0] for n in names}) == 1
    expect = changes.apply_changes(t.orderline, log, ["order_id", "product_id"])
    assert same_as_rebuild(m, t, expect)
    # replays of the last batch and of an earlier one change nothing
    m.apply_batch(log, m.version())
    m.apply_batch(lines(spark, (1, "I", 103, 1, 1)), "again")
    assert same_as_rebuild(m, t, expect)
    assert checks.table_diff(expect, m.lines.current()).count() == 0
    m.lines.compact("c1")
    assert folders(spark, f"{tmp_dir}/state/orderline/changes") == []
    assert same_as_rebuild(m, t, expect)


@pytest.mark.parametrize("mode", ["static", "dynamic"])
def test_new_checkpoint_over_an_old_state(spark, tmp_dir, mode):
    """Batch numbers begin anew with a new query; nothing live is overwritten."""
    old = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", mode)
    try:
        t = pos(spark)
        m = maintainer(spark, f"{tmp_dir}/state", t)
        first, second = lines(spark, (1, "I", 103, 1, 1)), lines(spark, (2, "D", 100, 2, None))
        write_log(first, f"{tmp_dir}/log1", 1)
        m.start(f"{tmp_dir}/log1").awaitTermination()
        remove(spark, f"{tmp_dir}/state/orderline/_stream_checkpoint")
        write_log(second, f"{tmp_dir}/log2", 1)
        m.start(f"{tmp_dir}/log2").awaitTermination()
        assert same_as_rebuild(m, t, changes.apply_changes(t.orderline, first.union(second), ["order_id", "product_id"]))
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", old)


def test_order_that_arrives_later_and_product_rename(spark, tmp_dir):
    t = pos(spark)
    now = {"t": t}
    m = BuyerViewMaintainer(spark, f"{tmp_dir}/state", lambda: now["t"])
    m.bootstrap(t.orderline)
    m.apply_batch(lines(spark, (1, "I", 900, 4, 1)), "q-0")  # no such order yet
    assert m.view().where("productID = 4").first()["customers"] is None
    order = t.order.unionByName(spark.createDataFrame([(900, None, None, 9)], t.order.schema))
    product = t.product.withColumn("name", F.when(F.col("id") == 1, F.lit("Renamed")).otherwise(F.col("name")))
    product = product.unionByName(spark.createDataFrame([(77, "New", None, 1)], t.product.schema))
    now["t"] = dataclasses.replace(t, order=order, product=product)
    m.apply_batch(lines(spark, (2, "I", 101, 2, 1)), "q-1")
    got = {r["productID"]: r for r in m.view().collect()}
    assert got[4]["customers"] == "9 Nina Nine" and got[1]["productName"] == "Renamed" and got[77]["customers"] is None
    assert same_as_rebuild(m, now["t"], m.orderline())


def test_late_change_loses(spark, tmp_dir):
    m = maintainer(spark, f"{tmp_dir}/state", pos(spark))
    m.apply_batch(lines(spark, (9, "I", 100, 1, 9)), "q-0")
    m.apply_batch(lines(spark, (5, "D", 100, 1, None)), "q-1")
    assert m.orderline().where("order_id = 100 AND product_id = 1").first()["quantity"] == 9


def test_deletes_by_predicate_reach_the_table(spark, tmp_dir):
    """FLT3: DELETE FROM Orderline WHERE order_id = 100."""
    t = pos(spark)
    m = maintainer(spark, f"{tmp_dir}/state", t)
    gone = changes.deletes_where(t.orderline, F.col("order_id") == 100, F.lit(3))
    m.apply_batch(gone, "q-0")
    assert same_as_rebuild(m, t, t.orderline.where("order_id <> 100"))


def test_json_sink_modes_and_read_back(spark, tmp_dir):
    t = pos(spark)
    cust = D.cust_documents(t.customer, t.city, t.order, t.orderline, t.product)
    path = f"{tmp_dir}/cust.json"
    sinks.write_json(cust, D.DOC_FIELDS["cust"], path, pretty_path=f"{tmp_dir}/cust.pretty")
    sinks.write_json(cust.limit(1), D.DOC_FIELDS["cust"], path, mode="ignore")  # exists: skipped
    lines = [json.loads(x) for x in spark.read.text(path).toPandas()["value"]]
    assert len(lines) == 5 and any(o["ShippingDate"] is None for d in lines for o in d["Orders"])
    schema = cust.select(*D.DOC_FIELDS["cust"]).schema
    back = sinks.read_json(spark, path, schema)
    assert back.schema["Orders"].dataType.simpleString() == schema["Orders"].dataType.simpleString()
    assert checks.table_diff(cust.select(*D.DOC_FIELDS["cust"]), back).count() == 0


def test_publish_is_atomic_pointer_and_idempotent(spark, tmp_dir):
    df = spark.range(5)
    root = f"{tmp_dir}/pub"
    sinks.publish(spark, df, root, version="v1")
    assert sinks.current_version(spark, root) == "v1"
    sinks.publish(spark, spark.range(3), root, version="v2")
    assert sinks.read_published(spark, root).count() == 3
    sinks.publish(spark, spark.range(7), root, version="v2")  # already current: no-op
    assert sinks.read_published(spark, root).count() == 3
    assert os.path.exists(f"{root}/v=v1")  # old version left for readers still on it


def test_key_checks(spark):
    child = spark.createDataFrame([(1, 10), (1, 10), (2, 99), (None, 10)], "id long, parent long")
    parent = spark.createDataFrame([(10,)], "id long")
    pk = {(r["kind"], r["key"], r["n"]) for r in checks.pk_violations(child, ["id"], "child").collect()}
    assert pk == {("duplicate", "1", 2), ("null key", "", 1)}
    fk = [(r["key"], r["n"]) for r in checks.fk_violations(child, ["parent"], parent, ["id"], "fk").collect()]
    assert fk == [("99", 1)]


def test_table_diff_and_counts(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (2, "Y"), (3, "z"), (3, "z")], "k int, v string")
    got = sorted(tuple(r) for r in checks.table_diff(a, b).collect())
    assert got == [(2, "Y", "extra"), (2, "y", "missing"), (3, "z", "extra")]
    counts = {r["side"]: r["rows"] for r in checks.count_check(a, b).collect()}
    assert counts == {"expected": 3, "actual": 4}


def test_length_violations(spark):
    df = spark.createDataFrame([(1, "x" * 130)], "id long, name string")
    got = checks.length_violations(df, schemas.MAX_LEN["product"], "product", ["id"]).collect()
    assert [(r["column"], r["length"], r["max"]) for r in got] == [("name", 130, 128)]


def test_customer_copy_update_delete_late(spark, tmp_dir):
    t = pos(spark)
    copy = ChangeTable(spark, f"{tmp_dir}/cust", schemas.CUSTOMER, ["id"])
    copy.bootstrap(t.customer)
    image = lambda i, seq, op: t.customer.where(f"id = {i}").select(F.lit(seq).cast("long").alias("seq"), F.lit(op).alias("op"), *t.customer.columns)
    copy.append(image(9, 5, "U").withColumn("firstName", F.lit("Nia")).unionByName(image(10, 6, "D")), "b0")
    for _ in range(2):  # older than the delete: loses, also when replayed
        copy.append(image(10, 2, "U"), "b1")
    now = {r["id"]: r["firstName"] for r in copy.current().collect()}
    assert now[9] == "Nia" and 10 not in now and len(now) == 5
    copy.compact("c1", drop_deletes_before=7)
    assert copy.state().where("op = 'D'").count() == 0
    assert {r["id"] for r in copy.current().collect()} == set(now)
    assert {r["id"] for r in copy.current(only=t.customer.where("id = 9").select("id")).collect()} == {9}


def test_empty_batch_changes_nothing(spark, tmp_dir):
    t = pos(spark)
    m = maintainer(spark, f"{tmp_dir}/state", t)
    m.apply_batch(lines(spark), "q-0")
    assert m.version() == "q-0" and same_as_rebuild(m, t, t.orderline)


def test_failed_pointer_switch_keeps_the_old_pointer(spark, tmp_dir, monkeypatch):
    """Only a store without overwriting renames falls back; other errors are raised."""
    root = f"{tmp_dir}/pub"
    sinks.publish(spark, spark.range(5), root, version="v1")
    jvm = spark.sparkContext._jvm
    missing = jvm.org.apache.hadoop.fs.Path(f"{root}/not-there")
    with pytest.raises(Exception, match="not-there"):
        sinks._replace(spark, missing, jvm.org.apache.hadoop.fs.Path(f"{root}/{sinks.POINTER}"))
    assert sinks.current_version(spark, root) == "v1" and sinks.read_published(spark, root).count() == 5


def test_cluster_session_without_shared_folder_is_refused():
    class Conf:
        def get(self, *_):
            return None

    class Fake:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})()

    with pytest.raises(ValueError):
        ensure_checkpoint_dir(Fake())

"""Change handling: CHG1-CHG4, CHG6, Q8, Q9, UDF1, CHK4."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from possum import schemas
from possum.operators import sequence
from possum.operators.sequence import measured_width, previous_value
from possum.plans import changes, views
from possum.operators.checks import table_diff
from pos_fixture import pos

TS = dt.datetime(2024, 1, 1)


def test_price_history_rules(spark):
    product = spark.createDataFrame([(1, "a", Decimal("5.00"), 1), (2, "b", Decimal("5.00"), 1),
                                     (3, "c", None, 1)], schemas.PRODUCT)
    log = spark.createDataFrame([
        (1, "U", 1, "a", Decimal("5.00"), 1, TS),   # unchanged: no row
        (2, "U", 2, "b", Decimal("15.00"), 1, TS),  # changed: one row
        (3, "U", 2, "b", None, 1, TS),              # to null: no row
        (4, "U", 3, "c", Decimal("1.00"), 1, TS),   # from null: no row
        (5, "U", 2, "b", Decimal("7.00"), 1, TS),   # from null again: no row
        (6, "U", 2, "b", Decimal("8.00"), 1, TS),   # changed: one row
    ], schemas.PRODUCT_CHANGE)
    rows = sorted((r["product_id"], r["seq"], r["oldPrice"], r["newPrice"])
                  for r in changes.price_history_changes(product, log).collect())
    assert rows == [(2, 2, Decimal("5.00"), Decimal("15.00")), (2, 6, Decimal("7.00"), Decimal("8.00"))]


def test_measured_width_spreads_a_hot_key(spark):
    log = spark.range(20_000).selectExpr("0L as k", "id * 1000003 - 7 as seq", "id as v")
    width = measured_width(log, "seq", ranges=64)
    assert 64 <= log.selectExpr(f"seq div {width} as b").distinct().count() <= 65
    got = previous_value(log, ["k"], "seq", "v")
    assert got.where("prev = v - 1 and has_prev").count() == 19_999 and got.where("not has_prev and v = 0").count() == 1
    assert measured_width(log.limit(0), "seq") == 1 and previous_value(log.limit(0), ["k"], "seq", "v").count() == 0


def test_previous_value_matches_window_lag(spark):
    rng = random.Random(7)
    data = [(rng.randint(0, 3), i * 3 + rng.randint(0, 2), rng.choice([None, 1, 2, 3])) for i in range(300)]
    df = spark.createDataFrame(data, "k int, seq long, v int")
    w = Window.partitionBy("k").orderBy("seq", "v")
    expect = df.select("k", "seq", "v", F.lag("v").over(w).alias("prev"),
                       (F.row_number().over(w) > 1).alias("has_prev"))
    got = previous_value(df, ["k"], "seq", "v", tie_cols=["v"], bucket_width=17)
    assert table_diff(expect, got).count() == 0


def test_apply_changes_last_wins(spark):
    snap = spark.createDataFrame([(1, 1, 5), (1, 2, 3), (2, 1, 1)], schemas.ORDERLINE)
    log = spark.createDataFrame([
        (1, "I", 1, 1, 6), (2, "D", 1, 1, None), (3, "I", 1, 1, 7),   # re-insert after delete
        (4, "D", 1, 2, None),                                          # delete
        (5, "I", 3, 3, 2),                                             # new key
    ], schemas.ORDERLINE_CHANGE)
    rows = sorted(tuple(r) for r in changes.apply_changes(snap, log, ["order_id", "product_id"]).collect())
    assert rows == [(1, 1, 7), (2, 1, 1), (3, 3, 2)]


def test_dml_by_predicate(spark):
    t = pos(spark)
    upd = changes.updates_where(t.product, F.col("id") == 3,
                                {"currentPrice": (F.col("currentPrice") + F.lit(10)).cast("decimal(6,2)")},
                                F.lit(1))
    row = upd.first()
    assert row["op"] == "U" and row["currentPrice"] == Decimal("22.50")
    hist = changes.price_history_changes(t.product, upd.withColumn("ts", F.lit(TS)))
    assert hist.count() == 1
    qty = changes.updates_where(t.product, F.col("id") == 3, {"availableQuantity": F.lit(0)}, F.lit(2))
    assert changes.price_history_changes(t.product, qty.withColumn("ts", F.lit(TS))).count() == 0


def test_insert_then_delete_returns_view(spark):
    t = pos(spark)
    mv = views.product_buyers(t.product, t.customer, t.order, t.orderline)
    ins = spark.createDataFrame([(1, "I", 103, 1, 1)], schemas.ORDERLINE_CHANGE)
    ol1 = changes.apply_changes(t.orderline, ins, ["order_id", "product_id"])
    mv1 = views.refresh_product_buyers(mv, ins.select("product_id"), t.product, t.customer, t.order, ol1)
    assert mv1.where("productID = 1").first()["customers"] == "9 Nina Nine,10 Ten Tenor,13 Tie Two"
    dele = spark.createDataFrame([(2, "D", 103, 1, None)], schemas.ORDERLINE_CHANGE)
    ol2 = changes.apply_changes(ol1, dele, ["order_id", "product_id"])
    mv2 = views.refresh_product_buyers(mv1, dele.select("product_id"), t.product, t.customer, t.order, ol2)
    assert table_diff(mv, mv2).count() == 0


def test_refresh_equals_full_recompute_random_logs(spark):
    t = pos(spark)
    rng = random.Random(11)
    mv, ol = views.product_buyers(t.product, t.customer, t.order, t.orderline), t.orderline
    seq = 0
    for _ in range(3):
        rows = []
        for _ in range(6):
            seq += 1
            op = rng.choice(["I", "I", "D"])
            rows.append((seq, op, rng.choice([100, 101, 102, 103]), rng.choice([1, 2, 3, 4]),
                         rng.randint(1, 3) if op == "I" else None))
        log = spark.createDataFrame(rows, schemas.ORDERLINE_CHANGE)
        ol = changes.apply_changes(ol, log, ["order_id", "product_id"])
        mv = views.refresh_product_buyers(mv, changes.touched_products(orderline_changes=log),
                                          t.product, t.customer, t.order, ol)
        full = views.product_buyers(t.product, t.customer, t.order, ol)
        assert table_diff(full, mv).count() == 0


def test_touched_products_from_order_and_customer_changes(spark):
    t = pos(spark)
    moved = spark.createDataFrame([(103,)], "id long")        # order 103 changed
    renamed = spark.createDataFrame([(9,)], "id long")        # customer 9 renamed
    got = changes.touched_products(orderline=t.orderline, order_changes=moved, customer_changes=renamed,
                                   order=t.order)
    assert sorted(r["product_id"] for r in got.collect()) == [1, 2, 3]


def test_customer_rename_refresh_equals_rebuild(spark):
    t = pos(spark)
    mv = views.product_buyers(t.product, t.customer, t.order, t.orderline)
    renamed = t.customer.withColumn("lastName", F.when(F.col("id") == 9, F.lit("Nueve")).otherwise(F.col("lastName")))
    changed = renamed.where("id = 9").select("id")
    touched = changes.touched_products(orderline=t.orderline, customer_changes=changed, order=t.order)
    refreshed = views.refresh_product_buyers(mv, touched, t.product, renamed, t.order, t.orderline)
    rebuilt = views.product_buyers(t.product, renamed, t.order, t.orderline)
    assert table_diff(rebuilt, refreshed).count() == 0
    assert rebuilt.where("productID = 1").first()["customers"] == "9 Nina Nueve,10 Ten Tenor"


@pytest.mark.parametrize("hot_rows", [1, 40, 1 << 17])
def test_previous_value_splits_frequent_keys_only(spark, monkeypatch, hot_rows):
    """Whichever keys are split, the result is the plain lag; rows of other keys move once."""
    monkeypatch.setattr(sequence, "HOT_ROWS", hot_rows)
    rows = [(None if k == 3 else k, s, s * 7 % 11 or None) for k, n in ((1, 300), (2, 30), (3, 60), (4, 1)) for s in range(n)]
    df = spark.createDataFrame(rows, "k long, seq long, v long")
    got = previous_value(df, ["k"], "seq", "v", bucket_width=17)
    want = {(k, s): (v[s - 1] if s else None, s > 0) for k in (1, 2, None, 4) for v in [[x[2] for x in rows if x[0] == k]] for s in range(len(v))}
    assert {(r["k"], r["seq"]): (r["prev"], r["has_prev"]) for r in got.collect()} == want
    moved = got._jdf.queryExecution().optimizedPlan().toString()
    assert ("Join" in moved) == (hot_rows < 300)

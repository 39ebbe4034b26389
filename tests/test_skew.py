"""Hot keys: a third of the rows on one product / one customer (derived from
the sf0.001 tables). One row per key whatever its size; no element is lost."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from possum.plans import documents as D
from possum.plans import reports, views
from possum.sources import testdata as td

SPREAD = 1_000_003  # ids far apart give the same answer as dense ones


@pytest.mark.parametrize("factor", [1, SPREAD])
def test_hot_product_has_one_row_with_all_buyers(spark, factor):
    t = td.pos_tables(spark, SF_SMALL)
    hot_lines = t.orderline.withColumn(
        "product_id", F.when(F.col("order_id") % 3 == 0, F.lit(0)).otherwise(F.col("product_id"))
    ).groupBy("order_id", "product_id").agg(F.sum("quantity").cast("int").alias("quantity"))
    customer = t.customer.withColumn("id", F.col("id") * factor)
    order = t.order.withColumn("customer_id", F.col("customer_id") * factor)
    mv = views.product_buyers(t.product, customer, order, hot_lines)
    assert mv.count() == t.product.count() == mv.select("productID").distinct().count()
    names = mv.where("productID = 0").first()["customers"].split(",")
    expect = (hot_lines.where("product_id = 0").join(order.withColumnRenamed("id", "order_id"), "order_id")
              .select("customer_id").distinct())
    assert [int(n.split(" ")[0]) for n in names] == sorted(r[0] for r in expect.collect())


def test_hot_customer_has_one_document_with_all_orders(spark):
    t = td.pos_tables(spark, SF_SMALL)
    hot_orders = t.order.withColumn(
        "customer_id", F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("customer_id")))
    docs = D.cust_documents(t.customer, t.city, hot_orders, t.orderline, t.product)
    hot = docs.where("CustomerID = 0").collect()
    assert len(hot) == 1
    expect = sorted(r["order_id"] for r in hot_orders.where("customer_id = 0").select(F.col("id").alias("order_id"))
                    .join(t.orderline.select("order_id").distinct(), "order_id").collect())
    assert [o["OrderID"] for o in hot[0]["Orders"]] == expect
    # q2 and q4 from the flat totals agree with the documents
    totals = D.order_totals(hot_orders, t.orderline, t.product)
    flat = {tuple(r) for r in reports.vip_customers_flat(t.customer, t.city, totals).collect()}
    assert flat == {tuple(r) for r in reports.vip_customers(docs).collect()} and {r[0] for r in flat} == {0}
    odd = {r["CustomerID"] for r in reports.order_anomalies(docs, D.DOC_FIELDS["cust"], 200_000, 50).collect()}
    assert odd == {r["id"] for r in reports.anomalous_customers(totals, 200_000, 50).collect()}


def test_hot_order_counts_once(spark):
    """An order of very many items is one element with one total."""
    t = td.pos_tables(spark, SF_SMALL)
    lines = t.orderline.withColumn("order_id", F.when(F.col("product_id") % 3 == 0, F.lit(1)).otherwise(F.col("order_id")))
    lines = lines.groupBy("order_id", "product_id").agg(F.sum("quantity").cast("int").alias("quantity"))
    docs = D.cust_documents(t.customer, t.city, t.order, lines, t.product)
    owner = t.order.where("id = 1").first()["customer_id"]
    one = [o for o in docs.where(F.col("CustomerID") == owner).first()["Orders"] if o["OrderID"] == 1]
    assert len(one) == 1
    assert [i["ProductID"] for i in one[0]["Items"]] == sorted(r[0] for r in lines.where("order_id = 1").select("product_id").collect())
    price = {r["id"]: r["currentPrice"] for r in t.product.collect()}
    want = sum(price[i["ProductID"]] * i["Quantity"] for i in one[0]["Items"] if price[i["ProductID"]] is not None)
    assert one[0]["OrderTotal"] == round(want, 2)

"""QRY1-QRY11 on literal rows: view, documents, reports."""

import json
from decimal import Decimal


from possum.plans import documents as D
from possum.plans import reports, views
from possum.sources.sinks import json_documents
from pos_fixture import pos


def test_product_buyers_view(spark):
    t = pos(spark)
    rows = {r["productID"]: r for r in views.product_buyers(t.product, t.customer, t.order, t.orderline).collect()}
    assert rows[1]["customers"] == "9 Nina Nine,10 Ten Tenor"  # numeric order: 9 before 10
    assert rows[4]["customers"] is None  # never sold: kept, null (AG15, JN2)
    assert rows[3]["customers"] == "13 Tie Two"


def docs(df, kind, keys):
    return {tuple(r[k] for k in keys): json.loads(r["doc"]) for r in json_documents(df, D.DOC_FIELDS[kind], keys).collect()}


def test_prod_documents(spark):
    t = pos(spark)
    d = docs(D.prod_documents(t.product, t.customer, t.order, t.orderline), "prod", ["ProductID"])
    assert (4,) not in d  # never sold: absent (Q2)
    assert d[(1,)] == {"ProductID": 1, "ProductName": "Widget", "ProductBuyers": [
        {"CustomerID": 9, "CustomerName": "Nina Nine"}, {"CustomerID": 10, "CustomerName": "Ten Tenor"}]}


def test_cust_documents(spark):
    t = pos(spark)
    d = docs(D.cust_documents(t.customer, t.city, t.order, t.orderline, t.product), "cust", ["CustomerID"])
    assert (14,) not in d  # no City row: no document (JN9)
    assert d[(11,)]["Orders"] == []  # no orders: empty array (Q4)
    nine = d[(9,)]
    assert nine["PrintedAddress1"] == "9 Elm"
    assert nine["PrintedAddress2"] == "Springfield, TX   55501"
    assert [o["OrderID"] for o in nine["Orders"]] == [100]  # order 104 has no lines
    assert nine["Orders"][0]["OrderTotal"] == 22.5 and nine["Orders"][0]["ShippingDate"] is None
    assert nine["Orders"][0]["Items"] == [{"ProductID": 1, "Quantity": 2, "ProductName": "Widget"},
                                          {"ProductID": 2, "Quantity": 1, "ProductName": "Gadget"}]
    assert d[(10,)]["PrintedAddress1"] == "10 Oak #B"


def test_zip_and_state_month_documents(spark):
    t = pos(spark)
    facts = D.zip_product_facts(t.customer, t.order, t.orderline, t.product)
    z = docs(D.zip_documents(facts, t.city), "custom1", ["ZIP"])
    assert z[("55501",)]["PopularProducts"] == [
        {"TotalPurchases": 3, "TotalSales": 30.0, "ProductID": 1, "ProductName": "Widget"},
        {"TotalPurchases": 1, "TotalSales": 2.5, "ProductID": 2, "ProductName": "Gadget"}]
    mfacts = D.zip_month_product_facts(t.customer, t.order, t.orderline, t.product)
    sm = docs(D.state_month_documents(mfacts, t.city), "custom2", ["State", "OrderMonth"])
    assert set(sm) == {("TX", 5), ("TX", 6), ("NY", 5)}
    assert [p["ProductID"] for p in sm[("TX", 5)]["PopularProducts"]] == [1, 2]


def test_reports(spark):
    t = pos(spark)
    cust = D.cust_documents(t.customer, t.city, t.order, t.orderline, t.product)
    in_tx = {r["CustomerID"] for r in reports.customers_in_state(cust, "TX", D.DOC_FIELDS["cust"]).collect()}
    assert in_tx == {9, 10, 11, 12}
    vip = {(r["CustomerID"], r["totalOrderCost"]) for r in reports.vip_customers(cust).collect()}
    assert vip == {(12, Decimal("125.00")), (13, Decimal("125.00"))}  # tie: both
    prod = D.prod_documents(t.product, t.customer, t.order, t.orderline)
    recall = reports.product_recall(prod, 2).first()
    assert json.loads(recall["ProductBuyers"]) == [{"CustomerID": 9, "CustomerName": "Nina Nine"},
                                                   {"CustomerID": 12, "CustomerName": "Tie One"}]
    odd = {r["CustomerID"] for r in reports.order_anomalies(cust, D.DOC_FIELDS["cust"], 100, 20).collect()}
    assert odd == {12, 13}  # 12: 50 units of one item; 13: order total 125 > 100
    facts = D.zip_product_facts(t.customer, t.order, t.orderline, t.product)
    top = [tuple(r) for r in reports.state_top_products(facts, t.city, "TX", 1).collect()]
    assert top == [(2, "Gadget", 51)]
    mfacts = D.zip_month_product_facts(t.customer, t.order, t.orderline, t.product)
    may = [tuple(r) for r in reports.state_month_products(mfacts, t.city, "TX", 5).collect()]
    assert may == [(1, "Widget", 3, 1), (2, "Gadget", 1, 2)]  # ranked, in that order


def test_state_filter_reaches_city_scan(spark, tmp_dir):
    t = pos(spark)
    t.city.write.parquet(f"{tmp_dir}/city")
    city = spark.read.parquet(f"{tmp_dir}/city")
    facts = D.zip_product_facts(t.customer, t.order, t.orderline, t.product)
    plan = reports.state_top_products(facts, city, "TX", 5)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(state), EqualTo(state,TX)" in plan
    assert "TakeOrderedAndProject" in plan

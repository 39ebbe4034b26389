"""End-to-end jobs (ETL from CSV, export with publish, reports) and catalog objects."""

import json
import os

from possum.plans import catalog, jobs
from possum.sources import sinks
from pos_fixture import pos

EXTRACTS = {
    "customers": 'id,firstName,lastName,city,state,zip,address1,address2,email,birthdate\n'
                 '9,"Nina","Nine","Springfield","TX","55501","9 Elm","",n@x,3/4/1990\n'
                 '10,"Ten","Tenor","Springfield","TX","55501-1234","10 Oak","B",,1/2/1980\n'
                 '11,"Ola","Lone","Austin","TX","73301","11 Ash",,,x\n'
                 '12,"short"\n',
    "orders": 'id,customer_id,datePlaced,dateShipped\n'
              '100,9,"2020-05-01 10:00:00","Cancelled"\n101,10,"2020-05-02 10:00:00","2020-05-04 09:00:00"\n',
    "products": 'id,name,price,quantity\n1,"Widget","$10.00",5\n2,"Gadget","$2.50",7\n3,"Pricey","$10,000.00",1\n',
    "orderlines": 'order_id,product_id\n100,1\n100,1\n100,2\n101,1\n',
}


def test_etl_export_reports(spark, tmp_dir):
    ex = f"{tmp_dir}/extracts"
    os.makedirs(ex)
    for name, text in EXTRACTS.items():
        with open(f"{ex}/{name}.csv", "w") as f:
            f.write(text)
    rejects = jobs.run_etl(spark, ex, f"{tmp_dir}/tables")
    assert rejects == {"customer": 1, "order": 0, "product": 1, "orderline_units": 0}
    # the corrected extract: nothing of the first run is left, a rejected row names no city
    with open(f"{ex}/customers.csv", "a") as f:
        f.write('x13,"Bad","Id","Waco","TX","76701","a","",,\n14,"Line","Break","Austin","TX","73301","two\nlines","",\\N,\n')
    assert jobs.run_etl(spark, ex, f"{tmp_dir}/tables")["customer"] == 2
    with open(f"{ex}/customers.csv") as f:
        fixed_rows = [x for x in f.read().split("\n") if not x.startswith(("12,", "x13,"))]
    with open(f"{ex}/customers.csv", "w") as f:
        f.write("\n".join(fixed_rows))
    assert jobs.run_etl(spark, ex, f"{tmp_dir}/tables")["customer"] == 0
    assert sinks.read_published(spark, f"{tmp_dir}/tables/_rejects/customer").count() == 0
    t = jobs.read_tables(spark, f"{tmp_dir}/tables")
    broken = t.customer.where("id = 14").first()
    assert broken["address1"] == "two\nlines" and broken["email"] is None
    assert t.customer.columns == ["id", "firstName", "lastName", "email", "address1", "address2", "phone", "birthdate", "zip"]
    assert sinks.read_published(spark, f"{tmp_dir}/tables/mv_ProductBuyers").count() == 2
    assert sinks.read_published(spark, f"{tmp_dir}/tables/_violations").count() == 0
    assert sorted(tuple(r) for r in t.orderline.collect()) == [(100, 1, 2), (100, 2, 1), (101, 1, 1)]
    assert sorted(r["zip"] for r in t.city.collect()) == ["55501", "73301"]
    assert jobs.check_tables(t).count() == 0
    versions = jobs.run_export(spark, f"{tmp_dir}/tables", f"{tmp_dir}/pub", version="r1")
    assert versions == {"prod": "r1", "cust": "r1", "custom1": "r1", "custom2": "r1"}
    cust = [json.loads(x["value"]) for x in spark.read.text(f"{tmp_dir}/pub/cust/v=r1").collect()]
    for name, key in jobs.EXPORT_ORDER.items():  # in order over the part files
        parts = sorted(f for f in os.listdir(f"{tmp_dir}/pub/{name}/v=r1") if f.startswith("part-"))
        ids = [json.loads(line)[key] for f in parts for line in open(f"{tmp_dir}/pub/{name}/v=r1/{f}")]
        assert ids == sorted(ids) and len(ids) > 1
    nine = next(d for d in cust if d["CustomerID"] == 9)
    assert nine["Orders"][0]["OrderTotal"] == 22.5 and nine["Orders"][0]["ShippingDate"] is None
    assert sinks.current_version(spark, f"{tmp_dir}/pub/prod") == "r1"
    jobs.run_reports(spark, f"{tmp_dir}/pub", f"{tmp_dir}/q", "TX", 5, 1, 20, 1)
    q1 = {json.loads(x["value"])["CustomerID"] for x in spark.read.text(f"{tmp_dir}/q/q1").collect()}
    assert q1 == {9, 10, 11, 14}
    q5 = [json.loads(x["value"]) for x in spark.read.text(f"{tmp_dir}/q/q5").collect()]
    assert q5 == [{"ProductID": 1, "ProductName": "Widget", "TotalStatePurchases": 3},
                  {"ProductID": 2, "ProductName": "Gadget", "TotalStatePurchases": 1}]
    q6 = {json.loads(x["value"])["ProductID"] for x in spark.read.text(f"{tmp_dir}/q/q6").collect()}
    assert q6 == {1, 2}
    # SQL over the published collections
    jobs.register_views(spark, f"{tmp_dir}/tables", f"{tmp_dir}/pub")
    big = spark.sql("SELECT CustomerID FROM cust WHERE exists(Orders, o -> exists(o.Items, i -> i.Quantity > 1))")
    assert [r[0] for r in big.collect()] == [9]
    assert spark.sql("SELECT count(*) FROM `Order` JOIN Orderline ON Orderline.order_id = `Order`.id").first()[0] == 3
    # the change stream: product 2 gets a buyer, then the run is repeated (no-op)
    from possum import schemas
    log = spark.createDataFrame([(1, "I", 101, 2, 1)], schemas.ORDERLINE_CHANGE)
    log.write.parquet(f"{tmp_dir}/log")
    for _ in range(2):
        jobs.run_stream(spark, f"{tmp_dir}/tables", f"{tmp_dir}/state", f"{tmp_dir}/log")
    from possum.streaming.refresh import BuyerViewMaintainer
    t = jobs.read_tables(spark, f"{tmp_dir}/tables")
    m = BuyerViewMaintainer(spark, f"{tmp_dir}/state", lambda: t)
    assert m.view().where("productID = 2").first()["customers"] == "9 Nina Nine,10 Ten Tenor"
    q2 = [json.loads(x["value"]) for x in spark.read.text(f"{tmp_dir}/q/q2").collect()]
    assert [d["CustomerID"] for d in q2] == [9]
    q4 = {json.loads(x["value"])["CustomerID"] for x in spark.read.text(f"{tmp_dir}/q/q4").collect()}
    assert q4 == {9}  # two units of product 1 in one order


def test_catalog_objects(spark, tmp_dir):
    t = pos(spark)
    db = "possum_test_db"
    catalog.rebuild_database(spark, db)
    catalog.save_tables(spark, db, {"Customer": t.customer, "Order": t.order, "Orderline": t.orderline,
                                    "Product": t.product})
    view = catalog.create_product_buyers_view(spark, db)
    rows = {r["productID"]: r["customers"] for r in view.collect()}
    assert rows[1] == "9 Nina Nine,10 Ten Tenor" and rows[4] is None
    # the SQL text and the DataFrame version agree
    from possum.operators.checks import table_diff
    from possum.plans import views
    assert table_diff(views.product_buyers(t.product, t.customer, t.order, t.orderline), view).count() == 0
    catalog.cache_view(spark, db, buckets=4)
    catalog.cache_view(spark, db, buckets=4)  # IF NOT EXISTS: second call keeps the table
    assert spark.table(f"{db}.mv_ProductBuyers").count() == 4
    assert "CREATE TABLE" in catalog.show_create(spark, f"{db}.mv_ProductBuyers")
    names = {r["tableName"].lower() for r in catalog.show_tables(spark, db).where("NOT isTemporary").collect()}
    assert {"customer", "mv_productbuyers", "v_productbuyers"} <= names
    assert catalog.sample(view, 5).count() == 4
    assert catalog.current_user(spark)
    catalog.rebuild_database(spark, db)
    assert catalog.show_tables(spark, db).where("NOT isTemporary").count() == 0


def test_materialized_view_lookup_skips_by_range(spark, tmp_dir):
    import contextlib
    import io

    from possum.plans import views
    t = pos(spark)
    for name, df in {"customer": t.customer, "city": t.city, "order": t.order, "orderline": t.orderline,
                     "product": t.product}.items():
        df.write.parquet(f"{tmp_dir}/tables/{name}")
    jobs.materialize_view(spark, f"{tmp_dir}/tables", f"{tmp_dir}/mv")
    lookup = spark.read.parquet(f"{tmp_dir}/mv").where("productID = 1")
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        lookup.explain("formatted")
    assert "EqualTo(productID,1)" in buf.getvalue()
    assert lookup.first()["customers"] == "9 Nina Nine,10 Ten Tenor"
    # the procedure form: refresh one product after a new order line
    lines = t.orderline.unionByName(spark.createDataFrame([(103, 1, 1)], t.orderline.schema))
    mv = spark.read.parquet(f"{tmp_dir}/mv")
    fresh = views.refresh_one_product(mv, 1, t.product, t.customer, t.order, lines)
    assert fresh.where("productID = 1").first()["customers"] == "9 Nina Nine,10 Ten Tenor,13 Tie Two"
    assert fresh.count() == 4

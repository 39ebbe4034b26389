"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame.

Every query reads the driver's tables through ``possum.sources.testdata`` and
runs over the whole tables. The SQL twin of each entry is in ``possum.oracle``.
Flat outputs render DATE/TIMESTAMP columns as ISO text (the form the documents
carry them in) and DECIMAL columns as DOUBLE, so both engines hand the checker
the same Python types; the library functions themselves keep exact decimals.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from possum import schemas
from possum.operators import checks, digests
from possum.plans import changes
from possum.plans import documents as D
from possum.plans import differences, etl, reports, views
from possum.session import ensure_checkpoint_dir
from possum.sources import csv as csv_source
from possum.sources import testdata as td
from possum.sources.sinks import json_documents

Query = Callable[[SparkSession, str], DataFrame]

# Report parameters. The reference's reports use the state TX; the test data's
# states are regions, so AMERICA plays that part. The q4 thresholds are set for
# these tables: an order total above 400,000 and an item above 50 units (only
# repeated (order, product) pairs reach that; one raw line holds at most 50).
STATE = "AMERICA"
MONTH = 5
PRODUCT_ID = 1
TOTAL_OVER = 400000
QUANTITY_OVER = 50
TOP_K = 20
AS_OF = dt.datetime(2024, 1, 1, 0, 0, 0)


def _iso(df: DataFrame) -> DataFrame:
    """Flat output for the cross-engine check: decimals as double, dates and timestamps as ISO text."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.DecimalType):
            cols.append(F.col(f.name).cast("double").alias(f.name))
        elif isinstance(f.dataType, T.DateType):
            cols.append(F.date_format(F.col(f.name), "yyyy-MM-dd").alias(f.name))
        elif isinstance(f.dataType, T.TimestampType | T.TimestampNTZType):
            cols.append(F.date_format(F.col(f.name), "yyyy-MM-dd HH:mm:ss").alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


# --- views (QRY1) -----------------------------------------------------------------

def _sold_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(order_id, product_id) of every raw order line. Buyer lists only need the
    set of pairs, so the raw lines serve without summing them into order lines
    first (one shuffle less)."""
    return td.line_units(spark, sf_dir).select("order_id", "product_id")


def _line_quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(order_id, product_id, quantity) per raw order line. Sales facts sum the
    quantity per (zip, product); summing raw lines gives the same sums as
    summing the per-(order, product) order lines, without that shuffle."""
    return td.line_units(spark, sf_dir).select("order_id", "product_id", F.col("units").alias("quantity"))


def product_buyers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QRY1: every product with its comma-joined buyers (JN1, JN2, AG7, AG15)."""
    t = td.pos_tables(spark, sf_dir)
    return views.product_buyers(t.product, t.customer, t.order, _sold_pairs(spark, sf_dir))


def product_buyers_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DDL3: the view as SQL text over the POS tables (global temp views)."""
    from possum.operators.collect import PARTS
    from possum.plans.catalog import PRODUCT_BUYERS_VIEW_SQL

    t = td.pos_tables(spark, sf_dir)
    for name, df in {"Customer": t.customer, "Order": t.order, "Orderline": t.orderline,
                     "Product": t.product}.items():
        df.createOrReplaceGlobalTempView(name)
    return spark.sql(PRODUCT_BUYERS_VIEW_SQL.format(db="global_temp", parts=PARTS))


# --- cleaning (SRC, F1-F8, AG1, AG3, CHG6) ------------------------------------------

def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG1: raw lines counted into (order, product) rows with their quantity."""
    return etl.order_lines_from_units(td.line_units(spark, sf_dir))


def clean_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC1, F1, F2, F4, F6: the customer extract cleaned; rejects left out."""
    good, _ = etl.split_rejects(etl.clean_customers(td.raw_customers(spark, sf_dir)))
    return _iso(good)


def cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG3, Q1: one City row per normalized zip."""
    return etl.cities(td.raw_customers(spark, sf_dir))


def clean_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC2, F3, F5: the order extract cleaned."""
    good, _ = etl.split_rejects(etl.clean_orders(td.raw_orders(spark, sf_dir)))
    return _iso(good)


def clean_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC3, F7, F8: the product extract cleaned."""
    good, _ = etl.split_rejects(etl.clean_products(td.raw_products(spark, sf_dir)))
    return _iso(good)


def price_history_initial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CHG6: one history row per product at load time."""
    good, _ = etl.split_rejects(etl.clean_products(td.raw_products(spark, sf_dir)))
    return _iso(etl.price_history_initial(good, AS_OF))


def _roundtrip(spark: SparkSession, raw: DataFrame, kind: str) -> DataFrame:
    """Write a raw extract as CSV into the shared checkpoint folder, read it back.
    These fields hold no line breaks, so Spark's reader splits the files itself."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/extracts/{uuid.uuid4().hex}/{kind}"
    csv_source.write_extract(raw, path)
    return csv_source.read_extract(spark, path, kind, line_breaks="none")


def csv_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC1 + SRC5: the customer extract through a CSV file and the cleaning."""
    good, _ = etl.split_rejects(etl.clean_customers(_roundtrip(spark, td.raw_customers(spark, sf_dir), "customers")))
    return _iso(good)


def csv_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC2: the order extract through a CSV file and the cleaning."""
    good, _ = etl.split_rejects(etl.clean_orders(_roundtrip(spark, td.raw_orders(spark, sf_dir), "orders")))
    return _iso(good)


def csv_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC5: every customer as a CSV line, some of them short, long, with a bad
    id, a bad zip or ``\\N`` for the email: reasons and null emails, counted."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/extracts/{uuid.uuid4().hex}/customers"
    raw = td.raw_customers(spark, sf_dir).fillna("")
    fault = F.col("id").cast("long") % 40
    bad_id = F.when(fault == 3, F.concat(F.lit("x"), F.col("id"))).otherwise(F.col("id"))
    bad_zip = F.when(fault == 4, F.lit("unknown")).otherwise(F.col("zip"))
    email = F.when(fault == 5, F.lit("\\N")).otherwise(F.col("email"))
    cells = {"id": bad_id, "zip": bad_zip, "email": email}
    line = F.concat_ws(",", *[cells.get(c, F.col(c)) for c in raw.columns])
    line = F.when(fault == 1, F.concat_ws(",", "id", "firstName")).when(fault == 2, F.concat(line, F.lit(",one more"))).otherwise(line)
    raw.select(line.alias("value")).write.text(path)
    cleaned = etl.clean_customers(csv_source.read_extract(spark, path, "customers", header=False, line_breaks="none"))
    reason = F.coalesce("_reject", F.when(F.col("email").isNull(), F.lit("no email")))
    return cleaned.select(reason.alias("reason")).where("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def csv_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC3: quoted names and ``"$1,234.50"`` prices through a CSV file."""
    good, _ = etl.split_rejects(etl.clean_products(_roundtrip(spark, td.raw_products(spark, sf_dir), "products")))
    return _iso(good)


def csv_order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC4 + AG1: one raw row per unit; each lineitem row is written as one raw
    (order, product) row, so the quantity is the number of raw rows."""
    li = td.read_table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("order_id"), F.col("l_partkey").cast("string").alias("product_id"))
    good, _ = etl.split_rejects(etl.clean_orderline_units(_roundtrip(spark, li, "orderlines")))
    return etl.order_lines_from_units(good.drop("units")).select("order_id", "product_id", "quantity")


def csv_one_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC4 from a single file: one task writes the extract, as a server's export
    would, and many read it."""
    li = td.read_table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("order_id"), F.col("l_partkey").cast("string").alias("product_id"))
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/extracts/{uuid.uuid4().hex}/orderlines"
    csv_source.write_extract(li.coalesce(1), path)
    good, _ = etl.split_rejects(etl.clean_orderline_units(csv_source.read_extract(spark, path, "orderlines")))
    return etl.order_lines_from_units(good.drop("units")).select("order_id", "product_id", "quantity")


def csv_line_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC1, SRC5: one customer file whose quoted addresses hold line breaks,
    separators and escaped quotes, read over its splits."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/extracts/{uuid.uuid4().hex}/customers"
    raw = td.raw_customers(spark, sf_dir).fillna("")
    floor = F.concat(F.lit("\n\nfloor "), (F.col("id").cast("long") % 9).cast("string"), F.lit(', \\"rear\\"\n"'))
    address = F.concat(F.expr("substring(address1, 1, length(address1) - 1)"), floor)
    line = F.concat_ws(",", *[address if c == "address1" else F.col(c) for c in raw.columns])
    raw.select(line.alias("value")).coalesce(1).write.text(path)
    good, bad = etl.split_rejects(etl.clean_customers(csv_source.read_extract(spark, path, "customers", header=False)))
    return good.select("id", "address1", "zip", F.lit("good").alias("kind")).unionByName(bad.select("id", "address1", "zip", F.lit("bad").alias("kind")))


def etl_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK6, SNK7: the whole load: four CSV extracts through ``jobs.run_etl``, and
    every row of the tables, the cached view and the violations that it
    published, as text by table and key."""
    from possum.plans import jobs
    from possum.sources.sinks import read_published

    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/etl/{uuid.uuid4().hex}"
    lines = td.read_table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("order_id"), F.col("l_partkey").cast("string").alias("product_id"))
    raw = {"customers": td.raw_customers(spark, sf_dir), "orders": td.raw_orders(spark, sf_dir),
           "products": td.raw_products(spark, sf_dir), "orderlines": lines}
    for kind, df in raw.items():
        csv_source.write_extract(df, f"{root}/extracts/{kind}.csv")
    jobs.run_etl(spark, f"{root}/extracts", f"{root}/tables", as_of=AS_OF, line_breaks="none")

    def cents(price: str) -> Column:
        return (F.col(price) * 100).cast("long")

    values = {
        "customer": (["id"], ["firstName", "lastName", "email", "address1", "address2", "phone", "birthdate", "zip"]),
        "city": (["zip"], ["city", "state"]),
        "order": (["id"], ["datePlaced", "dateShipped", "customer_id"]),
        "orderline": (["order_id", "product_id"], ["quantity"]),
        "product": (["id"], ["name", cents("currentPrice"), "availableQuantity"]),
        "price_history": (["product_id"], [cents("oldPrice"), cents("newPrice")]),
        "mv_ProductBuyers": (["productID"], ["productName", "customers"]),
        "_violations": (["source", "kind", "key"], ["n"]),
    }
    parts = [read_published(spark, f"{root}/tables/{name}").select(
        F.lit(name).alias("source"), F.concat_ws(":", *keys).alias("key"),
        F.concat_ws("|", *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols]).alias("value"))
        for name, (keys, cols) in values.items()]
    return reduce(DataFrame.unionByName, parts)


# --- documents (QRY2-QRY5) ------------------------------------------------------------

def prod_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QRY2: prod documents as JSON text."""
    t = td.pos_tables(spark, sf_dir)
    docs = D.prod_documents(t.product, t.customer, t.order, _sold_pairs(spark, sf_dir))
    return json_documents(docs, D.DOC_FIELDS["prod"], ["ProductID"])


def cust_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QRY3: cust documents as JSON text."""
    t = td.pos_tables(spark, sf_dir)
    docs = D.cust_documents(t.customer, t.city, t.order, t.orderline, t.product)
    return json_documents(docs, D.DOC_FIELDS["cust"], ["CustomerID"])


def zip_popularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QRY4: custom1 documents as JSON text."""
    t = td.pos_tables(spark, sf_dir)
    facts = D.zip_product_facts(t.customer, t.order, _line_quantities(spark, sf_dir), t.product)
    docs = D.zip_documents(facts, t.city, pieces=True)
    return json_documents(docs, D.DOC_FIELDS["custom1"], ["ZIP"])


def state_month_popularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QRY5: custom2 documents as JSON text."""
    t = td.pos_tables(spark, sf_dir)
    facts = D.zip_month_product_facts(t.customer, t.order, _line_quantities(spark, sf_dir), t.product)
    docs = D.state_month_documents(facts, t.city)
    return json_documents(docs, D.DOC_FIELDS["custom2"], ["OrderMonth", "State"])


# --- the flat facts under the documents: the form for keys too large for one row -------------

def buyer_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN1, AG14: who bought what, one row a pair (flat QRY1 and QRY2)."""
    return views.buyer_pairs(_sold_pairs(spark, sf_dir), td.order(spark, sf_dir))


def order_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG4: every order's total and largest quantity (flat QRY3)."""
    t = td.pos_tables(spark, sf_dir)
    return _iso(D.order_totals(t.order, t.orderline, t.product))


def zip_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG5: purchases and sales by zip and product (flat QRY4)."""
    t = td.pos_tables(spark, sf_dir)
    return _iso(D.zip_product_facts(t.customer, t.order, _line_quantities(spark, sf_dir), t.product))


def zip_month_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG6: purchases and sales by zip, month and product (flat QRY5)."""
    t = td.pos_tables(spark, sf_dir)
    return _iso(D.zip_month_product_facts(t.customer, t.order, _line_quantities(spark, sf_dir), t.product))


def order_totals_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG4 at the price of purchase: each line at its product's price on the order's date.
    A day is in the lookup once, so a few thousand days a product need no ranges."""
    t = td.pos_tables(spark, sf_dir)
    return _iso(D.order_totals_as_of(t.order, _line_quantities(spark, sf_dir), t.product, td.price_log(spark, sf_dir), days=None))


# One week of order lines: most products have no buyer and most customers no
# order then, the outer sides of QRY1 and QRY3 (JN2, JN4, AG15, F13, F19, Q4).
WEEK = ("1998-06-01", "1998-06-08")


def _week(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = td.read_table(spark, sf_dir, "lineitem")
    day = F.col("l_shipdate")
    li = li.where((day >= F.lit(WEEK[0]).cast("timestamp_ntz")) & (day < F.lit(WEEK[1]).cast("timestamp_ntz")))
    units = li.select(F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("product_id"),
                      F.col("l_quantity").cast("int").alias("units"))
    return etl.order_lines_from_units(units).select("order_id", "product_id", "quantity")


def product_buyers_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QRY1 over the lines of one week: unsold products keep a row with null."""
    t = td.pos_tables(spark, sf_dir)
    return views.product_buyers(t.product, t.customer, t.order, _week(spark, sf_dir))


def cust_docs_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QRY3 over the lines of one week: customers without any get ``Orders = []``."""
    t = td.pos_tables(spark, sf_dir)
    docs = D.cust_documents(t.customer, t.city, t.order, _week(spark, sf_dir), t.product)
    return json_documents(docs, D.DOC_FIELDS["cust"], ["CustomerID"])


# --- reports (QRY6-QRY11) ---------------------------------------------------------------

def customers_in_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QRY6 (q1): customer documents of one state."""
    t = td.pos_tables(spark, sf_dir)
    zips = t.city.where(F.col("state") == F.lit(STATE)).select("zip")
    customers = t.customer.join(zips, "zip", "left_semi")
    docs = D.cust_documents(customers, t.city, t.order, t.orderline, t.product, restrict=True)
    return reports.customers_in_state(docs, STATE, D.DOC_FIELDS["cust"])


def vip_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QRY7 (q2): customers with the highest total spend, ties included."""
    t = td.pos_tables(spark, sf_dir)
    totals = D.order_totals(t.order, t.orderline, t.product)
    return _iso(reports.vip_customers_flat(t.customer, t.city, totals))


def product_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QRY8 (q3): the buyers of one product."""
    t = td.pos_tables(spark, sf_dir)
    docs = D.prod_documents(t.product, t.customer, t.order, _sold_pairs(spark, sf_dir))
    return reports.product_recall(docs, PRODUCT_ID)


def order_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QRY9 (q4): customers with a very large order or item."""
    t = td.pos_tables(spark, sf_dir)
    odd = reports.anomalous_customers(D.order_totals(t.order, t.orderline, t.product), TOTAL_OVER, QUANTITY_OVER)
    customers = t.customer.join(odd, "id", "left_semi")
    docs = D.cust_documents(customers, t.city, t.order, t.orderline, t.product, restrict=True)
    return reports.order_anomalies(docs, D.DOC_FIELDS["cust"], TOTAL_OVER, QUANTITY_OVER)


def state_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QRY10 (q5): top products of a state, from the flat facts."""
    t = td.pos_tables(spark, sf_dir)
    facts = D.zip_product_facts(t.customer, t.order, _line_quantities(spark, sf_dir), t.product)
    return reports.state_top_products(facts, t.city, STATE, TOP_K)


def state_top_products_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """q5 as the reference runs it: over custom1 documents, with ``explode``."""
    t = td.pos_tables(spark, sf_dir)
    facts = D.zip_product_facts(t.customer, t.order, _line_quantities(spark, sf_dir), t.product)
    docs = D.zip_documents(facts, t.city)
    return reports.state_top_products_from_docs(docs, STATE, TOP_K)


def state_month_products_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """q6 over custom2 documents, with ``explode``."""
    t = td.pos_tables(spark, sf_dir)
    facts = D.zip_month_product_facts(t.customer, t.order, _line_quantities(spark, sf_dir), t.product)
    docs = D.state_month_documents(facts, t.city)
    return reports.state_month_products_from_docs(docs, STATE, MONTH)


def state_month_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QRY11 (q6): products of a state in one month, from the flat facts."""
    t = td.pos_tables(spark, sf_dir)
    facts = D.zip_month_product_facts(t.customer, t.order, _line_quantities(spark, sf_dir), t.product)
    return reports.state_month_products(facts, t.city, STATE, MONTH)


# --- the reports over published collections (SNK1, SNK5, SNK8, SRC6) -------------------------

def _published(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """One document set built, published as JSON, and read back from the published version."""
    from possum.plans.jobs import build_documents
    from possum.sources.sinks import publish, read_published

    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/published/{uuid.uuid4().hex}/{kind}"
    publish(spark, build_documents(td.pos_tables(spark, sf_dir))[kind], root, fmt="json", fields=D.DOC_FIELDS[kind])
    return read_published(spark, root, "json", schema=schemas.DOCS[kind])


def published_customers_in_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """q1 over the published cust collection."""
    return reports.customers_in_state(_published(spark, sf_dir, "cust"), STATE, D.DOC_FIELDS["cust"])


def published_vip_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """q2 over the published cust collection."""
    return _iso(reports.vip_customers(_published(spark, sf_dir, "cust")))


def published_product_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """q3 over the published prod collection."""
    return reports.product_recall(_published(spark, sf_dir, "prod"), PRODUCT_ID)


def published_order_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """q4 over the published cust collection."""
    return reports.order_anomalies(_published(spark, sf_dir, "cust"), D.DOC_FIELDS["cust"], TOTAL_OVER, QUANTITY_OVER)


def published_state_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """q5 over the published custom1 collection."""
    return reports.state_top_products_from_docs(_published(spark, sf_dir, "custom1"), STATE, TOP_K)


def published_state_month_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """q6 over the published custom2 collection."""
    return reports.state_month_products_from_docs(_published(spark, sf_dir, "custom2"), STATE, MONTH)


def report_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK8: tables to published collections to the six reports' JSON files
    (``jobs.run_export``, ``jobs.run_reports``); every line of the files, as
    text by report and key. The collections' part files are gzipped here: as
    plain lines they are the most of the job's disk."""
    from possum.plans import jobs

    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/reports/{uuid.uuid4().hex}"
    tables = td.pos_tables(spark, sf_dir)
    for name in ("customer", "city", "order", "orderline", "product"):
        getattr(tables, name).write.parquet(f"{root}/tables/{name}")
    jobs.run_export(spark, f"{root}/tables", f"{root}/published", compression="gzip")
    jobs.run_reports(spark, f"{root}/published", f"{root}/out", STATE, MONTH, PRODUCT_ID, TOTAL_OVER, QUANTITY_OVER, TOP_K)
    product = "ProductID long, ProductName string"
    fields = {
        "q2": ("CustomerID long, CustomerName string, totalOrderCost decimal(28,2)", "CustomerName", (F.col("totalOrderCost") * 100).cast("long")),
        "q3": (f"{product}, ProductBuyers array<struct<CustomerID:long,CustomerName:string>>", "ProductName", F.to_json("ProductBuyers")),
        "q5": (f"{product}, TotalStatePurchases long", "ProductName", F.col("TotalStatePurchases")),
        "q6": (f"{product}, TotalStatePurchases long, rank long", "ProductName", F.concat_ws("|", F.col("TotalStatePurchases").cast("string"), F.col("rank").cast("string"))),
    }
    parts = []
    for name in ("q1", "q4"):  # whole documents, as they lie in the file
        lines = spark.read.text(f"{root}/out/{name}")
        parts.append(lines.select(F.lit(name).alias("report"), F.get_json_object("value", "$.CustomerID").alias("key"), "value"))
    for name, (schema, label, value) in fields.items():
        rows = spark.read.schema(schema).json(f"{root}/out/{name}")
        parts.append(rows.select(F.lit(name).alias("report"), F.col(rows.columns[0]).cast("string").alias("key"),
                                 F.concat_ws("|", label, value.cast("string")).alias("value")))
    return reduce(DataFrame.unionByName, parts)


# --- changes (CHG1-CHG4, UDF1) -------------------------------------------------------------

ORDERLINE_KEY = ["order_id", "product_id"]
# seq ranges for the previous-price computation: 1/100 of a day of seq, that is
# ranges of order keys within a day, so a product sold all day long is still
# spread over many tasks; each bucket adds at most one summary row.
PRICE_BUCKET = td.SEQ_DAY // 100


def _final_orderline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines after the change log."""
    return changes.apply_changes(td.orderline_base(spark, sf_dir), td.orderline_log(spark, sf_dir),
                                 ORDERLINE_KEY, tie_cols=["quantity"])


def apply_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CHG4: the order-line snapshot after the change log (last change per key wins)."""
    return _final_orderline(spark, sf_dir)


def price_history_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CHG3: a history row for every logged price that differs from the one before."""
    out = changes.price_history_changes(td.product(spark, sf_dir), td.price_log(spark, sf_dir),
                                        bucket_width=PRICE_BUCKET)
    return _iso(out)


def buyers_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cached view after the change log, refreshed for touched products only."""
    t = td.pos_tables(spark, sf_dir)
    base = td.orderline_base(spark, sf_dir)
    log = td.orderline_log(spark, sf_dir)
    mv = views.product_buyers(t.product, t.customer, t.order, base)
    final = changes.apply_changes(base, log, ORDERLINE_KEY, tie_cols=["quantity"])
    touched = changes.touched_products(orderline_changes=log)
    return views.refresh_product_buyers(mv, touched, t.product, t.customer, t.order, final)


def _stream_maintainer(spark: SparkSession, sf_dir: str):
    """Bootstrap the streaming upkeep, write the log as files and drain it."""
    from possum.streaming.refresh import BuyerViewMaintainer, write_log

    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream/{uuid.uuid4().hex}"
    m = BuyerViewMaintainer(spark, root, lambda: td.pos_tables(spark, sf_dir))
    m.bootstrap(td.orderline_base(spark, sf_dir))
    write_log(td.orderline_log(spark, sf_dir), f"{root}/log")
    q = m.start(f"{root}/log")
    q.awaitTermination()
    return m


def stream_product_replica(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CHG5: a copy of the product table kept from the price-change stream."""
    from possum.streaming.change_table import ChangeTable
    from possum.streaming.refresh import write_log

    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/replica/{uuid.uuid4().hex}"
    copy = ChangeTable(spark, f"{root}/product", schemas.PRODUCT, ["id"], tie_cols=["currentPrice"])
    copy.bootstrap(td.product(spark, sf_dir))
    write_log(td.price_log(spark, sf_dir), f"{root}/log")
    copy.start(f"{root}/log").awaitTermination()
    return _iso(copy.current())


def stream_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CHG5/CHG7: the change log as a file stream, applied micro-batch by
    micro-batch; the view read back from its published version."""
    return _stream_maintainer(spark, sf_dir).view()


def _feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order-line log with row images, as a change feed of the source carries them."""
    return differences.with_images(td.orderline_base(spark, sf_dir), td.orderline_log(spark, sf_dir), ORDERLINE_KEY, ["quantity"], ["quantity"], PRICE_BUCKET)


def buyers_by_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CHG1, CHG2: the view kept from counts per (product, customer) while the feed is drained as a stream."""
    from possum.streaming.counts import BuyerCounts
    from possum.streaming.refresh import write_log

    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/counts/{uuid.uuid4().hex}"
    m = BuyerCounts(spark, root, lambda: td.pos_tables(spark, sf_dir))
    m.bootstrap(td.orderline_base(spark, sf_dir))
    write_log(_feed(spark, sf_dir), f"{root}/log")
    m.start(f"{root}/log").awaitTermination()
    return m.view()


def price_history_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CHG3 as a stream: the price log in two parts, the later half first, late changes repaired."""
    from possum.streaming.prices import PriceHistoryStream
    from possum.streaming.refresh import write_log

    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/prices/{uuid.uuid4().hex}"
    m = PriceHistoryStream(spark, root, td.product(spark, sf_dir), PRICE_BUCKET)
    log = td.price_log(spark, sf_dir)
    # every second order's changes come late
    for part in (F.col("seq") % 200 < 100, F.col("seq") % 200 >= 100):
        write_log(log.where(part), f"{root}/in")
        m.start(f"{root}/in").awaitTermination()
    return _iso(m.history())


def _facts_after_log(spark: SparkSession, sf_dir: str, keys: list[str]) -> DataFrame:
    t = td.pos_tables(spark, sf_dir)
    state = differences.fact_state(t.customer, t.order, td.orderline_base(spark, sf_dir), t.product, keys)
    ensure_checkpoint_dir(spark)
    # read by the price differences and by the facts' names: the log is applied once
    after = changes.apply_changes(t.product, td.price_log(spark, sf_dir).drop("ts"), ["id"], tie_cols=["currentPrice"]).checkpoint()
    prices = differences.price_differences(t.product, after)
    lines = differences.line_differences(_feed(spark, sf_dir))
    return _iso(differences.facts_of(differences.facts_after(state, lines, prices, t.order, t.customer, keys), after, keys))


def zip_facts_after_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG5 kept by differences: the facts before the order-line and price logs, plus what the logs change."""
    return _facts_after_log(spark, sf_dir, differences.FACT_KEYS)


def zip_month_facts_after_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG6 kept by differences."""
    return _facts_after_log(spark, sf_dir, differences.MONTH_FACT_KEYS)


# --- the reference's demonstration statements (CHK4) -----------------------------------------

DEMO_PRODUCT = 3
DEMO_ORDER = 1


def price_update_demo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UPDATE Product SET currentPrice = currentPrice + 10.00 WHERE id = 3, then
    UPDATE Product SET availableQuantity = 0 WHERE id = 3; PriceHistory of
    product 3: the load row and one change (the second update keeps the price)."""
    product = td.product(spark, sf_dir)
    raise_price = changes.updates_where(
        product, F.col("id") == F.lit(DEMO_PRODUCT),
        {"currentPrice": (F.col("currentPrice") + F.lit(10)).cast(schemas.PRICE)}, F.lit(1))
    after_first = changes.apply_changes(product, raise_price, ["id"])
    zero_stock = changes.updates_where(after_first, F.col("id") == F.lit(DEMO_PRODUCT),
                                       {"availableQuantity": F.lit(0)}, F.lit(2))
    log = raise_price.unionByName(zero_stock).withColumn("ts", F.lit(AS_OF).cast("timestamp"))
    history = etl.price_history_initial(product, AS_OF).unionByName(
        changes.price_history_changes(product, log))
    return _iso(history.where(F.col("product_id") == F.lit(DEMO_PRODUCT)).drop("ts"))


def view_insert_demo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """INSERT INTO Orderline VALUES (1, 3, 1); SELECT * FROM mv_ProductBuyers
    WHERE productID = 3 (the trigger refreshed product 3)."""
    t = td.pos_tables(spark, sf_dir)
    mv = views.product_buyers(t.product, t.customer, t.order, t.orderline)
    insert = spark.range(1).select(F.lit(1).cast("long").alias("seq"), F.lit("I").alias("op"),
                                   F.lit(DEMO_ORDER).cast("long").alias("order_id"),
                                   F.lit(DEMO_PRODUCT).cast("long").alias("product_id"),
                                   F.lit(1).alias("quantity"))
    lines = changes.apply_changes(t.orderline, insert, ORDERLINE_KEY)
    fresh = views.refresh_one_product(mv, DEMO_PRODUCT, t.product, t.customer, t.order, lines)
    return fresh.where(F.col("productID") == F.lit(DEMO_PRODUCT))


# --- checks (CHK1-CHK3) -----------------------------------------------------------------------

def pk_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CHK1: duplicate and null keys of the POS tables and of the raw line number."""
    t = td.pos_tables(spark, sf_dir)
    li = td.read_table(spark, sf_dir, "lineitem")
    parts = [
        checks.pk_violations(t.customer, schemas.PRIMARY_KEYS["customer"], "customer"),
        checks.pk_violations(t.city, schemas.PRIMARY_KEYS["city"], "city"),
        checks.pk_violations(t.order, schemas.PRIMARY_KEYS["order"], "order"),
        checks.pk_violations(t.orderline, schemas.PRIMARY_KEYS["orderline"], "orderline", rows=li.count()),
        checks.pk_violations(t.product, schemas.PRIMARY_KEYS["product"], "product"),
        # The raw line number is not a key of the extract: its repeats are listed.
        checks.pk_violations(li, ["l_orderkey", "l_linenumber"], "lineitem"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def fk_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CHK2: child keys without a parent row."""
    t = td.pos_tables(spark, sf_dir)
    tables = {"customer": t.customer, "city": t.city, "order": t.order, "orderline": t.orderline,
              "product": t.product}
    parts = [
        checks.fk_violations(tables[child], ccols, tables[parent], pcols, f"{child}.{'_'.join(ccols)}")
        for child, ccols, parent, pcols in schemas.FOREIGN_KEYS if child in tables
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def fk_violations_injected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CHK2 on order lines of which some name a product or an order that isn't there."""
    t = td.pos_tables(spark, sf_dir)
    broken = t.orderline.select(
        F.when(F.col("order_id") % 50 == 1, -F.col("order_id")).otherwise(F.col("order_id")).alias("order_id"),
        F.when(F.col("product_id") % 40 == 1, -F.col("product_id")).otherwise(F.col("product_id")).alias("product_id"))
    return checks.fk_violations(broken, ["order_id"], t.order, ["id"], "orderline.order_id").unionByName(
        checks.fk_violations(broken, ["product_id"], t.product, ["id"], "orderline.product_id"))


def fk_violations_after_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CHK2 under changes: order lines by their log, of which some name a product
    that isn't there; products of which some go and some of the missing come."""
    base, product = td.orderline_base(spark, sf_dir), td.product(spark, sf_dir)
    lost = F.col("product_id") % 37 == 5
    log = td.orderline_log(spark, sf_dir).withColumn("product_id", F.when(lost, -F.col("product_id")).otherwise(F.col("product_id")))
    cols = ["product_id"]
    feed = differences.with_images(base, log, ORDERLINE_KEY, ["quantity"], ["quantity"], PRICE_BUCKET)
    children = differences.line_differences(feed).groupBy(*cols).agg(F.sum("lines").alias("n")).where("n <> 0")
    gone = product.where("id % 40 = 1").select(F.col("id").alias("product_id"), F.lit(-1).cast("long").alias("n"))
    come = product.where("id % 74 = 5").select((-F.col("id")).alias("product_id"), F.lit(1).cast("long").alias("n"))
    counts = differences.key_counts(base, cols)
    parents = differences.key_counts(product.select(F.col("id").alias("product_id")), cols)
    before = differences.missing_parents(counts, parents, cols)
    found = differences.fk_violations_after(before, counts, parents, children, gone.unionByName(come), cols)
    return found.select(F.lit("orderline.product_id").alias("constraint"), F.col("product_id").cast("string").alias("key"), "n")


def length_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q16: text longer than its declared VARCHAR size (reported, not cut)."""
    t = td.pos_tables(spark, sf_dir)
    parts = [
        checks.length_violations(t.customer, schemas.MAX_LEN["customer"], "customer", ["id"]),
        checks.length_violations(t.city, schemas.MAX_LEN["city"], "city", ["zip"]),
        checks.length_violations(t.product, schemas.MAX_LEN["product"], "product", ["id"]),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def copy_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CHK3, first step: row counts of the order lines before and after the log."""
    return checks.count_check(td.orderline_base(spark, sf_dir), _final_orderline(spark, sf_dir))


def table_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines before and after the change log: what the log changed."""
    return checks.table_diff(td.orderline_base(spark, sf_dir), _final_orderline(spark, sf_dir))


def table_diff_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by digests: each copy is stored with its own digest tree, and
    only rows of leaves that differ are compared."""
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/copies/{uuid.uuid4().hex}"
    for name, df in (("expected", td.orderline_base(spark, sf_dir)), ("actual", _final_orderline(spark, sf_dir))):
        df.write.parquet(f"{root}/{name}/rows")
    copies = [spark.read.parquet(f"{root}/{name}/rows") for name in ("expected", "actual")]
    depth = digests.leaf_depth(max(c.count() for c in copies))
    for name, copy in zip(("expected", "actual"), copies):
        digests.digest_tree(copy, depth).write.parquet(f"{root}/{name}/tree")
    trees = tuple(spark.read.parquet(f"{root}/{name}/tree") for name in ("expected", "actual"))
    return digests.table_diff_digests(*copies, depth, trees)


QUERIES: dict[str, Query] = {
    "product_buyers": product_buyers,
    "product_buyers_sql": product_buyers_sql,
    "order_lines": order_lines,
    "clean_customers": clean_customers,
    "clean_orders": clean_orders,
    "clean_products": clean_products,
    "cities": cities,
    "csv_customers": csv_customers,
    "csv_orders": csv_orders,
    "csv_rejects": csv_rejects,
    "csv_products": csv_products,
    "product_buyers_week": product_buyers_week,
    "cust_docs_week": cust_docs_week,
    "csv_order_lines": csv_order_lines,
    "csv_one_file": csv_one_file,
    "csv_line_breaks": csv_line_breaks,
    "etl_tables": etl_tables,
    "price_history_initial": price_history_initial,
    "prod_docs": prod_docs,
    "cust_docs": cust_docs,
    "zip_popularity": zip_popularity,
    "state_month_popularity": state_month_popularity,
    "buyer_pairs": buyer_pairs,
    "order_totals": order_totals,
    "order_totals_as_of": order_totals_as_of,
    "zip_facts": zip_facts,
    "zip_month_facts": zip_month_facts,
    "customers_in_state": customers_in_state,
    "vip_customers": vip_customers,
    "product_recall": product_recall,
    "order_anomalies": order_anomalies,
    "state_top_products": state_top_products,
    "state_month_products": state_month_products,
    "state_top_products_docs": state_top_products_docs,
    "state_month_products_docs": state_month_products_docs,
    "published_customers_in_state": published_customers_in_state,
    "published_vip_customers": published_vip_customers,
    "published_product_recall": published_product_recall,
    "published_order_anomalies": published_order_anomalies,
    "published_state_top_products": published_state_top_products,
    "published_state_month_products": published_state_month_products,
    "report_files": report_files,
    "apply_changes": apply_changes,
    "price_history_changes": price_history_changes,
    "price_history_stream": price_history_stream,
    "buyers_refresh": buyers_refresh,
    "stream_refresh": stream_refresh,
    "buyers_by_counts": buyers_by_counts,
    "zip_facts_after_log": zip_facts_after_log,
    "zip_month_facts_after_log": zip_month_facts_after_log,
    "stream_product_replica": stream_product_replica,
    "pk_violations": pk_violations,
    "fk_violations": fk_violations,
    "fk_violations_injected": fk_violations_injected,
    "fk_violations_after_log": fk_violations_after_log,
    "table_diff": table_diff,
    "table_diff_digests": table_diff_digests,
    "length_violations": length_violations,
    "copy_counts": copy_counts,
    "price_update_demo": price_update_demo,
    "view_insert_demo": view_insert_demo,
}

"""The driver's parquet tables in the POS roles.

part -> Product, customer -> Customer, nation + region -> City (zip, city,
state), orders -> Order, lineitem -> order lines. Every projection below is a
narrow ``select`` over a parquet scan, so Catalyst prunes the read schema and
pushes filters into the scan. The same rules are spelled out in SQL for the
DuckDB oracle in ``possum.oracle``; both sides must change together.

Two raw forms are built:

* typed POS tables (``pos_tables``), the input of views, documents and reports;
* raw text extracts (``raw_extracts``), shaped like the reference's CSV files
  (quoted names, ``"$1,234.50"`` prices, ``m/d/Y`` birthdates, unpadded zips,
  ``Cancelled`` ship dates), the input of the cleaning jobs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from possum import fixed
from possum.schemas import PRICE

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@dataclass(frozen=True)
class PosTables:
    customer: DataFrame
    city: DataFrame
    order: DataFrame
    orderline: DataFrame
    product: DataFrame


# --- derivation rules shared by the typed and the raw form -------------------

def _first_name(c_name: Column) -> Column:
    return F.regexp_extract(c_name, r"^([^#]*)", 1)


def _last_name(c_name: Column) -> Column:
    return F.regexp_extract(c_name, r"#(.*)$", 1)


def _address2(acctbal: Column) -> Column:
    # A customer in debt has no second address line; others get a suite number.
    return F.when(acctbal < 0, F.lit(None).cast("string")).otherwise(
        F.floor(acctbal).cast("bigint").cast("string"))


def _birthdate(custkey: Column) -> Column:
    return F.make_date(
        (F.lit(1940) + custkey % 60).cast("int"),
        (F.lit(1) + custkey % 12).cast("int"),
        (F.lit(1) + custkey % 28).cast("int"),
    )


def _email(custkey: Column) -> Column:
    return F.concat(F.lit("c"), custkey.cast("string"), F.lit("@example.com"))


def _zip(nationkey: Column) -> Column:
    return F.lpad(nationkey.cast("string"), 5, "0")


def _date_shipped(status: Column, priority: Column, placed: Column) -> Column:
    # Open orders are not shipped yet; the others ship 1 to 5 days after the
    # order, by priority ("1-URGENT" ... "5-LOW").
    days = F.substring(priority, 1, 1).try_cast("int")
    return F.when(status == F.lit("O"), F.lit(None).cast("date")).otherwise(F.date_add(placed, days))


# --- typed POS tables --------------------------------------------------------

def product(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("name"),
        F.col("p_retailprice").try_cast(PRICE).alias("currentPrice"),
        F.col("p_size").cast("int").alias("availableQuantity"),
    )


def customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").alias("id"),
        _first_name(F.col("c_name")).alias("firstName"),
        _last_name(F.col("c_name")).alias("lastName"),
        _email(F.col("c_custkey")).alias("email"),
        F.col("c_mktsegment").alias("address1"),
        _address2(F.col("c_acctbal")).alias("address2"),
        F.lit(None).cast("string").alias("phone"),
        _birthdate(F.col("c_custkey")).alias("birthdate"),
        _zip(F.col("c_nationkey")).alias("zip"),
    )


def city(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read_table(spark, sf_dir, "nation")
    r = read_table(spark, sf_dir, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey, "inner").select(
        _zip(F.col("n_nationkey")).alias("zip"),
        F.col("n_name").alias("city"),
        F.col("r_name").alias("state"),
    )


def order(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    placed = F.col("o_orderdate").cast("date")
    return o.select(
        F.col("o_orderkey").alias("id"),
        placed.alias("datePlaced"),
        _date_shipped(F.col("o_orderstatus"), F.col("o_orderpriority"), placed).alias("dateShipped"),
        F.col("o_custkey").alias("customer_id"),
    )


def line_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw order lines: (order_id, product_id, units). A lineitem row stands for
    ``l_quantity`` raw rows of the extract (one raw row per unit sold)."""
    li = read_table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_quantity").cast("int").alias("units"),
    )


def orderline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG1: one row per (order, product); repeated raw rows add up to quantity."""
    from possum.plans.etl import order_lines_from_units

    return order_lines_from_units(line_units(spark, sf_dir)).select("order_id", "product_id", "quantity")


def pos_tables(spark: SparkSession, sf_dir: str) -> PosTables:
    return PosTables(
        customer=customer(spark, sf_dir),
        city=city(spark, sf_dir),
        order=order(spark, sf_dir),
        orderline=orderline(spark, sf_dir),
        product=product(spark, sf_dir),
    )


# --- raw text extracts (the CSV files of the reference, as DataFrames) -------

def _quoted(col: Column) -> Column:
    return F.concat(F.lit('"'), col, F.lit('"'))


def raw_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer")
    n = read_table(spark, sf_dir, "nation")
    r = read_table(spark, sf_dir, "region")
    geo = n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", "n_name", "r_name")
    a2 = _address2(F.col("c_acctbal"))
    return c.join(geo, c.c_nationkey == geo.n_nationkey, "left").select(
        F.col("c_custkey").cast("string").alias("id"),
        _quoted(_first_name(F.col("c_name"))).alias("firstName"),
        _quoted(_last_name(F.col("c_name"))).alias("lastName"),
        _quoted(F.col("n_name")).alias("city"),
        F.col("r_name").alias("state"),
        F.col("c_nationkey").cast("string").alias("zip"),
        _quoted(F.col("c_mktsegment")).alias("address1"),
        F.coalesce(_quoted(a2), F.lit("")).alias("address2"),
        _email(F.col("c_custkey")).alias("email"),
        F.date_format(_birthdate(F.col("c_custkey")), fixed.BIRTHDATE_FORMAT).alias("birthdate"),
    )


def raw_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    placed = F.col("o_orderdate").cast("date")
    shipped = _date_shipped(F.col("o_orderstatus"), F.col("o_orderpriority"), placed)
    fmt = fixed.ORDER_TIME_FORMAT
    return o.select(
        F.col("o_orderkey").cast("string").alias("id"),
        F.col("o_custkey").cast("string").alias("customer_id"),
        _quoted(F.date_format(F.col("o_orderdate"), fmt)).alias("datePlaced"),
        F.coalesce(_quoted(F.date_format(shipped.cast("timestamp_ntz"), fmt)),
                   F.lit(fixed.SHIP_DATE_SENTINEL)).alias("dateShipped"),
    )


def raw_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").cast("string").alias("id"),
        _quoted(F.col("p_name")).alias("name"),
        _quoted(F.concat(F.lit("$"), F.format_number(F.col("p_retailprice"), 2))).alias("price"),
        F.col("p_size").cast("string").alias("quantity"),
    )


def raw_extracts(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {
        "customers": raw_customers(spark, sf_dir),
        "orders": raw_orders(spark, sf_dir),
        "products": raw_products(spark, sf_dir),
    }


# --- change logs cut from lineitem -------------------------------------------
#
# Order lines shipped before CHANGE_CUTOFF form the base snapshot; the later
# lines are the change log in ship order: a returned line ("R") deletes its
# (order, product) row, any other line inserts or replaces it. Sale prices
# (list price less the line's discount) form a product price log.

CHANGE_CUTOFF = "2000-01-01"
SEQ_DAY = 100_000_000_000_000  # seq = day * SEQ_DAY + order key * 100 + line number


def line_seq(shipdate: Column, orderkey: Column, linenumber: Column) -> Column:
    return (F.unix_date(shipdate.cast("date")).cast("long") * F.lit(SEQ_DAY)
            + orderkey * F.lit(100) + linenumber.cast("long"))


def _cutoff() -> Column:
    return F.lit(CHANGE_CUTOFF).cast("timestamp_ntz")


def orderline_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    from possum.plans.etl import order_lines_from_units

    li = read_table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") < _cutoff())
    units = li.select(F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("product_id"),
                      F.col("l_quantity").cast("int").alias("units"))
    return order_lines_from_units(units).select("order_id", "product_id", "quantity")


def orderline_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") >= _cutoff())
    return li.select(
        line_seq(F.col("l_shipdate"), F.col("l_orderkey"), F.col("l_linenumber")).alias("seq"),
        F.when(F.col("l_returnflag") == F.lit("R"), F.lit("D")).otherwise(F.lit("I")).alias("op"),
        F.col("l_orderkey").alias("order_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_quantity").cast("int").alias("quantity"),
    )


def price_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product change log (seq, op, id, name, currentPrice, availableQuantity, ts):
    every sale sets the product's price to what the line was sold at."""
    li = read_table(spark, sf_dir, "lineitem")
    p = read_table(spark, sf_dir, "part")
    sold = F.round(F.col("p_retailprice").try_cast(PRICE) * (F.lit(1) - F.col("l_discount").try_cast("decimal(3,2)")), 2)
    return li.join(p, li.l_partkey == p.p_partkey, "inner").select(
        line_seq(F.col("l_shipdate"), F.col("l_orderkey"), F.col("l_linenumber")).alias("seq"),
        F.lit("U").alias("op"),
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("name"),
        sold.try_cast(PRICE).alias("currentPrice"),
        F.col("p_size").cast("int").alias("availableQuantity"),
        F.col("l_shipdate").alias("ts"),
    )

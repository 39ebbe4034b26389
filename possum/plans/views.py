"""``v_ProductBuyers`` and its cached copy (QRY1, DDL3, DDL6, UDF1).

The view lists every product with its buyers as one comma-separated string,
``"<id> <first> <last>"`` in customer id order, null when nobody bought it.

Plan shape: order lines join orders on ``order_id``; the (product, customer)
pairs are made distinct (a partial aggregate, so a best-selling product is
combined map-side); customers join by id; the strings are built per product
in two levels; products join last with a left join so unsold products stay
(JN2). ``buyer_pairs`` is the flat form for products too large for one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from possum import fixed
from possum.functions.cleaning import full_name
from possum.operators.collect import collect_text


def buyer_pairs(orderline: DataFrame, order: DataFrame) -> DataFrame:
    """Distinct (product_id, customer_id) pairs (JN1 then AG14)."""
    ol = orderline.select("order_id", "product_id")
    o = order.select(F.col("id").alias("order_id"), "customer_id")
    return ol.join(o, "order_id", "inner").select("product_id", "customer_id").distinct()


def buyer_strings(pairs: DataFrame, customer: DataFrame) -> DataFrame:
    """(product_id, customers): the ordered, comma-joined buyer list."""
    c = customer.select(
        F.col("id").alias("customer_id"),
        F.concat(F.col("id").cast("string"), F.lit(fixed.NAME_SEP), full_name("firstName", "lastName")).alias("buyer"),
    )
    named = pairs.join(c, "customer_id", "inner")
    return collect_text(named, ["product_id"], "customer_id", F.col("buyer"), "customers", fixed.BUYER_LIST_SEP)


def product_buyers(
    product: DataFrame,
    customer: DataFrame,
    order: DataFrame,
    orderline: DataFrame,
) -> DataFrame:
    """QRY1: productID, productName, customers (null when never sold)."""
    return product_buyers_of(product, customer, buyer_pairs(orderline, order))


def product_buyers_of(product: DataFrame, customer: DataFrame, pairs: DataFrame) -> DataFrame:
    """``product_buyers`` from its distinct (product_id, customer_id) pairs."""
    lists = buyer_strings(pairs, customer)
    product_id, product_name, customers = fixed.VIEW_COLUMNS
    p = product.select(F.col("id").alias("product_id"), F.col("name").alias(product_name))
    return p.join(lists, "product_id", "left").select(
        F.col("product_id").alias(product_id),
        product_name,
        F.col("customers").alias(customers),
    )


def refresh_product_buyers(
    mv: DataFrame,
    touched: DataFrame,
    product: DataFrame,
    customer: DataFrame,
    order: DataFrame,
    orderline: DataFrame,
) -> DataFrame:
    """UDF1, CHG1, CHG2: recompute the cached view only for touched products.

    ``touched`` is a DataFrame of ``product_id`` (never collected). The rows of
    untouched products are kept by a left anti join; touched products are
    recomputed from order lines restricted to them by a left semi join, which
    Catalyst plans before the order and customer joins. Touched products that
    no longer exist are dropped, new ones appear (the reference's procedure
    only updated existing rows, Q8).
    """
    keys = touched.select(F.col("product_id")).distinct()
    kept = mv.join(keys.withColumnRenamed("product_id", "productID"), "productID", "left_anti")
    ol = orderline.join(keys, "product_id", "left_semi")
    p = product.join(keys.withColumnRenamed("product_id", "id"), "id", "left_semi")
    fresh = product_buyers(p, customer, order, ol)
    return kept.unionByName(fresh.select(*mv.columns))


def refresh_one_product(mv: DataFrame, product_id: int, product: DataFrame, customer: DataFrame,
                        order: DataFrame, orderline: DataFrame) -> DataFrame:
    """UDF1 with the procedure's signature: recompute one product's buyers.
    For one id, plain filters replace the semi and anti joins of the set-based
    refresh; they reach the scans of the order lines and the product table."""
    pid = F.lit(product_id).cast("long")
    kept = mv.where(F.col("productID") != pid)
    fresh = product_buyers(product.where(F.col("id") == pid), customer, order,
                           orderline.where(F.col("product_id") == pid))
    return kept.unionByName(fresh.select(*mv.columns))

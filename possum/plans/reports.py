"""The six document queries (QRY6-QRY11) of the reference's ``run_queries``.

q1-q4 read customer and product documents: nested DataFrames as built by
``possum.plans.documents`` (with a typed ``state``) or
read back from a published set (document fields only). q5 and q6 "unwind then
group" the popularity documents (``*_from_docs``); when the flat fact tables
the documents are made from are at hand, the same answer is a group-by over
them, without building and exploding the arrays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from possum import fixed
from possum.functions.cleaning import full_name
from possum.operators.ranks import ranked_by_ranges
from possum.session import ensure_checkpoint_dir
from possum.sources.sinks import json_text


def customers_in_state(cust_docs: DataFrame, state: str, fields: list[str]) -> DataFrame:
    """QRY6 (q1): customer documents of one state.

    The reference matches ``/.* TX   .*/`` on PrintedAddress2 (FLT5). Built
    documents also carry the typed state, so the filter adds an equality that
    Catalyst pushes below the joins into the City scan; published documents
    have only the printed line and are matched by the expression alone.
    """
    cond = F.col("PrintedAddress2").rlike(fixed.REPORT_STATE_PATTERN.format(state=state))
    if "state" in cust_docs.columns:
        cond = (F.col("state") == F.lit(state)) & cond
    return cust_docs.where(cond).select("CustomerID", json_text(fields).alias("doc"))


def order_cost_totals(cust_docs: DataFrame) -> DataFrame:
    """AG12: per customer, the sum of its Orders' OrderTotal (0 without orders),
    inside the document with a higher-order function."""
    total = F.aggregate(
        F.transform("Orders", lambda o: o["OrderTotal"]),
        F.lit(0).cast("decimal(28,2)"),
        lambda acc, x: (acc + F.coalesce(x, F.lit(0))).cast("decimal(28,2)"),
    )
    return cust_docs.select("CustomerID", "CustomerName", total.alias("totalOrderCost"))


def _top(totals: DataFrame) -> DataFrame:
    """Every row whose total equals the maximum (TOP1). The maximum is a one-row
    global aggregate (partial per task) joined back by broadcast (JN6)."""
    top = totals.agg(F.max("totalOrderCost").alias("totalOrderCost"))
    return totals.join(F.broadcast(top), "totalOrderCost", "inner").select(
        "CustomerID", "CustomerName", "totalOrderCost")


def vip_customers(cust_docs: DataFrame) -> DataFrame:
    """QRY7 (q2) over documents: the customers with the highest total spend."""
    return _top(order_cost_totals(cust_docs))


def vip_customers_flat(customer: DataFrame, city: DataFrame, totals: DataFrame) -> DataFrame:
    """q2 from flat order totals (``documents.order_totals``): summed per customer
    before the customers with a City join, so no document is built."""
    c = customer.join(city.select("zip"), "zip", "left_semi").select(
        F.col("id").alias("CustomerID"), full_name("firstName", "lastName").alias("CustomerName"))
    sums = totals.groupBy(F.col("customer_id").alias("CustomerID")).agg(F.sum("OrderTotal").alias("t"))
    return _top(c.join(sums, "CustomerID", "left").select(
        "CustomerID", "CustomerName", F.coalesce("t", F.lit(0)).cast("decimal(28,2)").alias("totalOrderCost")))


def anomalous_customers(totals: DataFrame, total_over: float, quantity_over: int) -> DataFrame:
    """q4's customer ids from flat order totals: (id) with an order above
    ``total_over`` or an item above ``quantity_over`` units."""
    odd = totals.where((F.col("OrderTotal") > F.lit(total_over)) | (F.col("most") > F.lit(quantity_over)))
    return odd.select(F.col("customer_id").alias("id")).distinct()


def product_recall(prod_docs: DataFrame, product_id: int, buyers_as_text: bool = True) -> DataFrame:
    """QRY8 (q3): buyers of one product (FLT6, PRJ3). The id filter is pushed
    through the aggregation into the order-line scan. ``buyers_as_text`` gives
    the buyer array as JSON text (one comparable value), else as an array."""
    buyers = F.to_json("ProductBuyers") if buyers_as_text else F.col("ProductBuyers")
    return prod_docs.where(F.col("ProductID") == F.lit(product_id)).select(
        "ProductID", "ProductName", buyers.alias("ProductBuyers"))


def order_anomalies(cust_docs: DataFrame, fields: list[str], total_over: float, quantity_over: int) -> DataFrame:
    """QRY9 (q4): documents with an order above ``total_over`` or an item with
    a quantity above ``quantity_over`` (FLT7, ``$or`` over dotted paths)."""
    big_order = F.exists("Orders", lambda o: o["OrderTotal"] > F.lit(total_over))
    big_item = F.exists("Orders", lambda o: F.exists(o["Items"], lambda i: i["Quantity"] > F.lit(quantity_over)))
    return cust_docs.where(big_order | big_item).select("CustomerID", json_text(fields).alias("doc"))


def _state_products(facts: DataFrame, city: DataFrame, state: str) -> DataFrame:
    zips = city.where(F.col("state") == F.lit(state)).select("zip")
    return facts.join(zips, "zip", "left_semi").groupBy("ProductID").agg(
        F.min("ProductName").alias("ProductName"),
        F.sum("TotalPurchases").cast("long").alias("TotalStatePurchases"),
    )


def state_top_products(zip_facts: DataFrame, city: DataFrame, state: str, k: int = 20) -> DataFrame:
    """QRY10 (q5): the ``k`` products most bought in a state (FLT4, F21, AG13,
    SRT3, LIM1). Ties are broken by ProductID so the cut is deterministic;
    sort plus limit plans as a per-task top-k (TakeOrderedAndProject)."""
    return _state_products(zip_facts, city, state).orderBy(
        F.col("TotalStatePurchases").desc(), F.col("ProductID").asc()).limit(k)


def ranked(products: DataFrame) -> DataFrame:
    """SRT3 for all rows: ``rank`` 1, 2, ... by purchases, ties by ProductID,
    and the rows in that order.

    Ranks are counted by ranges (``operators.ranks``): no window runs over all
    rows or over all products of one total. The totals are checkpointed, as
    the ranges read them more than once."""
    ensure_checkpoint_dir(products.sparkSession)
    placed = ranked_by_ranges(products, "TotalStatePurchases", "ProductID", "rank", counted=products.checkpoint())
    return placed.select("ProductID", "ProductName", "TotalStatePurchases", "rank").orderBy(
        F.col("TotalStatePurchases").desc(), F.col("ProductID").asc())


def state_month_products(zip_month_facts: DataFrame, city: DataFrame, state: str, month: int) -> DataFrame:
    """QRY11 (q6): products of a state in one order month, ranked, all of them.
    The product name is the real name (the reference's q6 printed a constant, Q10)."""
    facts = zip_month_facts.where(F.col("OrderMonth") == F.lit(month))
    return ranked(_state_products(facts, city, state))


def _unwind_state(docs: DataFrame, state: str) -> DataFrame:
    """FLT4 before F21: match the state, then one row per PopularProducts element."""
    return docs.where(F.col("State") == F.lit(state)).select(F.explode("PopularProducts").alias("p")).select(
        "p.ProductID", "p.ProductName", "p.TotalPurchases")


def _group_products(unwound: DataFrame) -> DataFrame:
    return unwound.groupBy("ProductID").agg(
        F.min("ProductName").alias("ProductName"),
        F.sum("TotalPurchases").cast("long").alias("TotalStatePurchases"),
    )


def state_top_products_from_docs(zip_docs: DataFrame, state: str, k: int = 20) -> DataFrame:
    """QRY10 (q5) over custom1 documents: match, unwind, group, sort, limit."""
    return _group_products(_unwind_state(zip_docs, state)).orderBy(
        F.col("TotalStatePurchases").desc(), F.col("ProductID").asc()).limit(k)


def state_month_products_from_docs(state_month_docs: DataFrame, state: str, month: int) -> DataFrame:
    """QRY11 (q6) over custom2 documents: match state and month, unwind, group."""
    docs = state_month_docs.where(F.col("OrderMonth") == F.lit(month))
    return ranked(_group_products(_unwind_state(docs, state)))

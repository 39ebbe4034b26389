"""The four nested document sets (QRY2-QRY5) and their flat fact tables.

Documents are DataFrames with typed ``struct``/``array`` columns; JSON text is
made only at the sink (``possum.sources.sinks``). Each builder aggregates the
facts first and joins dimensions after (JN5), and collects one document per
key with ``possum.operators.collect``.

Shapes (field order as in the reference):

* prod:    ProductID, ProductName, ProductBuyers[{CustomerID, CustomerName}]
* cust:    CustomerID, CustomerName, PrintedAddress1, PrintedAddress2,
           Orders[{OrderID, OrderTotal, OrderDate, ShippingDate,
                   Items[{ProductID, Quantity, ProductName}]}]
* custom1: ZIP, State, City, PopularProducts[{TotalPurchases, TotalSales, ProductID, ProductName}]
* custom2: OrderMonth, State, PopularProducts[same struct, one per (zip, product)]

Every builder also returns its document key columns outside the document
fields; ``DOC_FIELDS`` lists the fields that make up the JSON text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from possum import fixed
from possum.functions.cleaning import full_name, printed_address1, printed_address2, round_money
from possum.operators.asof import as_of
from possum.operators.collect import PIECE, collect_arrays, collect_in_order, collect_pieces, collect_sorted
from possum.plans.views import buyer_pairs

DOC_FIELDS = {
    "prod": fixed.PROD_FIELDS,
    "cust": fixed.CUST_FIELDS,
    "custom1": fixed.ZIP_FIELDS,
    "custom2": fixed.STATE_MONTH_FIELDS,
}

def _named_struct(names: list[str], values: list[Column]) -> Column:
    """A struct whose fields carry the fixed names, in the fixed order."""
    return F.struct(*[v.alias(n) for n, v in zip(names, values, strict=True)])


# --- prod ---------------------------------------------------------------------

def prod_documents(product: DataFrame, customer: DataFrame, order: DataFrame, orderline: DataFrame,
                   in_order: bool = False) -> DataFrame:
    """QRY2: products with at least one buyer (the left join acts as inner, JN3/Q2).
    With ``in_order`` tasks have ranges of ProductID, as an ordered export writes them."""
    pairs = buyer_pairs(orderline, order)
    buyers = pairs.join(
        customer.select(F.col("id").alias("customer_id"),
                        full_name("firstName", "lastName").alias("CustomerName")),
        "customer_id", "inner")
    element = _named_struct(fixed.BUYER_FIELDS, [F.col("customer_id"), F.col("CustomerName")])
    p = product.select(F.col("id").alias("product_id"), F.col("name").alias("ProductName"))
    if in_order:  # an element's CustomerID, its first field, orders it
        docs = collect_in_order(p, buyers, "product_id", element, "ProductBuyers").where(F.size("ProductBuyers") > 0)
    else:
        docs = collect_arrays(buyers, ["product_id"], "customer_id", element, "ProductBuyers").join(p, "product_id", "inner")
    return docs.select(F.col("product_id").alias("ProductID"), "ProductName", "ProductBuyers")


# --- cust ---------------------------------------------------------------------

def _priced_lines(orderline: DataFrame, product: DataFrame) -> DataFrame:
    return orderline.select("order_id", "product_id", "quantity").join(
        product.select(F.col("id").alias("product_id"), F.col("name").alias("ProductName"),
                       F.col("currentPrice")),
        "product_id", "inner",
    ).withColumn("amount", F.col("currentPrice") * F.col("quantity"))


def order_totals(order: DataFrame, orderline: DataFrame, product: DataFrame) -> DataFrame:
    """AG4, flat: (order_id, customer_id, OrderTotal, most) per order with lines;
    ``most`` is the largest quantity of one of its items."""
    lines = _priced_lines(orderline, product)
    sums = lines.groupBy("order_id").agg(F.sum("amount").alias("amount"), F.max("quantity").alias("most"))
    o = order.select(F.col("id").alias("order_id"), "customer_id")
    return sums.join(o, "order_id", "inner").select(
        "order_id", "customer_id", round_money(F.col("amount")).alias("OrderTotal"), "most")


PRICE_DAYS = 64  # days of one range of the price lookup


def order_totals_as_of(order: DataFrame, orderline: DataFrame, product: DataFrame, price_log: DataFrame,
                       days: int | None = PRICE_DAYS) -> DataFrame:
    """AG4 at the price of purchase: (order_id, customer_id, OrderTotal).

    A line counts at its product's last logged price on or before the order's
    date, by ``seq`` within a day, ties by price. Before the first logged
    price, and for an order without a date, it is the price of ``product``, the
    table before the log. A logged null is no price. Orders without lines and
    lines without a product are absent, as in ``order_totals``.

    ``price_log``: (seq, id, currentPrice, ts). The lookup sees each
    (product, day) once, in ranges of ``days``; with None a product is one
    window, of no more rows than twice the days there are."""
    day = F.unix_date(F.col("ts").cast("date")).cast("long")
    last = F.max_by("currentPrice", F.struct("seq", "currentPrice")).alias("price")
    daily = price_log.where("currentPrice is not null").groupBy(F.col("id").alias("product_id"), day.alias("day")).agg(last)
    o = order.select(F.col("id").alias("order_id"), "customer_id", F.unix_date("datePlaced").cast("long").alias("day"))
    lines = orderline.select("order_id", "product_id", "quantity").join(o, "order_id")
    prices = as_of(lines, daily, ["product_id"], "day", "price", days)
    base = product.select(F.col("id").alias("product_id"), "currentPrice")
    amount = F.coalesce("price", "currentPrice") * F.col("quantity")
    priced = lines.join(prices, ["product_id", "day"], "left").join(base, "product_id").withColumn("amount", amount)
    return priced.groupBy("order_id").agg(F.min("customer_id").alias("customer_id"), round_money(F.sum("amount")).alias("OrderTotal"))


def order_documents(order: DataFrame, orderline: DataFrame, product: DataFrame) -> DataFrame:
    """One element per order: customer_id, OrderID and the Orders element
    struct. Orders without lines are absent (inner joins)."""
    lines = _priced_lines(orderline, product)
    item = _named_struct(fixed.ITEM_FIELDS, [F.col("product_id"), F.col("quantity"), F.col("ProductName")])
    # moved as rows: a list of the few lines that a task has of an order takes more bytes than they do
    whole = collect_arrays(lines.repartition("order_id"), ["order_id"], "product_id", item, "Items", {"amount": F.col("amount")})
    o = order.select(F.col("id").alias("order_id"), "customer_id", "datePlaced", "dateShipped")
    return whole.join(o, "order_id", "inner").select(
        "customer_id",
        F.col("order_id").alias("OrderID"),
        _named_struct(fixed.ORDER_FIELDS, [
            F.col("order_id"), round_money(F.col("amount")), F.col("datePlaced"), F.col("dateShipped"),
            F.col("Items"),
        ]).alias("element"),
    )


def cust_documents(customer: DataFrame, city: DataFrame, order: DataFrame, orderline: DataFrame,
                   product: DataFrame, restrict: bool = False, in_order: bool = False) -> DataFrame:
    """QRY3: customers having a City (JN9), with their orders (JN4); a customer
    without orders gets ``Orders = []`` (Q4).

    To build the documents of some customers only, pass a filtered ``customer``
    and ``restrict=True``: orders are then cut to those customers by a semi
    join before any order line is touched. Without a filter the semi joins
    would only add shuffles, so they are left out. With ``in_order`` tasks have
    ranges of CustomerID, as an ordered export writes them.
    """
    c = customer.join(city.select("zip", "city", "state"), "zip", "inner").select(
        F.col("id").alias("customer_id"),
        full_name("firstName", "lastName").alias("CustomerName"),
        printed_address1("address1", "address2").alias("PrintedAddress1"),
        printed_address2("city", "state", "zip").alias("PrintedAddress2"),
        F.col("state"),
    )
    o, ol = order, orderline
    if restrict:
        ids = customer.select(F.col("id").alias("customer_id"))
        o = order.join(ids, "customer_id", "left_semi")
        ol = orderline.join(o.select(F.col("id").alias("order_id")), "order_id", "left_semi")
    elements = order_documents(o, ol, product)
    if in_order:  # an element's OrderID, its first field, orders it
        docs = collect_in_order(c, elements, "customer_id", F.col("element"), "Orders")
    else:
        docs = c.join(collect_arrays(elements, ["customer_id"], "OrderID", F.col("element"), "Orders"), "customer_id", "left")
    return docs.select(
        F.col("customer_id").alias("CustomerID"),
        "state",
        "CustomerName", "PrintedAddress1", "PrintedAddress2",
        F.coalesce(F.col("Orders"), F.array().cast(docs.schema["Orders"].dataType)).alias("Orders"),
    )


# --- custom1 / custom2 facts ---------------------------------------------------

def _sales_lines(customer: DataFrame, order: DataFrame, orderline: DataFrame,
                 with_month: bool) -> DataFrame:
    """(zip, [month,] product_id, quantity) per order line (JN1).

    Orders meet their customers first, so the lines move for one join only."""
    o = order.select(F.col("id").alias("order_id"), "customer_id",
                     *([F.month("datePlaced").alias("OrderMonth")] if with_month else []))
    c = customer.select(F.col("id").alias("customer_id"), "zip")
    located = o.join(c, "customer_id", "inner").drop("customer_id")
    return orderline.select("order_id", "product_id", "quantity").join(located, "order_id", "inner")


def zip_product_facts(customer: DataFrame, order: DataFrame, orderline: DataFrame,
                      product: DataFrame) -> DataFrame:
    """AG5: (zip, ProductID, ProductName, TotalPurchases, TotalSales).

    Quantities are summed per (zip, product) before the product join: the price
    is constant per product, so ``sum(q * p) = p * sum(q)`` exactly in decimal
    arithmetic, and the join sees one row per (zip, product), not per line.
    """
    sums = _sales_lines(customer, order, orderline, False).groupBy("zip", "product_id").agg(
        F.sum(F.coalesce(F.col("quantity"), F.lit(0))).alias("TotalPurchases"))
    return _price_facts(sums, product, ["zip"])


def zip_month_product_facts(customer: DataFrame, order: DataFrame, orderline: DataFrame,
                            product: DataFrame) -> DataFrame:
    """AG6: as AG5 per (zip, month of order date, product); months of all years merge (Q7)."""
    sums = _sales_lines(customer, order, orderline, True).groupBy("zip", "OrderMonth", "product_id").agg(
        F.sum("quantity").alias("TotalPurchases"))
    return _price_facts(sums, product, ["zip", "OrderMonth"])


def _price_facts(sums: DataFrame, product: DataFrame, keys: list[str]) -> DataFrame:
    p = product.select(F.col("id").alias("product_id"), F.col("name").alias("ProductName"), "currentPrice")
    return sums.join(p, "product_id", "inner").select(
        *keys,
        F.col("product_id").alias("ProductID"),
        "ProductName",
        F.col("TotalPurchases").cast("long").alias("TotalPurchases"),
        round_money(F.col("TotalPurchases") * F.col("currentPrice")).alias("TotalSales"),
    )


def _popular() -> Column:
    return _named_struct(fixed.POPULAR_FIELDS, [F.col(c) for c in fixed.POPULAR_FIELDS])


def zip_documents(facts: DataFrame, city: DataFrame, pieces: bool = False) -> DataFrame:
    """QRY4 (custom1): one document per zip with sales (JN5 inner join to City).

    With ``pieces`` a document is several rows, each with a piece of its
    products (``collect_pieces``): the form whose JSON text the sink puts
    together without holding a zip's products in one row."""
    if pieces:
        arrays = collect_pieces(facts, ["zip"], "ProductID", _popular(), "PopularProducts")
        # broadcast: else the join moves the pieces by zip; numbered: each City row has a document
        cities = F.broadcast(city.select("zip", "city", "state", F.monotonically_increasing_id().alias("_city")))
        return arrays.join(cities, "zip", "inner").select(
            F.col("zip").alias("ZIP"), F.col("state").alias("State"), F.col("city").alias("City"), "PopularProducts", PIECE, "_city")
    arrays = collect_sorted(facts, ["zip"], ["ProductID"], _popular(), "PopularProducts")
    return arrays.join(city.select("zip", "city", "state"), "zip", "inner").select(
        F.col("zip").alias("ZIP"), F.col("state").alias("State"), F.col("city").alias("City"), "PopularProducts")


def state_month_documents(facts: DataFrame, city: DataFrame) -> DataFrame:
    """QRY5 (custom2): one document per (state, order month); one element per
    (zip, product), so a product may repeat within a state (Q7). Elements are
    ordered by (ProductID, zip)."""
    keyed = facts.join(city.select("zip", "state"), "zip", "inner")
    arrays = collect_sorted(keyed, ["state", "OrderMonth"], ["ProductID", "zip"], _popular(), "PopularProducts")
    return arrays.select(F.col("OrderMonth"), F.col("state").alias("State"), "PopularProducts")

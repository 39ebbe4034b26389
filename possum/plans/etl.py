"""Raw extracts to typed POS tables (the reference's staging + INSERT ... SELECT).

Each ``clean_*`` function takes a raw text DataFrame (as read by
``possum.sources.csv.read_extract`` or built from other tables) and returns the
typed table plus a ``_reject`` column: null for a good row, else the reason.
``split_rejects`` separates the two. All work is column expressions and, for
cities and order lines, one aggregation with map-side partial aggregation.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from possum.functions import cleaning as C
from possum.schemas import PRICE

CORRUPT = "_corrupt_record"


def _reasons(*pairs: tuple[Column, str]) -> Column:
    """First failing rule's message, or null when every rule holds."""
    expr = F.lit(None).cast("string")
    for failed, message in reversed(pairs):
        expr = F.when(failed, F.lit(message)).otherwise(expr)
    return expr


def _bad_parse(raw: Column, parsed: Column) -> Column:
    """A non-empty raw value that did not parse."""
    text = F.btrim(raw, F.lit('"'))
    return raw.isNotNull() & (F.trim(text) != F.lit("")) & parsed.isNull()


def _corrupt(df: DataFrame) -> Column:
    return F.col(CORRUPT).isNotNull() if CORRUPT in df.columns else F.lit(False)


def clean_customers(raw: DataFrame, with_city: bool = False) -> DataFrame:
    """Customer rows: F1 quotes, F2 empty email/address2, F4 birthdate, F6 zip.
    ``with_city`` carries the extract's city and state along for ``cities_of``."""
    carried = [F.col("city").alias("rawCity"), F.col("state").alias("rawState")] if with_city else []
    rid = C.parse_long(F.col("id"))
    zip_ = C.parse_zip(C.strip_quotes(F.col("zip")))
    reject = _reasons(
        (_corrupt(raw), "malformed row"),
        (rid.isNull(), "bad or missing id"),
        (_bad_parse(F.col("zip"), zip_), "bad zip"),
    )
    return raw.select(
        rid.alias("id"),
        # Q14: an empty unquoted field reads as null; keep name parts as '' so
        # the concatenated name does not become null.
        F.coalesce(C.strip_quotes(F.col("firstName")), F.lit("")).alias("firstName"),
        F.coalesce(C.strip_quotes(F.col("lastName")), F.lit("")).alias("lastName"),
        C.null_if_empty(F.col("email")).alias("email"),
        F.coalesce(C.strip_quotes(F.col("address1")), F.lit("")).alias("address1"),
        C.null_if_empty(C.strip_quotes(F.col("address2"))).alias("address2"),
        F.lit(None).cast("string").alias("phone"),
        C.parse_us_date(C.strip_quotes(F.col("birthdate"))).alias("birthdate"),
        zip_.alias("zip"),
        *carried,
        reject.alias("_reject"),
    )


def cities_of(customers: DataFrame) -> DataFrame:
    """AG3 over cleaned customers (``with_city``): rejected rows name no city."""
    return cities(customers.select("zip", F.col("rawCity").alias("city"), F.col("rawState").alias("state")))


def cities(raw: DataFrame) -> DataFrame:
    """AG3 and Q1: one City row per normalized zip.

    The reference groups by the raw zip text and keeps any city; here the zip is
    normalized first and the smallest (city, state) pair is kept, so the choice
    repeats from run to run. ``min`` is a partial aggregate: a zip shared by a
    third of all customers is combined map-side before the shuffle.
    """
    zip_ = C.parse_zip(C.strip_quotes(F.col("zip")))
    picked = (
        raw.select(
            zip_.alias("zip"),
            F.struct(C.strip_quotes(F.col("city")).alias("city"),
                     C.strip_quotes(F.col("state")).alias("state")).alias("cs"),
        )
        .where(F.col("zip").isNotNull())
        .groupBy("zip")
        .agg(F.min("cs").alias("cs"))
    )
    return picked.select("zip", F.col("cs.city").alias("city"), F.col("cs.state").alias("state"))


def clean_orders(raw: DataFrame) -> DataFrame:
    """Order rows: F5 timestamps cut to dates, F3 ``Cancelled`` ship date is null."""
    rid = C.parse_long(F.col("id"))
    cust = C.parse_long(F.col("customer_id"))
    placed = C.parse_datetime_to_date(C.strip_quotes(F.col("datePlaced")))
    shipped_text = C.null_if_cancelled(C.strip_quotes(F.col("dateShipped")))
    shipped = C.parse_datetime_to_date(shipped_text)
    reject = _reasons(
        (_corrupt(raw), "malformed row"),
        (rid.isNull(), "bad or missing id"),
        (_bad_parse(F.col("customer_id"), cust), "bad customer_id"),
        (_bad_parse(F.col("datePlaced"), placed), "bad datePlaced"),
        (_bad_parse(shipped_text, shipped), "bad dateShipped"),
    )
    return raw.select(
        rid.alias("id"),
        placed.alias("datePlaced"),
        shipped.alias("dateShipped"),
        cust.alias("customer_id"),
        reject.alias("_reject"),
    )


def clean_products(raw: DataFrame) -> DataFrame:
    """Product rows: F7/F8 price text to DECIMAL(6,2); overflow is a reject."""
    rid = C.parse_long(F.col("id"))
    price = C.parse_price(F.col("price"))
    qty = C.parse_int(F.col("quantity"))
    reject = _reasons(
        (_corrupt(raw), "malformed row"),
        (rid.isNull(), "bad or missing id"),
        (_bad_parse(F.col("price"), price), "bad or out of range price"),
        (_bad_parse(F.col("quantity"), qty), "bad quantity"),
    )
    return raw.select(
        rid.alias("id"),
        C.strip_quotes(F.col("name")).alias("name"),
        price.alias("currentPrice"),
        qty.alias("availableQuantity"),
        reject.alias("_reject"),
    )


def clean_orderline_units(raw: DataFrame) -> DataFrame:
    """Raw order-line rows (order_id, product_id), one row per unit sold."""
    oid = C.parse_long(F.col("order_id"))
    pid = C.parse_long(F.col("product_id"))
    reject = _reasons(
        (_corrupt(raw), "malformed row"),
        (oid.isNull(), "bad or missing order_id"),
        (pid.isNull(), "bad or missing product_id"),
    )
    return raw.select(oid.alias("order_id"), pid.alias("product_id"),
                      F.lit(1).alias("units"), reject.alias("_reject"))


def order_lines_from_units(units: DataFrame) -> DataFrame:
    """AG1: ``COUNT(*)`` per (order, product) of the raw unit rows.

    ``units`` may carry a ``units`` column (a raw row standing for several
    units); ``n_rows`` keeps the plain row count. Partial aggregation combines
    a hot pair map-side, so the shuffle carries one row per pair and task.
    """
    weight = F.col("units") if "units" in units.columns else F.lit(1)
    return units.groupBy("order_id", "product_id").agg(
        F.sum(weight).cast("int").alias("quantity"),
        F.count(F.lit(1)).alias("n_rows"),
    )


def split_rejects(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows without ``_reject``, rejected rows with their reason)."""
    good = df.where(F.col("_reject").isNull()).drop("_reject")
    bad = df.where(F.col("_reject").isNotNull())
    return good, bad


def price_history_initial(products: DataFrame, as_of: _dt.datetime | Column | None = None) -> DataFrame:
    """CHG6: one history row per product, old price null, stamped ``as_of``.

    ``as_of`` defaults to the job's current time (the reference's ``NOW()``);
    tests pass a fixed value. ``seq`` 0 marks the load; changes use larger seqs.
    """
    if as_of is None:
        ts = F.current_timestamp()
    elif isinstance(as_of, Column):
        ts = as_of
    else:
        ts = F.lit(as_of).cast("timestamp")
    return products.select(
        F.col("id").alias("product_id"),
        F.lit(0).cast("long").alias("seq"),
        F.lit(None).cast(PRICE).alias("oldPrice"),
        F.col("currentPrice").alias("newPrice"),
        ts.alias("ts"),
    )

"""Typed schemas of the POS tables, raw staging files and change logs (DDL2)."""

from __future__ import annotations

from pyspark.sql import types as T

from possum import fixed

# Prices are DECIMAL(6,2) in the POS schema; sums of price x quantity are widened
# to MONEY before rounding so no total can overflow.
PRICE = T.DecimalType(fixed.PRICE_PRECISION, fixed.PRICE_SCALE)
MONEY = T.DecimalType(18, fixed.MONEY_SCALE)


def _f(name: str, dtype: T.DataType, nullable: bool = True) -> T.StructField:
    return T.StructField(name, dtype, nullable)


CUSTOMER = T.StructType([
    _f("id", T.LongType(), False),
    _f("firstName", T.StringType()),
    _f("lastName", T.StringType()),
    _f("email", T.StringType()),
    _f("address1", T.StringType()),
    _f("address2", T.StringType()),
    _f("phone", T.StringType()),
    _f("birthdate", T.DateType()),
    _f("zip", T.StringType()),
])

CITY = T.StructType([
    _f("zip", T.StringType(), False),
    _f("city", T.StringType()),
    _f("state", T.StringType()),
])

ORDER = T.StructType([
    _f("id", T.LongType(), False),
    _f("datePlaced", T.DateType()),
    _f("dateShipped", T.DateType()),
    _f("customer_id", T.LongType()),
])

ORDERLINE = T.StructType([
    _f("order_id", T.LongType(), False),
    _f("product_id", T.LongType(), False),
    _f("quantity", T.IntegerType()),
])

PRODUCT = T.StructType([
    _f("id", T.LongType(), False),
    _f("name", T.StringType()),
    _f("currentPrice", PRICE),
    _f("availableQuantity", T.IntegerType()),
])

# PriceHistory is keyed by (product_id, seq); Spark has no auto-increment id.
PRICE_HISTORY = T.StructType([
    _f("product_id", T.LongType(), False),
    _f("seq", T.LongType(), False),
    _f("oldPrice", PRICE),
    _f("newPrice", PRICE),
    _f("ts", T.TimestampType()),
])

# Raw extracts: every column is text so that parsing happens in one place and
# bad values become rejects rather than failed jobs (SRC5).
CUSTOMER_RAW = T.StructType([
    _f(c, T.StringType())
    for c in ("id", "firstName", "lastName", "city", "state", "zip",
              "address1", "address2", "email", "birthdate")
])
ORDER_RAW = T.StructType([_f(c, T.StringType()) for c in ("id", "customer_id", "datePlaced", "dateShipped")])
PRODUCT_RAW = T.StructType([_f(c, T.StringType()) for c in ("id", "name", "price", "quantity")])
ORDERLINE_RAW = T.StructType([_f(c, T.StringType()) for c in ("order_id", "product_id")])

RAW = {
    "customers": CUSTOMER_RAW,
    "orders": ORDER_RAW,
    "products": PRODUCT_RAW,
    "orderlines": ORDERLINE_RAW,
}

# Declared maximum lengths of the typed text columns (VARCHAR(n)).
MAX_LEN = {
    "customer": {"firstName": 32, "lastName": 30, "email": 128, "address1": 100, "address2": 50, "phone": 32},
    "city": {"city": 32, "state": 4},
    "product": {"name": 128},
}

# Declared keys: primary keys and (child columns, parent table, parent columns).
PRIMARY_KEYS = {
    "customer": ["id"],
    "city": ["zip"],
    "order": ["id"],
    "orderline": ["order_id", "product_id"],
    "product": ["id"],
    "price_history": ["product_id", "seq"],
}
FOREIGN_KEYS = [
    ("customer", ["zip"], "city", ["zip"]),
    ("order", ["customer_id"], "customer", ["id"]),
    ("orderline", ["order_id"], "order", ["id"]),
    ("orderline", ["product_id"], "product", ["id"]),
    ("price_history", ["product_id"], "product", ["id"]),
]

# Change logs (the reference's triggers and row DML become ordered logs).
ORDERLINE_CHANGE = T.StructType([
    _f("seq", T.LongType(), False),
    _f("op", T.StringType(), False),
    _f("order_id", T.LongType(), False),
    _f("product_id", T.LongType(), False),
    _f("quantity", T.IntegerType()),
])

PRODUCT_CHANGE = T.StructType([
    _f("seq", T.LongType(), False),
    _f("op", T.StringType(), False),
    _f("id", T.LongType(), False),
    _f("name", T.StringType()),
    _f("currentPrice", PRICE),
    _f("availableQuantity", T.IntegerType()),
    _f("ts", T.TimestampType()),
])

CUSTOMER_CHANGE = T.StructType(
    [_f("seq", T.LongType(), False), _f("op", T.StringType(), False)] + list(CUSTOMER.fields)
)

# Document schemas (section 1.3 of the blueprint), for reading published sets
# back with exact types (SRC6): decimals stay decimals, dates stay dates.
def _doc(names: list[str], types: list[T.DataType]) -> T.StructType:
    return T.StructType([_f(n, t) for n, t in zip(names, types, strict=True)])


BUYER = _doc(fixed.BUYER_FIELDS, [T.LongType(), T.StringType()])
PROD_DOC = _doc(fixed.PROD_FIELDS, [T.LongType(), T.StringType(), T.ArrayType(BUYER)])
ITEM = _doc(fixed.ITEM_FIELDS, [T.LongType(), T.IntegerType(), T.StringType()])
ORDER_ELEMENT = _doc(fixed.ORDER_FIELDS, [T.LongType(), MONEY, T.DateType(), T.DateType(), T.ArrayType(ITEM)])
CUST_DOC = _doc(fixed.CUST_FIELDS, [T.LongType(), T.StringType(), T.StringType(), T.StringType(),
                                    T.ArrayType(ORDER_ELEMENT)])
POPULAR_PRODUCT = _doc(fixed.POPULAR_FIELDS, [T.LongType(), MONEY, T.LongType(), T.StringType()])
ZIP_DOC = _doc(fixed.ZIP_FIELDS, [T.StringType(), T.StringType(), T.StringType(), T.ArrayType(POPULAR_PRODUCT)])
STATE_MONTH_DOC = _doc(fixed.STATE_MONTH_FIELDS, [T.IntegerType(), T.StringType(), T.ArrayType(POPULAR_PRODUCT)])
DOCS = dict(zip(fixed.COLLECTIONS, [PROD_DOC, CUST_DOC, ZIP_DOC, STATE_MONTH_DOC], strict=True))

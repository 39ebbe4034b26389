"""Scalar cleaning rules and CSV reading on the literal rows of FIXTURES section 2."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from possum.functions import cleaning as C
from possum.plans import etl
from possum.sources.csv import read_extract


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "v string").select(expr(F.col("v")).alias("r")).first()["r"]


def test_strip_quotes_keeps_inner(spark):
    assert one(spark, C.strip_quotes, '"a "b" c"') == 'a "b" c'


def test_null_if_empty_and_cancelled(spark):
    assert one(spark, C.null_if_empty, "") is None
    assert one(spark, C.null_if_empty, "x") == "x"
    assert one(spark, C.null_if_cancelled, "Cancelled") is None


def test_us_date(spark):
    assert one(spark, C.parse_us_date, "3/4/1990") == dt.date(1990, 3, 4)
    assert one(spark, C.parse_us_date, "03/04/1990") == dt.date(1990, 3, 4)
    assert one(spark, C.parse_us_date, "x") is None


def test_datetime_to_date(spark):
    assert one(spark, C.parse_datetime_to_date, "2020-05-01 13:14:15") == dt.date(2020, 5, 1)
    assert one(spark, C.parse_datetime_to_date, "nonsense") is None


def test_zip_rules(spark):
    assert one(spark, C.parse_zip, "01234") == "01234"
    assert one(spark, C.parse_zip, "1234") == "01234"
    assert one(spark, C.parse_zip, "55501-1234") == "55501"
    assert one(spark, C.parse_zip, "") is None
    assert one(spark, C.parse_zip, "123456") is None


def test_price_rules(spark):
    assert one(spark, C.parse_price, '"$1,234.50"') == Decimal("1234.50")
    assert one(spark, C.parse_price, "12345.00") is None  # above DECIMAL(6,2)
    assert one(spark, C.parse_price, "abc") is None


def test_name_and_address(spark):
    df = spark.createDataFrame([("A", None, "1 Main", None), ("A", "B", "1 Main", "5")],
                               "f string, l string, a1 string, a2 string")
    rows = df.select(C.full_name("f", "l").alias("n"), C.printed_address1("a1", "a2").alias("p")).collect()
    assert rows[0]["n"] is None and rows[0]["p"] == "1 Main"
    assert rows[1]["n"] == "A B" and rows[1]["p"] == "1 Main #5"
    line2 = spark.createDataFrame([("Lakeside", "TX", "55501")], "c string, s string, z string").select(
        C.printed_address2("c", "s", "z").alias("x")).first()["x"]
    assert line2 == "Lakeside, TX   55501"


CUSTOMERS_CSV = """id,firstName,lastName,city,state,zip,address1,address2,email,birthdate
1,"Ann","Lee","Lakeside","TX","01234","1 Main","",ann@x.com,3/4/1990
2,"B, C","Diaz","Lakeside","TX","1234","2 Main","7",,03/04/1990
3,,"Empty","Austin","TX","55501-1234","3 Main",,"",x
4,"say \\"hi\\"","Q","Austin","TX","","4 Main",,q@x.com,1/1/2000
5,"short","row"
6,"long","row","a","b","c","d","e","f","g","h","i"
x,"bad","id","a","TX","1","a",,e,1/1/2000
"""


def test_customer_extract(spark, tmp_dir):
    path = f"{tmp_dir}/customers.csv"
    with open(path, "w") as f:
        f.write(CUSTOMERS_CSV)
    df = etl.clean_customers(read_extract(spark, path, "customers"))
    rows = {r["id"]: r for r in df.collect() if r["id"] is not None}
    good, bad = etl.split_rejects(df)
    good_ids = sorted(r["id"] for r in good.collect())
    assert good_ids == [1, 2, 3, 4]
    reasons = sorted(r["_reject"] for r in bad.collect())
    assert reasons == ["bad or missing id", "malformed row", "malformed row"]
    assert rows[2]["firstName"] == "B, C"
    # TRIM('"' FROM ...) after the reader unquoted the field also eats the
    # closing quote of the value, as in the reference.
    assert rows[4]["firstName"] == 'say "hi'
    assert rows[1]["email"] == "ann@x.com" and rows[2]["email"] is None and rows[3]["email"] is None
    assert rows[3]["firstName"] == ""  # empty first name does not null the full name
    assert rows[1]["zip"] == "01234" and rows[2]["zip"] == "01234" and rows[3]["zip"] == "55501"
    assert rows[4]["zip"] is None
    assert rows[1]["birthdate"] == dt.date(1990, 3, 4) and rows[3]["birthdate"] is None
    assert rows[1]["address2"] is None and rows[2]["address2"] == "7"


def test_doubled_quotes_with_quote_escape(spark, tmp_dir):
    path = f"{tmp_dir}/products.csv"
    with open(path, "w") as f:
        f.write('id,name,price,quantity\n1,"dq ""hi""","$1,234.50",3\n2,"big","$12,345.00",1\n')
    df = etl.clean_products(read_extract(spark, path, "products", escape='"'))
    rows = {r["id"]: r for r in df.collect()}
    assert rows[1]["name"] == 'dq "hi'
    assert rows[1]["currentPrice"] == Decimal("1234.50") and rows[1]["_reject"] is None
    assert rows[2]["_reject"] == "bad or out of range price"


def test_orders_cancelled(spark, tmp_dir):
    path = f"{tmp_dir}/orders.csv"
    with open(path, "w") as f:
        f.write('id,customer_id,datePlaced,dateShipped\n1,2,"2020-01-02 03:04:05","Cancelled"\n'
                '2,2,"2020-01-02 03:04:05","2020-01-05 00:00:00"\n')
    rows = {r["id"]: r for r in etl.clean_orders(read_extract(spark, path, "orders")).collect()}
    assert rows[1]["dateShipped"] is None and rows[1]["_reject"] is None
    assert rows[2]["dateShipped"] == dt.date(2020, 1, 5)
    assert rows[1]["datePlaced"] == dt.date(2020, 1, 2)


def test_cities_one_per_zip_repeatable(spark):
    raw = spark.createDataFrame(
        [("1", "A", "Zeta", "TX", "1234"), ("2", "B", "Alpha", "TX", "01234"), ("3", "C", "Lakeside", "TX", "55501")],
        "id string, firstName string, city string, state string, zip string")
    rows = sorted(tuple(r) for r in etl.cities(raw).collect())
    assert rows == [("01234", "Alpha", "TX"), ("55501", "Lakeside", "TX")]


def test_order_lines_count_units(spark):
    raw = spark.createDataFrame([("1", "3"), ("1", "3"), ("1", "4")], "order_id string, product_id string")
    good, _ = etl.split_rejects(etl.clean_orderline_units(raw))
    rows = sorted(tuple(r) for r in etl.order_lines_from_units(good.drop("units")).collect())
    assert rows == [(1, 3, 2, 2), (1, 4, 1, 1)]


def test_price_history_initial(spark):
    products = spark.createDataFrame([(1, Decimal("9.99"))], "id long, currentPrice decimal(6,2)")
    row = etl.price_history_initial(products, dt.datetime(2024, 1, 1)).first()
    assert row["oldPrice"] is None and row["newPrice"] == Decimal("9.99") and row["seq"] == 0

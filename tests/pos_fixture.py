"""A small literal POS data set covering the cases of FIXTURES section 2."""

import datetime as dt
from decimal import Decimal

from possum import schemas
from possum.sources.testdata import PosTables

D = Decimal


def pos(spark) -> PosTables:
    customer = spark.createDataFrame([
        (9, "Nina", "Nine", "n@x", "9 Elm", None, None, None, "55501"),
        (10, "Ten", "Tenor", None, "10 Oak", "B", None, None, "55501"),
        (11, "Ola", "Lone", None, "11 Ash", None, None, None, "73301"),   # no orders
        (12, "Tie", "One", None, "12 Fir", None, None, None, "73301"),
        (13, "Tie", "Two", None, "13 Fir", None, None, None, "10001"),
        (14, "No", "City", None, "14 Fir", None, None, None, "99999"),   # no City row
    ], schemas.CUSTOMER)
    city = spark.createDataFrame([
        ("55501", "Springfield", "TX"), ("73301", "Austin", "TX"), ("10001", "New York", "NY"),
    ], schemas.CITY)
    order = spark.createDataFrame([
        (100, dt.date(2020, 5, 1), None, 9),
        (101, dt.date(2020, 5, 2), dt.date(2020, 5, 4), 10),
        (102, dt.date(2020, 6, 1), dt.date(2020, 6, 2), 12),
        (103, dt.date(2020, 5, 9), dt.date(2020, 5, 10), 13),
        (104, dt.date(2020, 7, 1), None, 9),                 # order without lines
    ], schemas.ORDER)
    orderline = spark.createDataFrame([
        (100, 1, 2), (100, 2, 1), (101, 1, 1), (102, 2, 50), (103, 3, 10),
    ], schemas.ORDERLINE)
    product = spark.createDataFrame([
        (1, "Widget", D("10.00"), 5), (2, "Gadget", D("2.50"), 7), (3, "Gizmo", D("12.50"), 1),
        (4, "Unsold", D("1.00"), 0),
    ], schemas.PRODUCT)
    return PosTables(customer=customer, city=city, order=order, orderline=orderline, product=product)

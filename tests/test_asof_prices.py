"""As-of join, totals at the price of purchase, and the price history as a stream."""

import datetime as dt
import random
from decimal import Decimal as D

import pytest

from possum import schemas
from possum.operators.asof import as_of
from possum.plans import changes
from possum.plans import documents as docs
from possum.streaming.prices import PriceHistoryStream


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("strict", [False, True])
def test_as_of_against_all_rows(spark, forward, strict):
    r = random.Random(7)
    log = {(k, t): (None if r.random() < 0.1 else r.randint(0, 99)) for k in (1, 2, 3) for t in r.sample(range(-200, 200), 40 if k == 1 else 5)}
    asked = [(r.choice([1, 1, 1, 2, 4, None]), r.choice([None, *range(-220, 220)])) for _ in range(300)]
    got = as_of(spark.createDataFrame(asked, "k long, t long"), spark.createDataFrame([(*k, v) for k, v in log.items()], "k long, t long, v int"), ["k"], "t", "v", 16, forward, strict)
    want = {}
    for k, t in asked:
        if k is not None and t is not None:
            near = [u for j, u in log if j == k and ((u > t or u == t and not strict) if forward else (u < t or u == t and not strict))]
            want[k, t] = log[k, (min(near) if forward else max(near))] if near else None
    assert {(x["k"], x["t"]): x["v"] for x in got.collect()} == want
    assert got.count() == len(want)


def day(d):
    return dt.datetime(2020, 1, d)


def test_order_totals_as_of(spark):
    order = spark.createDataFrame([(1, dt.date(2020, 1, 1), None, 9), (2, dt.date(2020, 1, 5), None, 9), (3, dt.date(2020, 1, 9), None, 8), (4, None, None, 8), (5, dt.date(2020, 1, 9), None, 8)], schemas.ORDER)
    lines = spark.createDataFrame([(1, 1, 2), (2, 1, 2), (3, 1, 1), (3, 2, 3), (4, 1, 1), (3, 7, 5), (6, 1, 1)], schemas.ORDERLINE)
    product = spark.createDataFrame([(1, "a", D("10.00"), 1), (2, "b", D("1.50"), 1)], schemas.PRODUCT)
    log = spark.createDataFrame([(10, 1, D("11.00"), day(5)), (12, 1, D("12.00"), day(5)), (12, 1, D("12.50"), day(5)), (20, 1, None, day(8)), (30, 1, D("99.00"), day(10))], "seq long, id long, currentPrice decimal(6,2), ts timestamp_ntz")
    got = {r["order_id"]: (r["customer_id"], r["OrderTotal"]) for r in docs.order_totals_as_of(order, lines, product, log).collect()}
    # before the first price the table's; the last of the day, ties the larger; a null is no price; no date, the table's
    assert got == {1: (9, D("20.00")), 2: (9, D("25.00")), 3: (8, D("17.00")), 4: (8, D("10.00"))}


def test_a_hot_product_is_spread_over_ranges(spark):
    n = 2000
    order = spark.range(n).selectExpr("id", "date_add(date'2000-01-01', cast(id % 1500 as int)) datePlaced", "cast(null as date) dateShipped", "id customer_id")
    lines = spark.range(n).selectExpr("id order_id", "1L product_id", "1 quantity")
    product = spark.createDataFrame([(1, "hot", D("1.00"), 1)], schemas.PRODUCT)
    log = spark.range(0, 1500, 7).selectExpr("id seq", "1L id", "cast(id % 500 + 2 as decimal(6,2)) currentPrice", "cast(date_add(date'2000-01-01', cast(id as int)) as timestamp_ntz) ts")
    got = docs.order_totals_as_of(order, lines, product, log)
    want = {i: D(i % 1500 // 7 * 7 % 500 + 2) for i in range(n)}
    assert {r["order_id"]: r["OrderTotal"] for r in got.collect()} == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and "_r" in plan  # by (product, range), not by product alone


LOG = "seq long, op string, id long, name string, currentPrice decimal(6,2), availableQuantity int, ts timestamp_ntz"


@pytest.mark.parametrize("compact_after", [100, 2])
def test_price_history_in_any_order(spark, tmp_path, compact_after):
    r = random.Random(compact_after)
    product = spark.createDataFrame([(1, "a", D("1.00"), 1), (2, "b", None, 1)], schemas.PRODUCT)
    rows = [(s, "U", r.choice([1, 1, 1, 2, 3]), "n", r.choice([None, D("1.00"), D("2.00"), D("3.00")]), 1, day(1 + s % 28)) for s in range(0, 240, 3)]
    want = sorted(map(repr, changes.price_history_changes(product, spark.createDataFrame(rows, LOG), 16).collect()))
    r.shuffle(rows)
    m = PriceHistoryStream(spark, str(tmp_path / "s"), product, 16, compact_after)
    parts = [rows[:20], rows[20:22], rows[22:60], rows[60:], rows[5:30]]  # the last one repeats rows
    for i, part in enumerate([*parts, parts[1]]):
        m.apply_batch(spark.createDataFrame(part, LOG), f"b{min(i, 5) if i < 5 else 1}")
    assert sorted(map(repr, m.history().collect())) == want


def test_price_history_without_changes(spark, tmp_path):
    m = PriceHistoryStream(spark, str(tmp_path / "s"), spark.createDataFrame([], schemas.PRODUCT), 16)
    m.apply_batch(spark.createDataFrame([], LOG), "b0")
    assert m.history().count() == 0


def test_several_changes_at_one_place_are_the_largest(spark, tmp_path):
    product = spark.createDataFrame([(1, "a", D("1.00"), 1)], schemas.PRODUCT)
    row = lambda seq, price: (seq, "U", 1, "n", price, 1, day(1))
    m = PriceHistoryStream(spark, str(tmp_path / "s"), product, 16)
    for i, part in enumerate([[row(5, D("2.00")), row(9, D("4.00"))], [row(5, D("3.00"))], [row(5, None)]]):
        m.apply_batch(spark.createDataFrame(part, LOG), f"b{i}")
    assert [(r["seq"], r["oldPrice"], r["newPrice"]) for r in m.history().orderBy("seq").collect()] == [(5, D("1.00"), D("3.00")), (9, D("3.00"), D("4.00"))]


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("strict", [False, True])
def test_as_of_in_one_window(spark, forward, strict):
    """Without a width the lookup gives the same rows and moves each once."""
    rng = random.Random(9)
    asked = spark.createDataFrame([(rng.randrange(5), rng.randrange(-60, 60)) for _ in range(200)], "k long, t long")
    log = spark.createDataFrame([(k, t, t) for k in range(4) for t in rng.sample(range(-60, 60), 20)], "k long, t long, v long")
    whole, cut = (as_of(asked, log, ["k"], "t", "v", w, forward, strict) for w in (None, 16))
    assert sorted(map(repr, whole.collect())) == sorted(map(repr, cut.collect()))
    assert "Join" not in whole._jdf.queryExecution().optimizedPlan().toString()

"""Results kept by signed differences against rebuilds, on random logs with deletes and re-inserts."""

import random
from decimal import Decimal as D

import pytest

from pos_fixture import pos
from possum import schemas
from possum.operators import checks
from possum.plans import changes, differences, views
from possum.plans import documents as docs
from possum.session import job_session
from possum.streaming.counts import BuyerCounts

KEY = ["order_id", "product_id"]


def random_log(spark, seed, n=60):
    r = random.Random(seed)
    rows = [(s, r.choice("IIUD"), r.choice([100, 101, 102, 103, 104, 105]), r.choice([1, 2, 3, 4]), r.choice([None, 1, 2, 60])) for s in range(n)]
    return spark.createDataFrame(rows, schemas.ORDERLINE_CHANGE)


def feed_of(base, log):
    return differences.with_images(base, log, KEY, ["quantity"], ["quantity"], 16)


def test_images_are_the_rows_before(spark):
    base = spark.createDataFrame([(1, 1, 5), (2, 1, None)], schemas.ORDERLINE)
    log = spark.createDataFrame([(1, "U", 1, 1, 7), (40, "D", 1, 1, 0), (50, "D", 1, 1, 0), (60, "I", 1, 1, 2), (3, "D", 2, 1, None), (2, "I", 9, 9, 1)], schemas.ORDERLINE_CHANGE)
    got = {r["seq"]: None if r["before"] is None else r["before"]["quantity"] for r in feed_of(base, log).collect()}
    assert got == {1: 5, 40: 7, 50: None, 60: None, 3: None, 2: None}
    diff = {(r["order_id"], r["lines"], r["units"]) for r in differences.line_differences(feed_of(base, log)).collect()}
    assert diff == {(1, 0, 2), (1, -1, -7), (1, 1, 2), (2, -1, 0), (9, 1, 1)}


@pytest.mark.parametrize("keys", [differences.FACT_KEYS, differences.MONTH_FACT_KEYS])
@pytest.mark.parametrize("seed", [1, 2])
def test_facts_after_equal_a_rebuild(spark, keys, seed):
    t, log = pos(spark), random_log(spark, seed)
    after = spark.createDataFrame([(1, "Widget", D("11.11"), 5), (2, "Renamed", None, 7), (3, "Gizmo", D("12.50"), 1), (5, "New", D("3.00"), 0)], schemas.PRODUCT)
    lines = differences.line_differences(feed_of(t.orderline, log))
    state = differences.fact_state(t.customer, t.order, t.orderline, t.product, keys)
    prices = differences.price_differences(t.product, after)
    final = changes.apply_changes(t.orderline, log, KEY, tie_cols=["quantity"]).fillna(0)
    build = docs.zip_product_facts if keys == differences.FACT_KEYS else docs.zip_month_product_facts
    want = sorted(map(repr, build(t.customer, t.order, final, after).collect()))
    got = differences.facts_of(differences.facts_after(state, lines, prices, t.order, t.customer, keys), after, keys)
    assert sorted(map(repr, got.collect())) == want
    # in two steps, the later half of the differences first
    early, late = lines.where("order_id <= 101"), lines.where("order_id > 101")
    same = differences.price_differences(after, after)
    two = differences.facts_after(differences.facts_after(state, late, prices, t.order, t.customer, keys), early, same, t.order, t.customer, keys)
    assert sorted(map(repr, differences.facts_of(two, after, keys).collect())) == want


@pytest.mark.parametrize("compact_after", [100, 1])
def test_buyers_by_counts_equal_a_rebuild(spark, tmp_path, compact_after):
    t, r = pos(spark), random.Random(compact_after)
    log = random_log(spark, compact_after, 80)
    late = spark.createDataFrame([(105, None, None, 13)], schemas.ORDER)
    now = {"t": t}
    m = BuyerCounts(spark, str(tmp_path / "m"), lambda: now["t"], compact_after, 1)
    m.bootstrap(t.orderline)
    assert sorted(map(repr, m.view().collect())) == sorted(map(repr, views.product_buyers(t.product, t.customer, t.order, t.orderline).collect()))
    rows = feed_of(t.orderline, log).collect()
    r.shuffle(rows)  # batches in any order
    schema = feed_of(t.orderline, log).schema
    for i in range(4):
        if i == 2:  # an order arrives after its lines, a product is renamed, one goes
            renamed = spark.createDataFrame([(1, "Widget 2", D("10.00"), 5), (2, "Gadget", D("2.50"), 7), (3, "Gizmo", D("12.50"), 1)], schemas.PRODUCT)
            now["t"] = type(t)(t.customer, t.city, t.order.union(late), t.orderline, renamed)
        m.apply_batch(spark.createDataFrame(rows[i * 20 : (i + 1) * 20], schema), f"b{i}")
        m.apply_batch(spark.createDataFrame(rows[i * 20 : (i + 1) * 20], schema), f"b{i}")  # replayed
    final = changes.apply_changes(t.orderline, log, KEY, tie_cols=["quantity"])
    want = views.product_buyers(now["t"].product, t.customer, now["t"].order, final)
    assert sorted(map(repr, m.view().collect())) == sorted(map(repr, want.collect()))


def test_a_batch_reads_no_order_lines(spark, tmp_path):
    t = pos(spark)
    t.orderline.write.parquet(str(tmp_path / "orderline"))
    m = BuyerCounts(spark, str(tmp_path / "m"), lambda: t)
    m.bootstrap(spark.read.parquet(str(tmp_path / "orderline")))
    delta = spark.createDataFrame([(1, 9, -1)], "product_id long, customer_id long, n long")
    for df in (m.touched(delta, "b", t), m._lists(delta.select("product_id"), t)):
        files = "".join(df.inputFiles())
        assert "/m/base/" in files and "orderline" not in files


def test_folders_that_a_failure_leaves_are_not_counted_twice(spark, tmp_path):
    t = pos(spark)
    m = BuyerCounts(spark, str(tmp_path / "m"), lambda: t, 0)
    m.bootstrap(t.orderline)
    kept, pair = str(tmp_path / "m/changes/b0"), [(1, 9, 5)]
    spark.createDataFrame(pair, "product_id long, customer_id long, n long").write.parquet(kept)
    n = {(r["product_id"], r["customer_id"]): r["n"] for r in m.counts().collect()}
    m._publish_base(m.sums(), "base-b0", ["b0"])  # and no removal
    assert {(r["product_id"], r["customer_id"]): r["n"] for r in m.counts().collect()} == n


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_fk_violations_after_equal_a_full_check(spark, seed):
    r = random.Random(seed)
    children = [(r.choice([None, *range(12)]),) for _ in range(40)]
    parents = [(i,) for i in range(0, 12, 2)]
    gone, come = r.sample(parents, 2), [(i,) for i in r.sample(range(1, 12, 2), 3)]
    off, on = [c for c in children[:10]], [(r.randint(0, 14),) for _ in range(10)]
    df = lambda rows: spark.createDataFrame(rows, "k long")
    signed = lambda plus, minus: spark.createDataFrame([(*x, 1) for x in plus] + [(*x, -1) for x in minus], "k long, n long")
    counts, there = differences.key_counts(df(children), ["k"]), differences.key_counts(df(parents), ["k"])
    before = differences.missing_parents(counts, there, ["k"])
    got = differences.fk_violations_after(before, counts, there, signed(on, off), signed(come, gone), ["k"])
    want = checks.fk_violations(df(children[10:] + on), ["k"], df([p for p in parents if p not in gone] + come), ["k"], "c")
    assert sorted((str(r["k"]), r["n"]) for r in got.collect()) == sorted((r["key"], r["n"]) for r in want.collect())


def test_job_session_keeps_what_is_running(spark):
    assert job_session().sparkContext.master == spark.sparkContext.master

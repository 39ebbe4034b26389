"""How often the rows of a plan move: each shuffle of the order lines counts at size."""

import pytest
from pyspark.sql import functions as F

from pos_fixture import pos
from possum import schemas
from possum.operators.collect import collect_sorted
from possum.plans import differences
from possum.plans import documents as D
from possum.streaming.change_table import ChangeTable


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    """Joins as on tables too large to broadcast."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield
    spark.conf.set(name, old)


def test_sorted_arrays_move_rows_once(spark):
    rows = [(g, i * 7 % 50, f"z{i % 3}", None if i % 9 == 0 else f"v{i}") for g in (1, 2, None) for i in range(60)]
    df = spark.createDataFrame(rows, "g long, k long, z string, v string")
    got = collect_sorted(df, ["g"], ["k", "z"], F.col("v"), "a")
    assert plan(got).count("Exchange hashpartitioning") == 1
    want = {g: [v for _, _, v in sorted((k, z, v) for h, k, z, v in rows if h == g and v)] for g in (1, 2, None)}
    assert {r["g"]: r["a"] for r in got.collect()} == want


@pytest.mark.parametrize("facts", [D.zip_product_facts, D.zip_month_product_facts])
def test_facts_move_lines_for_one_join(spark, no_broadcast, facts):
    t = pos(spark)
    text = plan(facts(t.customer, t.order, t.orderline, t.product))
    # lines by order and sums by product: of the customer join only orders and customers move
    assert text.index("Exchange hashpartitioning(order_id") < text.index("Exchange hashpartitioning(customer_id")


def test_state_month_documents_move_facts_once(spark):
    t = pos(spark)
    facts = D.zip_month_product_facts(t.customer, t.order, t.orderline, t.product)
    docs = plan(D.state_month_documents(facts, F.broadcast(t.city))).count("Exchange hashpartitioning")
    assert docs - plan(facts).count("Exchange hashpartitioning") == 1


def test_line_differences_move_for_one_join(spark, no_broadcast):
    t = pos(spark)
    text = plan(differences.fact_state(t.customer, t.order, t.orderline, t.product, differences.MONTH_FACT_KEYS))
    assert text.index("Exchange hashpartitioning(order_id") < text.index("Exchange hashpartitioning(customer_id")


def test_a_base_without_changes_is_the_state(spark, tmp_dir):
    t = pos(spark)
    table = ChangeTable(spark, f"{tmp_dir}/orderline", schemas.ORDERLINE, ["order_id", "product_id"], tie_cols=["quantity"])
    table.bootstrap(t.orderline)
    assert "Exchange" not in plan(table.current())
    assert sorted(table.current().collect()) == sorted(t.orderline.collect())
    change = spark.createDataFrame([(1, "D", 100, 1, 2), (2, "I", 100, 9, 4)], table.log_schema)
    table.append(change, "a")
    want = {(100, 2), (100, 9), (101, 1), (102, 2), (103, 3)}
    assert {(r[0], r[1]) for r in table.current().collect()} == want
    table.compact("next")  # deletes stay in the base and hide their key
    assert {(r[0], r[1]) for r in table.current().collect()} == want

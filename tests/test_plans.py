"""Plan properties that matter at scale: filters reach the Parquet scans, sort +
limit is a per-task top-k, and the view needs no shuffle beyond its keys."""

import contextlib
import io

from conftest import SF_SMALL
from possum import registry


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def shuffles(text: str) -> int:
    tree = text.split("\n\n")[0]
    return tree.count("Exchange (") - tree.count("BroadcastExchange (")


def test_recall_filter_reaches_lineitem_scan(spark):
    text = plan(registry.product_recall(spark, SF_SMALL))
    assert "EqualTo(l_partkey,1)" in text and "EqualTo(p_partkey,1)" in text


def test_state_reports_filter_region_scan_and_top_k(spark):
    text = plan(registry.state_top_products(spark, SF_SMALL))
    assert "EqualTo(r_name,AMERICA)" in text
    assert "TakeOrderedAndProject" in text
    text = plan(registry.state_month_products(spark, SF_SMALL))
    assert "EqualTo(r_name,AMERICA)" in text


def test_columns_pruned_at_scan(spark):
    text = plan(registry.product_buyers(spark, SF_SMALL))
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint>" in text
    assert "ReadSchema: struct<p_partkey:bigint,p_name:string>" in text


def test_view_shuffles_only_on_its_keys(spark):
    # buyer pairs (product, customer), buyer lists in their two fixed levels
    # (product, part) and (product), and the product side of the final join:
    # four shuffles.
    assert shuffles(plan(registry.product_buyers(spark, SF_SMALL))) <= 4


def test_change_apply_is_one_aggregate_without_a_join(spark):
    text = plan(registry.apply_changes(spark, SF_SMALL)).split("\n\n")[0]
    assert "Join" not in text and text.count("Exchange") <= 2  # order lines per key, then the last change per key

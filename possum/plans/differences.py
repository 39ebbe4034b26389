"""Results kept current from signed differences, without the tables they came from.

A change feed names the row before each change as well as after (a row-image
log; ``with_images`` derives one from a table and its log). Every change is
then a difference: of lines, of units, of money. Differences add up, so they
can be summed in any order and map-side, and a batch needs only the kept
result and its own rows:

* ``facts_after`` (AG5, AG6): zip, month and product facts; a price change
  adds quantity times price change, a group without lines goes;
* ``fk_violations_after`` (CHK2): foreign-key violations of touched keys, for
  children and parents that come or go.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from possum.functions.cleaning import round_money
from possum.operators.sequence import previous_value
from possum.plans.changes import DELETE

SALES = "decimal(38,2)"
FACT_KEYS = ["zip", "product_id"]
MONTH_FACT_KEYS = ["zip", "OrderMonth", "product_id"]


def with_images(base: DataFrame, log: DataFrame, key_cols: Sequence[str], image_cols: Sequence[str], tie_cols: Sequence[str] = (),
                bucket_width: int | None = None) -> DataFrame:
    """The log with ``before``: the struct of ``image_cols`` that the change found, null if there was no row.

    ``base`` is the table before the log; ``seq`` of the log is 0 or more.
    Changes of a key are ordered as in ``changes.apply_changes``."""
    image = F.struct(*image_cols)
    first = base.select(F.lit(-1).cast("long").alias("seq"), F.lit("I").alias("op"), *key_cols, *image_cols)
    rows = first.unionByName(log.select(*first.columns)).withColumn("_now", F.when(F.col("op") != F.lit(DELETE), image))
    seen = previous_value(rows, key_cols, "seq", "_now", tie_cols=[*tie_cols, "op"], bucket_width=bucket_width, prev_col="before", has_prev_col="_had", sizes=log)
    return seen.where("seq >= 0").drop("_now", "_had")


def line_differences(feed: DataFrame) -> DataFrame:
    """(order_id, product_id, lines, units) that each change of an order-line feed adds or takes."""
    now, then = F.col("op") != F.lit(DELETE), F.col("before").isNotNull()
    units = F.when(now, F.coalesce("quantity", F.lit(0))).otherwise(0) - F.when(then, F.coalesce("before.quantity", F.lit(0))).otherwise(0)
    out = feed.select("order_id", "product_id", (now.cast("long") - then.cast("long")).alias("lines"), units.cast("long").alias("units"))
    return out.where("lines <> 0 or units <> 0")


def _located(lines: DataFrame, order: DataFrame, customer: DataFrame) -> DataFrame:
    """Lines with their zip and month. Orders meet their customers first, so the lines move for one join only."""
    o = order.select(F.col("id").alias("order_id"), "customer_id", F.month("datePlaced").alias("OrderMonth"))
    c = customer.select(F.col("id").alias("customer_id"), "zip")
    return lines.join(o.join(c, "customer_id").drop("customer_id"), "order_id")


def _price(col: str) -> Column:
    return F.coalesce(F.col(col), F.lit(0))


def fact_state(customer: DataFrame, order: DataFrame, orderline: DataFrame, product: DataFrame, keys: Sequence[str] = FACT_KEYS) -> DataFrame:
    """(keys, lines, units, sales): what ``facts_after`` keeps; a missing price counts as 0 here."""
    lines = orderline.select("order_id", "product_id", F.lit(1).cast("long").alias("lines"), F.coalesce("quantity", F.lit(0)).cast("long").alias("units"))
    sums = _located(lines, order, customer).groupBy(*keys).agg(F.sum("lines").alias("lines"), F.sum("units").alias("units"))
    prices = product.select(F.col("id").alias("product_id"), _price("currentPrice").alias("_p"))
    return sums.join(prices, "product_id", "left").select(*keys, "lines", "units", (F.col("units") * _price("_p")).cast(SALES).alias("sales"))


def price_differences(product: DataFrame, after: DataFrame) -> DataFrame:
    """(product_id, old, new) of every product in either table; a missing product or price is 0."""
    old = product.select(F.col("id").alias("product_id"), F.col("currentPrice").alias("old"))
    new = after.select(F.col("id").alias("product_id"), F.col("currentPrice").alias("new"))
    return old.join(new, "product_id", "full_outer").select("product_id", _price("old").alias("old"), _price("new").alias("new"))


def facts_after(state: DataFrame, lines: DataFrame, prices: DataFrame, order: DataFrame, customer: DataFrame, keys: Sequence[str] = FACT_KEYS) -> DataFrame:
    """The state after line differences and then price differences, in its own form.

    sales after = sales + units that came or went at the old price + units
    after at the price change; all decimals are exact. Groups without lines
    are gone. Order and customer are the tables the lines belong to."""
    moved = _located(lines, order, customer).groupBy(*keys).agg(F.sum("lines").alias("lines"), F.sum("units").alias("units"))
    both = state.select(*keys, "lines", "units", "sales", F.lit(0).cast("long").alias("new_units")).unionByName(
        moved.select(*keys, "lines", "units", F.lit(0).cast(SALES).alias("sales"), F.col("units").alias("new_units")))
    sums = both.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("lines", "units", "sales", "new_units")]).where("lines <> 0")
    sales = F.col("sales") + F.col("new_units") * _price("old") + F.col("units") * (_price("new") - _price("old"))
    return sums.join(prices, "product_id", "left").select(*keys, "lines", "units", sales.cast(SALES).alias("sales"))


def facts_of(state: DataFrame, product: DataFrame, keys: Sequence[str] = FACT_KEYS) -> DataFrame:
    """The fact columns of ``documents.zip_product_facts`` (or the monthly form): products that exist, null sales without a price."""
    p = product.select(F.col("id").alias("product_id"), F.col("name").alias("ProductName"), "currentPrice")
    sales = F.when(F.col("currentPrice").isNotNull(), round_money(F.col("sales")))
    return state.join(p, "product_id").select(*[k for k in keys if k != "product_id"], F.col("product_id").alias("ProductID"), "ProductName",
                                              F.col("units").alias("TotalPurchases"), sales.alias("TotalSales"))


def key_counts(rows: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(cols, n): rows of each key; rows with a null in the key aren't counted, as in SQL foreign keys."""
    return rows.na.drop(subset=list(cols)).groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))


def missing_parents(counts: DataFrame, parents: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(cols, n): child keys with no parent, and their rows."""
    return counts.where("n > 0").join(parents.where("n > 0"), list(cols), "left_anti")


def fk_violations_after(before: DataFrame, counts: DataFrame, parents: DataFrame, child_changes: DataFrame, parent_changes: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The violations (cols, n) after signed changes (cols, n) of children and of parents.

    ``before`` are the violations, ``counts`` and ``parents`` the ``key_counts``
    of both sides before the changes. Only touched keys are looked at: a child
    that comes may lack its parent, a parent that goes may leave children, a
    parent that comes or a child that goes may end a violation. Changes of null
    keys are ignored."""
    cols = list(cols)
    touched = child_changes.select(*cols).unionByName(parent_changes.select(*cols)).na.drop().distinct()

    def now(kept: DataFrame, changes: DataFrame) -> DataFrame:
        rows = kept.join(touched, cols, "left_semi").unionByName(changes.na.drop(subset=cols).select(*cols, "n"))
        return rows.groupBy(*cols).agg(F.sum("n").alias("n"))

    return before.join(touched, cols, "left_anti").unionByName(missing_parents(now(counts, child_changes), now(parents, parent_changes), cols))

"""Change handling: the reference's triggers and row DML as ordered change logs.

* ``latest_changes`` / ``apply_changes`` (CHG4): last change per key wins;
  ``D`` removes the key, ``I``/``U`` put the row image.
* ``updates_where`` / ``deletes_where``: row DML by predicate turned into log rows.
* ``price_history_changes`` (CHG3, FLT9, Q9): a history row for every price
  change; a change from or to null is not recorded.
* ``touched_products`` (Q8): products whose buyer list may change, from
  order-line, order and customer changes.

Every function is set-based: touched keys stay DataFrames, never collected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from possum.operators.sequence import previous_value

DELETE = "D"


def latest_changes(log: DataFrame, key_cols: Sequence[str], seq_col: str = "seq", op_col: str = "op",
                   tie_cols: Sequence[str] = ()) -> DataFrame:
    """The last change per key: keys, op and the row image of that change.

    ``max_by`` over (seq, ties) is a partial aggregate: a key changed a million
    times is reduced map-side and never gathered in one task."""
    keys = list(key_cols)
    image_cols = [c for c in log.columns if c not in keys]
    order = F.struct(F.col(seq_col), *[F.col(c) for c in tie_cols], F.col(op_col))
    last = log.groupBy(*keys).agg(F.max_by(F.struct(*image_cols), order).alias("_last"))
    return last.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in image_cols])


def apply_changes(snapshot: DataFrame, log: DataFrame, key_cols: Sequence[str], seq_col: str = "seq",
                  op_col: str = "op", tie_cols: Sequence[str] = ()) -> DataFrame:
    """CHG4: the snapshot after the log: per key the last change's image, the
    snapshot's where the log has none, nothing after a delete. Keys are unique
    in the snapshot; log and snapshot are each read once."""
    keys = list(key_cols)
    # the snapshot is the oldest change of every key, so one aggregate decides
    first = snapshot.select(*snapshot.columns, F.lit(None).cast("long").alias(seq_col), F.lit("").alias(op_col))
    both = first.unionByName(log.select(*first.columns))
    rank = F.struct(F.col(seq_col), *[F.col(c) for c in tie_cols], F.col(op_col))
    images = [c for c in snapshot.columns if c not in keys]
    last = both.groupBy(*keys).agg(*[F.max_by(c, rank).alias(c) for c in images], F.max_by(op_col, rank).alias(op_col))
    return last.where(F.col(op_col) != F.lit(DELETE)).select(*snapshot.columns)


def updates_where(snapshot: DataFrame, condition: Column, assignments: dict[str, Column],
                  seq: Column, op: str = "U") -> DataFrame:
    """``UPDATE t SET c = e WHERE cond`` as change-log rows (row images after)."""
    cols = [assignments.get(c, F.col(c)).alias(c) for c in snapshot.columns]
    return snapshot.where(condition).select(seq.cast("long").alias("seq"), F.lit(op).alias("op"), *cols)


def deletes_where(snapshot: DataFrame, condition: Column, seq: Column) -> DataFrame:
    """``DELETE FROM t WHERE cond`` as change-log rows."""
    return snapshot.where(condition).select(seq.cast("long").alias("seq"), F.lit(DELETE).alias("op"),
                                            *snapshot.columns)


def price_history_changes(product: DataFrame, log: DataFrame, bucket_width: int | None = None) -> DataFrame:
    """CHG3: (product_id, seq, oldPrice, newPrice, ts) for each logged price
    that differs from the one before it.

    ``product`` is the snapshot before the log (its price is the "before" of a
    product's first change); ``log`` has (seq, id, currentPrice, ts), ordered by
    seq per product, ties by price. ``old != new`` is false for a null on
    either side, as in the reference's trigger (Q9)."""
    changes = log.select(F.col("id").alias("product_id"), "seq", F.col("currentPrice").alias("newPrice"), "ts")
    prev = previous_value(changes, ["product_id"], "seq", "newPrice", tie_cols=["newPrice"], bucket_width=bucket_width)
    base = product.select(F.col("id").alias("product_id"), F.col("currentPrice").alias("_base"))
    withbase = prev.join(base, "product_id", "left")
    old = F.when(F.col("has_prev"), F.col("prev")).otherwise(F.col("_base"))
    return withbase.select("product_id", "seq", old.alias("oldPrice"), "newPrice", "ts").where(
        F.col("oldPrice") != F.col("newPrice"))


def touched_products(orderline_changes: DataFrame | None = None,
                     product_changes: DataFrame | None = None,
                     orderline: DataFrame | None = None,
                     order_changes: DataFrame | None = None,
                     customer_changes: DataFrame | None = None,
                     order: DataFrame | None = None) -> DataFrame:
    """Q8: product ids whose buyer list may change.

    Order-line changes touch their product, and so does a new or renamed
    product. An order change (moved to another
    customer) and a customer change (renamed) touch every product of the
    affected orders, found through the order lines by semi joins."""
    parts = []
    if orderline_changes is not None:
        parts.append(orderline_changes.select("product_id"))
    if product_changes is not None:
        parts.append(product_changes.select(F.col("id").alias("product_id")))
    if orderline is not None:
        order_ids = None
        if order_changes is not None:
            order_ids = order_changes.select(F.col("id").alias("order_id"))
        if customer_changes is not None and order is not None:
            moved = order.join(customer_changes.select(F.col("id").alias("customer_id")), "customer_id",
                               "left_semi").select(F.col("id").alias("order_id"))
            order_ids = moved if order_ids is None else order_ids.unionByName(moved)
        if order_ids is not None:
            parts.append(orderline.join(order_ids, "order_id", "left_semi").select("product_id"))
    if not parts:
        raise ValueError("no change source given")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()

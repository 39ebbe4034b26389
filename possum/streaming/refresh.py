"""Streaming upkeep of the order lines and the cached buyer view (CHG1, CHG2, CHG5, CHG7).

The reference keeps ``mv_ProductBuyers`` current with row triggers and ships
changes to replicas through the binary log. Here the order-line change log is
a Structured Streaming source and each micro-batch is applied in
``foreachBatch``:

1. the batch is appended to the order lines (``ChangeTable``);
2. the products it touches are listed as a DataFrame: those of its lines, those
   of earlier lines whose order wasn't there yet, and those whose name in the
   product table isn't the view's;
3. the view is refreshed for these products from the order lines of the same
   products, and published as a new version named by the batch.

Product, customer and order tables are read again for every batch. A replayed
batch is appended again under its name and refreshed only if the view isn't
at its version.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from possum.plans import changes, views
from possum.schemas import ORDERLINE
from possum.sources import sinks
from possum.sources.lease import Lease
from possum.sources.testdata import PosTables
from possum.streaming.change_table import ChangeTable

ORDERLINE_KEY = ["order_id", "product_id"]


class BuyerViewMaintainer:
    """``tables`` gives the current dimension tables whenever it is called.

    A batch that leaves more than ``compact_after`` change folders compacts
    them into the next base. Of replaced versions of the base, the view and the
    waiting lines the ``keep_versions`` newest stay for readers, the others go. With a ``lease`` every batch renews
    it first, and fails once another run took it over."""

    def __init__(self, spark: SparkSession, root: str, tables: Callable[[], PosTables], compact_after: int = 32, keep_versions: int = 2, lease: Lease | None = None):
        self.lease = lease
        self.compact_after, self.keep_versions = compact_after, keep_versions
        self.spark = spark
        self.root = root.rstrip("/")
        self.tables = tables
        self.lines = ChangeTable(spark, f"{self.root}/orderline", ORDERLINE, ORDERLINE_KEY, tie_cols=["quantity"])
        self.view_root = f"{self.root}/product_buyers"
        self.waiting_root = f"{self.root}/waiting"

    def bootstrap(self, orderline: DataFrame, base_seq: int = -1) -> None:
        """Write the starting order lines and the view computed from them.

        Lines meet their orders once, for the view and for the waiting lines."""
        self.lines.bootstrap(orderline, base_seq)
        t = self.tables()
        orders = t.order.select(F.col("id").alias("order_id"), "customer_id", F.lit(True).alias("_placed"))
        lines = self.lines.current().select(*ORDERLINE_KEY).join(orders, "order_id", "left").persist()
        pairs = lines.where("_placed").select("product_id", "customer_id").distinct()
        waiting = lines.where("_placed is null").select(*ORDERLINE_KEY).distinct()
        try:
            self._publish(views.product_buyers_of(t.product, t.customer, pairs), waiting, "base")
        finally:
            lines.unpersist()

    def _without_order(self, lines: DataFrame, t: PosTables) -> DataFrame:
        orders = t.order.select(F.col("id").alias("order_id"))
        return lines.select(*ORDERLINE_KEY).join(orders, "order_id", "left_anti").distinct()

    def _publish(self, view: DataFrame, waiting: DataFrame, version: str) -> None:
        sinks.publish(self.spark, waiting, self.waiting_root, version=version, lease=self.lease)
        sinks.publish(self.spark, view, self.view_root, version=version, lease=self.lease)

    def orderline(self) -> DataFrame:
        return self.lines.current()

    def view(self) -> DataFrame:
        return sinks.read_published(self.spark, self.view_root)

    def version(self) -> str | None:
        return sinks.current_version(self.spark, self.view_root)

    def apply_batch(self, batch: DataFrame, name: str) -> None:
        if self.lease is not None:
            self.lease.check()  # a run that was taken over appends nothing more
        log = self.lines.append(batch, name)
        before = self.version()
        if before == name:
            return
        t, view = self.tables(), self.view()
        waiting = self.spark.read.schema("order_id long, product_id long").parquet(f"{self.waiting_root}/v={before}")
        named = view.select(F.col("productID").alias("id"), F.col("productName").alias("_name"), F.lit(1).alias("_in"))
        renamed = t.product.join(named, "id", "left").where("_in is null or not (name <=> _name)")
        touched = changes.touched_products(orderline_changes=log, product_changes=renamed).union(waiting.select("product_id")).distinct()
        lines = self.lines.current(only=touched)
        fresh = views.refresh_product_buyers(view, touched, t.product, t.customer, t.order, lines)
        self._publish(fresh, self._without_order(waiting.union(log.select(*ORDERLINE_KEY)), t), name)
        self.lines.compact_if(self.compact_after, f"base-{name}", self.keep_versions)
        for root in (self.view_root, self.waiting_root):
            sinks.prune(self.spark, root, self.keep_versions)

    def start(self, log_path: str, trigger: dict | None = None, max_files_per_trigger: int | None = None) -> StreamingQuery:
        """Run the upkeep as a streaming query over parquet change files (see ``ChangeTable.start``)."""
        return self.lines.start(log_path, self.apply_batch, trigger, max_files_per_trigger)


def write_log(log: DataFrame, path: str, n_files: int | None = None) -> None:
    """Write a change log as files of ``seq`` ranges, as many as the data makes
    (or ``n_files``): a stand-in for a change feed landing files over time."""
    ranged = log.repartitionByRange(n_files, "seq") if n_files else log.repartitionByRange("seq")
    ranged.write.mode("append").parquet(path)

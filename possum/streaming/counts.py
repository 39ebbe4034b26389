"""The buyer view kept by counts: a batch reads no order lines (CHG1, CHG2, CHG5, CHG7).

Kept is, for every (product, customer), the number of order lines that join
them. The feed carries row images (``possum.plans.differences``), so each
change adds or takes a line, and only pairs that reach or leave 0 change a
buyer list. A batch

1. adds its differences, summed by pair, as a change folder of its own. Sums
   don't depend on the order of batches, and a replayed batch writes the same
   folder again;
2. compares the counts of its own pairs before and after, and rebuilds the
   lists of the products with a pair that came or went, or with another name,
   from the counts of these products;
3. publishes the view as the version named by the batch, last of all.

Lines whose order isn't known yet wait as differences, and are tried again in
each batch. Beyond ``compact_after`` change folders the counts are summed into
a new base. A base names the folders it holds, so a folder that a failure
leaves behind isn't counted twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from possum.plans import views
from possum.plans.differences import line_differences
from possum.schemas import ORDERLINE_CHANGE
from possum.sources import sinks
from possum.sources.testdata import PosTables

PAIR = ["product_id", "customer_id"]
COUNTS = "product_id long, customer_id long, n long"
WAITING = "order_id long, product_id long, lines long"
IMAGE = T.StructType([T.StructField("quantity", T.IntegerType())])
FEED = T.StructType([*ORDERLINE_CHANGE.fields, T.StructField("before", IMAGE)])


class BuyerCounts:
    """``tables`` gives the current product, customer and order tables whenever it is called."""

    def __init__(self, spark: SparkSession, root: str, tables: Callable[[], PosTables], compact_after: int = 32, keep_versions: int = 2):
        self.spark, self.root, self.tables = spark, root.rstrip("/"), tables
        self.compact_after, self.keep_versions = compact_after, keep_versions
        self.base_root, self.view_root, self.waiting_root = (f"{self.root}/{n}" for n in ("base", "view", "waiting"))

    # --- kept tables

    def _included(self, version: str) -> list[str]:
        return [r["name"] for r in self.spark.read.schema("name string").parquet(f"{self.root}/included/v={version}").collect()]

    def _folders(self) -> list[str]:
        """Change folders that the base doesn't hold."""
        held = set(self._included(sinks.current_version(self.spark, self.base_root)))
        return [n for n in sorted(sinks.folders(self.spark, f"{self.root}/changes")) if n not in held]

    def _publish_base(self, counts: DataFrame, version: str, included: list[str]) -> None:
        names = self.spark.createDataFrame([(n,) for n in included], "name string")
        names.write.mode("overwrite").parquet(f"{self.root}/included/v={version}")
        sinks.publish(self.spark, counts, self.base_root, version=version)

    def sums(self, only: DataFrame | None = None, without: str | None = None) -> DataFrame:
        """(product_id, customer_id, n); below 0 where a line's removal came
        before it. ``only``: rows to cut to, by a semi join before the sum;
        ``without``: a change folder to leave out."""
        rows = sinks.read_published(self.spark, self.base_root, schema=COUNTS)
        names = [n for n in self._folders() if n != without]
        if names:
            rows = rows.unionByName(self.spark.read.schema(COUNTS).parquet(*[f"{self.root}/changes/{n}" for n in names]))
        if only is not None:
            rows = rows.join(only, only.columns, "left_semi")
        return rows.groupBy(*PAIR).agg(F.sum("n").alias("n")).where("n <> 0")

    def counts(self, only: DataFrame | None = None) -> DataFrame:
        """(product_id, customer_id, n): the pairs with a line."""
        return self.sums(only).where("n > 0")

    def view(self) -> DataFrame:
        return sinks.read_published(self.spark, self.view_root)

    def version(self) -> str | None:
        return sinks.current_version(self.spark, self.view_root)

    # --- work

    def _pairs(self, lines: DataFrame, t: PosTables) -> tuple[DataFrame, DataFrame]:
        """Differences by pair, and those whose order isn't there."""
        orders = t.order.select(F.col("id").alias("order_id"), "customer_id")
        pairs = lines.join(orders, "order_id").groupBy(*PAIR).agg(F.sum("lines").alias("n")).where("n <> 0")
        return pairs, lines.join(orders, "order_id", "left_anti").groupBy("order_id", "product_id").agg(F.sum("lines").alias("lines")).where("lines <> 0")

    def bootstrap(self, orderline: DataFrame) -> None:
        """The counts, the waiting lines and the view of the starting order lines."""
        t = self.tables()
        pairs, waiting = self._pairs(orderline.select("order_id", "product_id", F.lit(1).cast("long").alias("lines")), t)
        self._publish_base(pairs, "base", [])
        sinks.publish(self.spark, waiting, self.waiting_root, version="base")
        products = t.product.select(F.col("id").alias("product_id"))
        sinks.publish(self.spark, self._lists(products, t), self.view_root, version="base")

    def _lists(self, products: DataFrame, t: PosTables) -> DataFrame:
        """The view's rows for some products, from the counts."""
        lists = views.buyer_strings(self.counts(only=products).select(*PAIR), t.customer)
        p = t.product.select(F.col("id").alias("product_id"), F.col("name").alias("productName")).join(products, "product_id", "left_semi")
        return p.join(lists, "product_id", "left").select(F.col("product_id").alias("productID"), "productName", "customers")

    def touched(self, delta: DataFrame, name: str, t: PosTables) -> DataFrame:
        """Products with a pair that came or went in folder ``name``, and those new, gone or renamed."""
        then = self.sums(only=delta.select(*PAIR), without=name).withColumnRenamed("n", "then")
        both = delta.join(then, PAIR, "left").select("product_id", F.coalesce("then", F.lit(0)).alias("then"), "n")
        crossed = both.where("(then > 0) <> (then + n > 0)").select("product_id")
        named = self.view().select(F.col("productID").alias("id"), F.col("productName").alias("_name"), F.lit(1).alias("_in"))
        other = t.product.select("id", "name", F.lit(1).alias("_is")).join(named, "id", "full_outer")
        other = other.where("_in is null or _is is null or not (name <=> _name)").select(F.col("id").alias("product_id"))
        return crossed.union(other).distinct()

    def apply_batch(self, batch: DataFrame, name: str) -> None:
        before = self.version()
        if before == name:
            return
        t = self.tables()
        waiting = self.spark.read.schema(WAITING).parquet(f"{self.waiting_root}/v={before}")
        lines = line_differences(batch).select("order_id", "product_id", "lines").unionByName(waiting)
        pairs, still = self._pairs(lines, t)
        path = f"{self.root}/changes/{name}"
        pairs.write.mode("overwrite").parquet(path)
        sinks.publish(self.spark, still, self.waiting_root, version=name)
        touched = self.touched(self.spark.read.schema(COUNTS).parquet(path), name, t)
        kept = self.view().join(touched.withColumnRenamed("product_id", "productID"), "productID", "left_anti")
        sinks.publish(self.spark, kept.unionByName(self._lists(touched, t)), self.view_root, version=name)
        self._tidy(name)

    def _tidy(self, name: str) -> None:
        names = self._folders()
        if len(names) > self.compact_after:
            # folders of earlier bases are named on, should a failure have left them
            left = sorted(sinks.folders(self.spark, f"{self.root}/changes"))
            self._publish_base(self.sums(), f"base-{name}", left)
            for n in left:
                sinks.remove(self.spark, f"{self.root}/changes/{n}")
            sinks.prune(self.spark, self.base_root, self.keep_versions)
        for root in (self.view_root, self.waiting_root):
            sinks.prune(self.spark, root, self.keep_versions)

    def start(self, log_path: str, trigger: dict | None = None, max_files_per_trigger: int | None = None) -> StreamingQuery:
        """Follow Parquet files of the feed; see ``ChangeTable.start`` for the trigger."""
        reader = self.spark.readStream.schema(FEED)
        if max_files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)

        def each(batch: DataFrame, batch_id: int) -> None:
            query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
            self.apply_batch(batch, f"{query}-{batch_id}")

        writer = reader.parquet(log_path).writeStream.foreachBatch(each).option("checkpointLocation", f"{self.root}/_stream_checkpoint")
        return writer.trigger(**(trigger or {"availableNow": True})).start()

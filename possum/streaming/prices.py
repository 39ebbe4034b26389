"""Price history from a stream of price changes in any order (CHG3, CHG5).

A history row says what a product's price was before a change. In a stream a
change may arrive after later ones: it then lies between two known changes,
its own row takes the price of the one before, and the row of the one after
must be written again. So each batch

1. appends its changes to the log;
2. takes the previous change of every logged change of the batch's products;
3. appends a link for every batch row and every row that now follows a batch
   row: the change, the place of the change before it, and that one's price.

A change's true predecessor is the latest one before it, and more data can
only move it closer. So of all links of a change the one with the latest
predecessor holds, whatever order the batches came in, and a replayed batch
adds nothing new.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from possum.operators.sequence import previous_in_ranges, range_cols, with_ranges
from possum.schemas import PRICE, PRODUCT_CHANGE
from possum.sources import sinks

LOG = T.StructType([T.StructField("product_id", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("newPrice", PRICE),
                    T.StructField("ts", T.TimestampNTZType())])
FEW_PRODUCTS = 1 << 19
LINK = T.StructType([*LOG.fields, T.StructField("prev_seq", T.LongType()), T.StructField("oldPrice", PRICE)])


class PriceHistoryStream:
    """``product``: the table before the log, whose price comes before a
    product's first change. Several changes of one product at one ``seq`` are
    one, by the largest price (null only if all are). ``bucket_width``: the
    range of ``seq`` that is one task's share of a product with many changes."""

    def __init__(self, spark: SparkSession, root: str, product: DataFrame, bucket_width: int, compact_after: int = 32):
        self.spark, self.root, self.product = spark, root.rstrip("/"), product
        self.bucket_width, self.compact_after = bucket_width, compact_after

    def _read(self, name: str, schema: T.StructType, without: str | None = None) -> DataFrame:
        names = [n for n in sorted(sinks.folders(self.spark, f"{self.root}/{name}")) if n != without]
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{name}/{n}" for n in names])

    def apply_batch(self, batch: DataFrame, name: str) -> None:
        changes = batch.select(F.col("id").alias("product_id"), "seq", F.col("currentPrice").alias("newPrice"), F.col("ts").cast("timestamp_ntz").alias("ts"))
        changes.where("product_id is not null and seq is not null").write.mode("overwrite").parquet(f"{self.root}/log/{name}")
        new = self.spark.read.schema(LOG).parquet(f"{self.root}/log/{name}")
        earlier = self._read("log", LOG, without=name)
        products = new.select("product_id").distinct()
        # links come of the batch's products alone; cutting the log to them pays where they are few enough to broadcast
        if products.limit(FEW_PRODUCTS + 1).count() <= FEW_PRODUCTS:
            earlier = earlier.join(F.broadcast(products), "product_id", "left_semi")
        rows = earlier.withColumn("_new", F.lit(False)).unionByName(new.withColumn("_new", F.lit(True)))
        ranged = with_ranges(rows, ["product_id"], "seq", self.bucket_width)
        # the rows move once: grouping to one change a (product, seq) and the window below find them where they are
        parts = range_cols(ranged, ["product_id"])
        known = ranged.repartition(*parts).groupBy(*parts, "seq").agg(F.max(F.struct("newPrice", "ts")).alias("_c"), F.max("_new").alias("_new"))
        here = known.select(*parts, "seq", "_c.newPrice", "_c.ts", "_new", F.struct("seq", "_c.newPrice", "_new").alias("_at"))
        linked = previous_in_ranges(here, ["product_id"], "seq", "_at").where(F.col("_new") | F.coalesce("prev._new", F.lit(False)))
        links = linked.select("product_id", "seq", "newPrice", "ts", F.col("prev.seq").alias("prev_seq"), F.col("prev.newPrice").alias("oldPrice"))
        links.write.mode("overwrite").parquet(f"{self.root}/links/{name}")
        if len(sinks.folders(self.spark, f"{self.root}/links")) > self.compact_after:
            self._compact(name)

    def _links(self) -> DataFrame:
        """The link that holds for every change: the latest predecessor, of prices at one place the larger."""
        order = F.struct(F.coalesce("prev_seq", F.lit(-(1 << 63))), "newPrice", "oldPrice")
        last = self._read("links", LINK).groupBy("product_id", "seq").agg(F.max_by(F.struct(*LINK.fieldNames()[2:]), order).alias("_l"))
        return last.select("product_id", "seq", "_l.*")

    def _compact(self, name: str) -> None:
        """Links and log in one folder each. The new folder is complete before the others go, and rows that are there twice count once."""
        for part, rows, schema in (("links", self._links(), LINK), ("log", self._read("log", LOG).distinct(), LOG)):
            old = sinks.folders(self.spark, f"{self.root}/{part}")
            rows.select(*schema.fieldNames()).write.parquet(f"{self.root}/{part}/all-{name}-{uuid.uuid4().hex}")
            for n in old:
                sinks.remove(self.spark, f"{self.root}/{part}/{n}")

    def history(self) -> DataFrame:
        """(product_id, seq, oldPrice, newPrice, ts) as ``changes.price_history_changes`` gives it for the whole log."""
        base = self.product.select(F.col("id").alias("product_id"), F.col("currentPrice").alias("_base"))
        old = F.when(F.col("prev_seq").isNotNull(), F.col("oldPrice")).otherwise(F.col("_base"))
        return self._links().join(base, "product_id", "left").select("product_id", "seq", old.alias("oldPrice"), "newPrice", "ts").where(
            F.col("oldPrice") != F.col("newPrice"))

    def start(self, log_path: str, trigger: dict | None = None, max_files_per_trigger: int | None = None) -> StreamingQuery:
        """Follow Parquet files of price changes; see ``ChangeTable.start`` for the trigger."""
        reader = self.spark.readStream.schema(T.StructType([f if f.name != "ts" else T.StructField("ts", T.TimestampNTZType()) for f in PRODUCT_CHANGE.fields]))
        if max_files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)

        def each(batch: DataFrame, batch_id: int) -> None:
            query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
            self.apply_batch(batch, f"{query}-{batch_id}")

        writer = reader.parquet(log_path).writeStream.foreachBatch(each).option("checkpointLocation", f"{self.root}/_stream_checkpoint")
        return writer.trigger(**(trigger or {"availableNow": True})).start()

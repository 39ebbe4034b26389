"""A table kept from its change log: a published base and appended change folders (CHG4 inside CHG5).

Every micro-batch is appended as a folder of its own, named by query and
batch, and nothing written before is touched; on read the change with the
highest ``seq`` per key wins and deletes hide their key. So batches may arrive
in any order, a replayed batch writes the same folder again, and a new stream
checkpoint (whose batch numbers begin anew) gets other names. ``compact``
publishes base and changes as the next base.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from possum.plans import changes
from possum.sources import sinks
from possum.sources.sinks import folders, remove


class ChangeTable:
    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, key_cols: Sequence[str],
                 tie_cols: Sequence[str] = ()):
        self.spark = spark
        self.root = root.rstrip("/")
        self.schema = schema
        self.key_cols = list(key_cols)
        self.tie_cols = list(tie_cols)
        self.log_schema = T.StructType(
            [T.StructField("seq", T.LongType()), T.StructField("op", T.StringType())] + list(schema.fields))

    def exists(self) -> bool:
        return sinks.current_version(self.spark, f"{self.root}/base") is not None

    def bootstrap(self, snapshot: DataFrame, base_seq: int = -1, version: str = "base") -> None:
        rows = snapshot.select(F.lit(base_seq).cast("long").alias("seq"), F.lit("I").alias("op"),
                               *self.schema.fieldNames())
        sinks.publish(self.spark, rows, f"{self.root}/base", version=version)

    def append(self, log: DataFrame, name: str) -> DataFrame:
        """The batch written as folder ``name``, and read back from it."""
        path = f"{self.root}/changes/{name}"
        log.select(*self.log_schema.fieldNames()).write.mode("overwrite").parquet(path)
        return self.spark.read.schema(self.log_schema).parquet(path)

    def rows(self) -> DataFrame:
        """Base and all changes, one row each."""
        out = sinks.read_published(self.spark, f"{self.root}/base", schema=self.log_schema)
        names = sorted(folders(self.spark, f"{self.root}/changes"))
        if names:
            paths = [f"{self.root}/changes/{n}" for n in names]
            out = out.unionByName(self.spark.read.schema(self.log_schema).parquet(*paths))
        return out

    def state(self, only: DataFrame | None = None) -> DataFrame:
        """The last change per key, deletes included. ``only``: rows to cut to, by
        a semi join on its columns (part of the key) before anything is aggregated.
        The base holds a key once, so without change folders it is the state."""
        rows = self.rows() if only is None else self.rows().join(only, only.columns, "left_semi")
        if not folders(self.spark, f"{self.root}/changes"):
            return rows.select(*self.log_schema.fieldNames())
        return changes.latest_changes(rows, self.key_cols, tie_cols=self.tie_cols).select(*self.log_schema.fieldNames())

    def current(self, only: DataFrame | None = None) -> DataFrame:
        """The table after all changes."""
        return self.state(only).where(F.col("op") != F.lit(changes.DELETE)).select(*self.schema.fieldNames())

    def compact_if(self, folders_at_most: int, version: str, keep_versions: int) -> bool:
        """Compact if there are more change folders than that; older base versions but ``keep_versions`` go."""
        if len(folders(self.spark, f"{self.root}/changes")) <= folders_at_most:
            return False
        self.compact(version)
        sinks.prune(self.spark, f"{self.root}/base", keep_versions)
        return True

    def compact(self, version: str, drop_deletes_before: int | None = None) -> None:
        """Publish the state as base ``version``, then remove the change folders it holds.

        A change folder that a failure leaves behind is harmless: its changes
        win or lose by ``seq`` as before. Deletes older than
        ``drop_deletes_before`` are forgotten."""
        names = folders(self.spark, f"{self.root}/changes")
        state = self.state()
        if drop_deletes_before is not None:
            state = state.where((F.col("op") != F.lit(changes.DELETE)) | (F.col("seq") >= F.lit(drop_deletes_before)))
        sinks.publish(self.spark, state, f"{self.root}/base", version=version)
        for n in names:
            remove(self.spark, f"{self.root}/changes/{n}")

    def start(self, log_path: str, on_batch: Callable[[DataFrame, str], object] | None = None,
              trigger: dict | None = None, max_files_per_trigger: int | None = None) -> StreamingQuery:
        """Follow parquet change files as a streaming query.

        ``on_batch(batch, name)`` defaults to ``append``. ``trigger``: default
        ``availableNow`` (drain and stop, for any scheduler);
        ``{"processingTime": "15 minutes"}`` runs on the reference's cadence
        (CHG7). A batch takes all files that are there unless
        ``max_files_per_trigger`` bounds it. A query never overlaps itself."""
        handler = on_batch or self.append
        reader = self.spark.readStream.schema(self.log_schema)
        if max_files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)

        def each(batch: DataFrame, batch_id: int) -> None:
            query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
            handler(batch, f"{query}-{batch_id}")

        writer = reader.parquet(log_path).writeStream.foreachBatch(each).option(
            "checkpointLocation", f"{self.root}/_stream_checkpoint")
        return writer.trigger(**(trigger or {"availableNow": True})).start()

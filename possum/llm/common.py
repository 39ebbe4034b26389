"""Shared helpers: table access, tables written to the shared folder, result keys."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from possum.session import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Tables written as Parquet under ``spark.checkpoint.dir`` to cut lineage.

    A written table survives lost executors. ``drop`` removes a table that a
    later one has replaced; what the returned DataFrame still reads stays.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.made = 0

    def write(self, df: DataFrame) -> str:
        path = f"{self.root}/t{self.made}"
        self.made += 1
        df.write.parquet(path)
        return path

    def save(self, df: DataFrame) -> DataFrame:
        """``df``, computed once."""
        return self.spark.read.schema(df.schema).parquet(self.write(df))

    def drop(self, path: str) -> None:
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)


def doc_key(id_col: Column, text: Column) -> list[Column]:
    """Two columns that tell documents apart even where ids are null or repeat.

    Rows that agree in both have the same id and the same text, and so the
    same result in every operator that uses them.
    """
    return [F.coalesce(id_col.cast("long"), F.lit(0).cast("long")).alias("k_id"), F.xxhash64(id_col.isNull(), text).alias("k_text")]


def packed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, k_id, k_text): whole rows in one column, so that no name of theirs meets a name of ours."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), *doc_key(F.col(id_col), F.col(text_col)))


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors' Python this package, once for each application.

    Spark copies the archive from the driver to every executor.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="possum-ship-"), "possum.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(top)))
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)

"""Database objects: rebuild, typed tables, views, the cached view (DDL1-DDL7, SNK6, SNK7, F22).

Parquet tables in the session catalog play the reference's row-store tables. Keys
are not enforced by the format; ``possum.operators.checks`` checks them.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from possum.operators.collect import PARTS
from possum.sources import sinks

# Spark SQL text of ``v_ProductBuyers`` over tables named Customer, `Order`,
# Orderline and Product (QRY1 for users who keep writing SQL). The pairs of ids
# are made distinct before names join; the list is built in two levels like
# the DataFrame version.
PRODUCT_BUYERS_VIEW_SQL = """
WITH pairs AS (
  SELECT DISTINCT OL.product_id, O.customer_id
  FROM {db}.Orderline OL JOIN {db}.`Order` O ON OL.order_id = O.id
), parts AS (
  SELECT product_id, array_sort(collect_list(named_struct('k', C.id, 'v', concat(C.id, ' ', C.firstName, ' ', C.lastName)))) AS part
  FROM pairs JOIN {db}.Customer C ON C.id = pairs.customer_id
  GROUP BY product_id, pmod(xxhash64(C.id), {parts})
), lists AS (
  SELECT product_id, nullif(array_join(transform(filter(array_sort(flatten(collect_list(part))), x -> x.v IS NOT NULL), x -> x.v), ','), '') AS customers
  FROM parts GROUP BY product_id
)
SELECT P.id AS productID, P.name AS productName, L.customers
FROM {db}.Product P LEFT JOIN lists L ON L.product_id = P.id
"""


def rebuild_database(spark: SparkSession, name: str) -> None:
    """DDL1: drop the database with everything in it and create it empty.
    Only for a database this build owns."""
    spark.sql(f"DROP DATABASE IF EXISTS `{name}` CASCADE")
    spark.sql(f"CREATE DATABASE `{name}`")


def save_table(df: DataFrame, name: str, mode: str = "overwrite", bucket_by: str | None = None,
               buckets: int = 0) -> None:
    """SNK7 (``mode='overwrite'``) or SNK6 (``mode='ignore'``: CREATE TABLE IF
    NOT EXISTS ... AS SELECT). Columns are written by name, not by position.
    ``bucket_by`` stores the table bucketed and sorted on a key, so lookups by
    that key read one bucket and joins on it need no shuffle (DDL6)."""
    writer = df.write.mode(mode).format("parquet")
    if bucket_by:
        writer = writer.bucketBy(buckets, bucket_by).sortBy(bucket_by)
    writer.saveAsTable(name)


def save_tables(spark: SparkSession, db: str, tables: dict[str, DataFrame], mode: str = "overwrite") -> None:
    for name, df in tables.items():
        save_table(df, f"`{db}`.`{name}`", mode)


def create_product_buyers_view(spark: SparkSession, db: str) -> DataFrame:
    """DDL3: CREATE OR REPLACE VIEW v_ProductBuyers over the catalog tables."""
    sql = PRODUCT_BUYERS_VIEW_SQL.format(db=db, parts=PARTS)
    spark.sql(f"CREATE OR REPLACE VIEW `{db}`.v_ProductBuyers AS {sql}")
    return spark.table(f"`{db}`.v_ProductBuyers")


def cache_view(spark: SparkSession, db: str, buckets: int = 16) -> None:
    """The cached copy ``mv_ProductBuyers`` (SNK6, IF NOT EXISTS) with its
    "index" on productID as bucketing plus sort (DDL6)."""
    save_table(spark.table(f"`{db}`.v_ProductBuyers"), f"`{db}`.mv_ProductBuyers", mode="ignore",
               bucket_by="productID", buckets=buckets)


LOOKUP_FILE_BYTES = 256 << 20
LOOKUP_GROUP_BYTES = 8 << 20
BLOOM_BYTES = 1 << 20  # largest filter of a row group


def write_lookup(df: DataFrame, key: str, path: str, file_bytes: int = LOOKUP_FILE_BYTES, group_bytes: int = LOOKUP_GROUP_BYTES) -> None:
    """DDL6: ``df`` as Parquet under ``path`` (replaced) for point lookups by ``key``.

    Files hold ranges of the key, sorted, in row groups of about
    ``group_bytes``, so their minima and maxima leave one group for a key; a
    Bloom filter a group leaves none for most keys that don't exist. ``df`` is
    written once and measured, and the number of files and the size of the
    filters follow from its rows and bytes. A null key sorts first and is never
    found by equality; rows with equal keys lie side by side.
    """
    spark = df.sparkSession
    stage = f"{path.rstrip('/')}.stage-{uuid.uuid4().hex}"
    df.write.parquet(stage)
    rows, size = spark.read.parquet(stage), sinks.byte_size(spark, stage)
    n = rows.count()
    in_group = max(1, math.ceil(n * group_bytes / max(size, 1)))
    (rows.repartitionByRange(max(1, math.ceil(size / file_bytes)), F.col(key)).sortWithinPartitions(key)
     .write.mode("overwrite")
     .option("parquet.block.size", str(group_bytes))
     .option("parquet.page.size.row.check.min", str(max(1, min(100, in_group // 2))))
     .option("parquet.block.size.row.check.min", str(max(1, min(100, in_group // 2))))
     .option(f"parquet.bloom.filter.enabled#{key}", "true")
     .option(f"parquet.bloom.filter.expected.ndv#{key}", str(min(n, in_group) or 1))
     .option("parquet.bloom.filter.max.bytes", str(BLOOM_BYTES))
     .option(f"parquet.enable.dictionary#{key}", "false")  # a filter is written only beside plain values
     .parquet(path))
    sinks.remove(spark, stage)


def show_create(spark: SparkSession, name: str) -> str:
    """DDL7: the statement that defines a table or view."""
    return spark.sql(f"SHOW CREATE TABLE {name}").first()[0]


def show_tables(spark: SparkSession, db: str) -> DataFrame:
    """DDL7: SHOW TABLES."""
    return spark.sql(f"SHOW TABLES IN `{db}`")


def sample(df: DataFrame, n: int = 5) -> DataFrame:
    """LIM2: a few rows to look at (``LIMIT 5``)."""
    return df.limit(n)


def current_user(spark: SparkSession) -> str:
    """the user the session runs as."""
    return spark.range(1).select(F.current_user()).first()[0]

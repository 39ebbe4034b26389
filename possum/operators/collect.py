"""Nested arrays and ordered string aggregates (AG7-AG10, AG15), one row per key.

A document array (a product's buyers, a customer's orders, a zip's products)
is one value of one row, as in the reference, however large its group is. Each
task first collects its own rows of a key, so a key that holds a third of the
rows reaches its task as a few lists, one from each, which are put together
and sorted there; the elements move once. ``spread`` builds the array in two
levels: first per (key, hash of the element's key), sorted by ``PARTS`` tasks a
key, then the sorted parts are merged per key. Where all groups are large (a few
zips or months hold all rows), ``collect_sorted`` moves rows once and sorts them as rows.
``collect_pieces`` leaves an array in pieces, one row each: as JSON text
(``possum.sources.sinks``) a document is then put together from the texts of
its pieces, and no task holds its elements as rows.

For keys too large for one row the flat element tables stay the way to work:
``views.buyer_pairs``, ``documents.order_totals`` and the fact tables.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARTS = 32
PIECE = "_piece"  # number of a piece of an array, ascending in the array's order
PIECE_BITS = 12  # a piece holds the keys that agree in all but their last 12 bits


def collect_in_order(base: DataFrame, elements: DataFrame, key: str, value: Column, name: str) -> DataFrame:
    """``base`` with ``name``, the values of its key in the values' own order (the
    array of a left join; empty where a key has none), by ranges of ``key``.

    Rows of both move once, to the task that has the range of their key: arrays
    don't move, for no join and not for ``orderBy(key)``, which these ranges serve."""
    cols = [c for c in base.columns if c != key]
    rows = base.select(key, F.struct(*cols).alias("_row"), F.lit(None).alias("_value")).unionByName(
        elements.where(F.col(key).isNotNull()).select(key, F.lit(None).alias("_row"), value.alias("_value")))
    whole = rows.repartitionByRange(key).groupBy(key).agg(
        F.collect_list("_row").alias("_rows"), F.sort_array(F.collect_list("_value")).alias(name))
    return whole.select(key, F.explode("_rows").alias("_row"), name).select(key, *[F.col("_row")[c].alias(c) for c in cols], name)


def collect_arrays(elements: DataFrame, group_cols: Sequence[str], sort_key: Column | str, value: Column, name: str,
                   sums: Mapping[str, Column] | None = None, spread: bool = False) -> DataFrame:
    """One row per group: ``name``, the group's values ordered by ``sort_key``,
    and the named ``sums``. Duplicates stay (AG9), null values are dropped; the
    order fixes what the reference leaves open (Q5)."""
    key = F.col(sort_key) if isinstance(sort_key, str) else sort_key
    pair = F.when(value.isNotNull(), F.struct(key.alias("k"), value.alias("v")))
    sums = dict(sums or {})
    # sort_array compares as array_sort does (no element is null), without calling a lambda for each pair
    parts = elements.withColumn("_part", F.pmod(F.xxhash64(key), F.lit(PARTS))) if spread else elements
    whole = parts.groupBy(*group_cols, *(["_part"] if spread else [])).agg(
        F.sort_array(F.collect_list(pair)).alias("_pairs"), *(F.sum(c).alias(n) for n, c in sums.items()))
    if spread:
        whole = whole.groupBy(*group_cols).agg(
            F.sort_array(F.flatten(F.collect_list("_pairs"))).alias("_pairs"), *(F.sum(n).alias(n) for n in sums))
    return whole.select(*group_cols, F.col("_pairs.v").alias(name), *sums)


def collect_sorted(elements: DataFrame, group_cols: Sequence[str], sort_cols: Sequence[str], value: Column, name: str) -> DataFrame:
    """``collect_arrays`` for a few large groups: the rows of a group move once, to
    the task that writes its row, and are sorted there as rows, on disk if need
    be. ``sort_array`` then meets sorted elements and compares each once."""
    pair = F.when(value.isNotNull(), F.struct(F.struct(*sort_cols).alias("k"), value.alias("v")))
    rows = elements.repartition(*group_cols).sortWithinPartitions(*group_cols, *sort_cols)
    whole = rows.groupBy(*group_cols).agg(F.sort_array(F.collect_list(pair)).alias("_pairs"))
    return whole.select(*group_cols, F.col("_pairs.v").alias(name))


def collect_pieces(elements: DataFrame, group_cols: Sequence[str], sort_key: str, value: Column, name: str) -> DataFrame:
    """``collect_arrays`` in pieces: one row per group and ``PIECE``, its array in
    order. ``sort_key`` is a whole number; a piece is a range of 4,096 of them, so
    where a group has each key once a piece has no more elements than that.

    Rows move once, and as many partitions as the session's shuffles have are
    kept, so that a task has no more than its share of the pieces."""
    n = int(elements.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*group_cols, PIECE]
    rows = elements.withColumn(PIECE, F.shiftright(F.col(sort_key).cast("long"), PIECE_BITS)).repartition(n, *keys)
    return collect_arrays(rows, keys, sort_key, value, name)


def collect_text(elements: DataFrame, group_cols: Sequence[str], sort_key: str, text: Column, name: str,
                 sep: str = ",") -> DataFrame:
    """``GROUP_CONCAT(text ORDER BY sort_key SEPARATOR sep)`` per group. Null texts
    are skipped; a group without any text gives null, not '' (AG15)."""
    lists = collect_arrays(elements, group_cols, sort_key, text, name)
    return lists.withColumn(name, F.nullif(F.array_join(name, sep), F.lit("")))

"""Constraint and copy checks (CHK1-CHK3, DDL4, JN8, Q16).

Parquet tables enforce neither primary nor foreign keys, so the declared keys
of the POS schema are checked by jobs. Every check returns a DataFrame of
violations (empty when the data is clean); nothing is collected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _key_text(cols: Sequence[str]) -> Column:
    return F.concat_ws("|", *[F.col(c).cast("string") for c in cols])


TASK_KEYS = 1 << 19  # keys that one task counts


def pk_violations(df: DataFrame, key_cols: Sequence[str], table: str, rows: int | None = None) -> DataFrame:
    """CHK1: (table, kind, key, n). ``duplicate``: a key held by n > 1 rows;
    ``null key``: n rows with a null in a key column (key is empty).

    Keys are counted in memory, and nearly all are there once, so a task takes
    ``TASK_KEYS`` of them whatever the table's size. ``rows``: how many rows
    the table has at most, counted here by default. A table of one task's keys
    is a partial aggregate: a repeated key is counted map-side first."""
    keys = list(key_cols)
    any_null = F.lit(False)
    for c in keys:
        any_null = any_null | F.col(c).isNull()
    counted = df.select(*keys).withColumn("_null", any_null)
    tasks = -(-(df.count() if rows is None else rows) // TASK_KEYS)
    known = counted.where(~F.col("_null"))
    dups = ((known.repartition(tasks, *keys) if tasks > 1 else known).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") > 1)
            .select(F.lit(table).alias("table"), F.lit("duplicate").alias("kind"),
                    _key_text(keys).alias("key"), F.col("n")))
    nulls = (counted.where(F.col("_null")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 0)
             .select(F.lit(table).alias("table"), F.lit("null key").alias("kind"),
                     F.lit("").alias("key"), F.col("n")))
    return dups.unionByName(nulls)


def fk_violations(child: DataFrame, child_cols: Sequence[str], parent: DataFrame,
                  parent_cols: Sequence[str], constraint: str) -> DataFrame:
    """CHK2 / JN8: (constraint, key, n) for child keys with no parent row.

    A left anti join (it never repeats a child row, so the parent keys need no
    de-duplication); child rows with a null key are not violations (SQL
    foreign keys ignore them). Rows are counted per missing key."""
    ccols, pcols = list(child_cols), list(parent_cols)
    renamed = parent.select(*[F.col(p).alias(c) for p, c in zip(pcols, ccols)])
    nonnull = child.select(*ccols)
    for c in ccols:
        nonnull = nonnull.where(F.col(c).isNotNull())
    missing = nonnull.join(renamed, ccols, "left_anti")
    return missing.groupBy(*ccols).agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(constraint).alias("constraint"), _key_text(ccols).alias("key"), F.col("n"))


def length_violations(df: DataFrame, max_len: dict[str, int], table: str, key_cols: Sequence[str]) -> DataFrame:
    """Q16: (table, column, key, length, max) for text longer than declared."""
    parts = []
    for col, limit in max_len.items():
        if col not in df.columns:
            continue
        parts.append(df.where(F.length(col) > F.lit(limit)).select(
            F.lit(table).alias("table"), F.lit(col).alias("column"), _key_text(key_cols).alias("key"),
            F.length(col).alias("length"), F.lit(limit).alias("max")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def table_diff(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """CHK3: rows of ``expected`` missing from ``actual`` (side ``missing``) and
    rows of ``actual`` not in ``expected`` (side ``extra``), duplicates counted.
    Both empty means the copy agrees. One aggregate over signed counts, so each
    table is read once and equal rows are combined map-side."""
    cols = expected.columns
    signed = expected.select(*cols, F.lit(1).alias("_n")).unionByName(actual.select(*cols, F.lit(-1).alias("_n")))
    odd = signed.groupBy(*cols).agg(F.sum("_n").alias("_n")).where("_n <> 0")
    side = F.when(F.col("_n") > 0, F.lit("missing")).otherwise(F.lit("extra"))
    each = F.explode(F.array_repeat(side, F.abs("_n").cast("int"))).alias("side")
    return odd.select(*cols, each)


def count_check(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """CHK3, first step: (side, rows) for both tables (two partial aggregates)."""
    a = expected.agg(F.count(F.lit(1)).alias("rows")).select(F.lit("expected").alias("side"), "rows")
    b = actual.agg(F.count(F.lit(1)).alias("rows")).select(F.lit("actual").alias("side"), "rows")
    return a.unionByName(b)

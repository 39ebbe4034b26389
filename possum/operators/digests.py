"""Comparison of two copies of a table by digests (CHK3).

Every row has a 128-bit digest, and every bucket of rows the exact sum of the
digests of its rows, which doesn't depend on their order. Buckets are the
prefixes of the row's hexadecimal digest, so they form a tree: a copy computes
its own tree next to its data, and two copies exchange trees instead of rows.
The comparison descends from the root only into nodes that differ, and only
rows of leaves that differ are compared one by one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from possum.operators.checks import table_diff

FANOUT = 16  # a hexadecimal digit of the digest a level
ROWS_PER_LEAF = 10_000
DEEPEST = 7
TREE = ("level", "node", "n", "hi", "lo")


def _value(field: T.StructField) -> Column:
    """The value as text; different values of a type have different texts."""
    col = F.col(f"`{field.name}`")
    if isinstance(field.dataType, T.BinaryType):
        return F.hex(col)
    if isinstance(field.dataType, T.ArrayType | T.StructType):
        precise = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
        return F.to_json(F.struct(col.alias("v")), precise)
    return col.cast("string")


def row_digest(df: DataFrame) -> Column:
    """MD5 of all columns: each as its length and text, a null as a sign of its own."""
    parts = [F.coalesce(F.concat(F.length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in map(_value, df.schema.fields)]
    return F.md5(F.concat(*parts).cast("binary"))


def leaf_depth(rows: int, rows_per_leaf: int = ROWS_PER_LEAF) -> int:
    """Levels below the root for about ``rows_per_leaf`` rows a leaf."""
    depth = 0
    while depth < DEEPEST and rows > rows_per_leaf * FANOUT**depth:
        depth += 1
    return depth


def digest_tree(df: DataFrame, depth: int) -> DataFrame:
    """(level, node, n, hi, lo): rows and sum of digests of every node down to ``depth`` digits.

    The leaves are partial sums of one pass over the table; the levels above
    are summed from the leaves."""
    half = lambda at: F.conv(F.substring("d", at, 16), 16, 10).cast("decimal(20,0)")
    rows = df.select(row_digest(df).alias("d"))
    sums = [F.sum(c).cast("decimal(38,0)").alias(c) for c in ("hi", "lo")]
    leaves = rows.select(F.substring("d", 1, depth).alias("node"), half(1).alias("hi"), half(17).alias("lo")).groupBy("node").agg(F.count(F.lit(1)).alias("n"), *sums)
    each = leaves.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(depth))))
    return each.select("level", F.expr("substring(node, 1, level)").alias("node"), "n", "hi", "lo").groupBy("level", "node").agg(F.sum("n").alias("n"), *sums).select(*TREE)


def differing_leaves(expected: DataFrame, actual: DataFrame, depth: int) -> DataFrame:
    """(node) of the leaves whose digests differ; both trees have ``depth`` levels below the root.

    A level is read for the children of nodes that differ. A node that only
    one copy has differs."""
    signed = expected.select(*TREE).unionByName(actual.select("level", "node", *[(-F.col(c)).alias(c) for c in ("n", "hi", "lo")]))
    differ = reduce(lambda a, b: a | b, [F.sum(c) != 0 for c in ("n", "hi", "lo")])
    found = None
    for level in range(depth + 1):
        nodes = signed.where(F.col("level") == level)
        if found is not None:
            nodes = nodes.withColumn("up", F.substring("node", 1, level - 1)).join(found.withColumnRenamed("node", "up"), "up", "left_semi")
        found = nodes.groupBy("node").agg(differ.alias("differ")).where("differ").select("node")
    return found


def table_diff_digests(expected: DataFrame, actual: DataFrame, depth: int, trees: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """``table_diff`` (rows and ``side``), rows compared only in leaves that differ.

    ``trees`` are the stored ``digest_tree`` of both copies; without them both
    are computed here. Columns of ``actual`` are taken in the order and with
    the types of ``expected``. Copies with equal trees give an empty result and
    no row is read. Two different leaves have equal digests with a probability
    of about 2^-128. Null, repeated and missing rows count as in ``table_diff``;
    maps can't be compared.
    """
    actual = actual.select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in expected.schema.fields])
    mine, other = trees or (digest_tree(expected, depth), digest_tree(actual, depth))
    leaves = differing_leaves(mine, other, depth)
    if leaves.isEmpty():
        return expected.sparkSession.createDataFrame([], T.StructType([*expected.schema.fields, T.StructField("side", T.StringType())]))

    def inside(df: DataFrame) -> DataFrame:
        node = F.substring(row_digest(df), 1, depth).alias("_node")
        return df.select("*", node).join(leaves.withColumnRenamed("node", "_node"), "_node", "left_semi").drop("_node")

    return table_diff(inside(expected), inside(actual))

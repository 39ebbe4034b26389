"""Connected components of a link table, as repeated joins and minima.

Alternating large-star and small-star rounds (Kiveris et al., "Connected
Components in MapReduce and Beyond", 2014). Every round is two aggregates and
two joins over a table that never grows; no link, node or component leaves the
executors. A node with very many links only meets partial minima: those are
written before they are joined, so both sides of a join come straight from a
shuffle and adaptive execution can split the node's partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from possum.llm.common import Scratch


def _large_star(edges: DataFrame, scratch: Scratch) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = scratch.save(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")))
    return both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame, scratch: Scratch) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = scratch.save(down.groupBy("a").agg(F.min("b").alias("m")))
    moved = down.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """(a, b) links of longs -> (node, root): every linked node with the smallest node it reaches.

    Self links and repeated links are ignored; nodes without links do not
    appear; an empty link table gives an empty result.
    """
    spark = edges.sparkSession
    links = edges.where("a <> b and a is not null and b is not null").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    path, state = scratch.write(links), None
    schema = links.schema
    for _ in range(max_rounds):
        now = spark.read.schema(schema).parquet(path)
        mark = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if (mark["n"], mark["s"]) == state or mark["n"] == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state, first = (mark["n"], mark["s"]), scratch.made
        starred = scratch.save(_large_star(now, scratch))
        old, path = path, scratch.write(_small_star(starred, scratch))
        for used in [old, *(f"{scratch.root}/t{i}" for i in range(first, scratch.made - 1))]:
            scratch.drop(used)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")

"""Sharding by a hierarchical weighted hash tree: region, rack, shard.

Every level draws one child for a document: each child gets a uniform draw
from a hash of (document id, level, child) and the child with the smallest
``-ln(draw) / weight`` wins. A child's draw does not depend on its siblings,
so a changed weight moves documents only into or out of that child's subtree.
A shard added as a subtree of its own (``Tree.grown``) takes documents only into itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

SLOT_CELLS = 4096  # cells of a shard; a slot is numbered inside its cell


@dataclass(frozen=True)
class Tree:
    """Weights of the shards as region -> rack -> {shard: weight}."""

    regions: tuple[tuple[str, tuple[tuple[str, tuple[tuple[int, float], ...]], ...]], ...]

    @staticmethod
    def of(shards: int, racks_per_region: int = 2, shards_per_rack: int = 2) -> Tree:
        """Equal weights; a region is filled rack by rack."""
        if shards < 1:
            raise ValueError("shards must be 1 or more")
        per = racks_per_region * shards_per_rack
        regions: dict[int, dict[int, list]] = {}
        for s in range(shards):
            regions.setdefault(s // per, {}).setdefault(s % per // shards_per_rack, []).append((s, 1.0))
        return Tree(tuple((f"g{r}", tuple((f"g{r}/k{k}", tuple(v)) for k, v in racks.items())) for r, racks in regions.items()))

    def grown(self, weight: float = 1.0) -> Tree:
        """The tree with one more shard in a region of its own, so rows move only into it."""
        taken = {name for name, _ in self.regions}
        shards = [s for _, racks in self.regions for _, leaves in racks for s, _ in leaves]
        at = next(i for i in range(len(self.regions), 2 * len(self.regions) + 1) if f"g{i}" not in taken)
        return Tree((*self.regions, (f"g{at}", ((f"g{at}/k0", ((max(shards) + 1, weight),)),))))


def _cost(key: Column, child: str, weight: float) -> Column:
    # the first 13 hex digits of an MD5: 52 bits, so the draw is exact in a double and never 0
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit("|" + child)).cast("binary")), 1, 13), 16, 10).cast("double")
    return -F.log((bits + 1.0) / F.lit(float(2**52 + 1))) / F.lit(float(weight))


def _draw(key: Column, children: list[tuple[str, float, Column]]) -> Column:
    """The value of the child with the least cost; ties go to the child named first."""
    children = [c for c in children if c[1] > 0]
    if not children:
        raise ValueError("a subtree needs a child of positive weight")
    if len(children) == 1:
        return children[0][2]
    costs = F.array(*[_cost(key, name, w) for name, w, _ in children])
    return F.element_at(F.array(*[v for *_, v in children]), F.array_position(costs, F.array_min(costs)).cast("int"))


def with_shard(df: DataFrame, name: str, id_col: str, tree: Tree) -> DataFrame:
    """``df`` with the shard of each row's id, which depends on the id and the tree alone.

    A null id counts as the text ``null``. Levels are drawn one after another.
    All columns of ``df`` stay, but one called ``name`` is replaced.
    """
    key = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null"))
    r, k = free_name(df, "_region", name), free_name(df, "_rack", name)
    weight = lambda rack: sum(w for _, w in rack[1])
    racks = [(n, leaves) for _, group in tree.regions for n, leaves in group]
    at = [sum(len(g) for _, g in tree.regions[:i]) for i in range(len(tree.regions))]
    region = _draw(key, [(n, sum(map(weight, g)), F.lit(i)) for i, (n, g) in enumerate(tree.regions)])
    in_region = [_draw(key, [(r[0], weight(r), F.lit(at[i] + j)) for j, r in enumerate(g)]) for i, (_, g) in enumerate(tree.regions)]
    in_rack = [_draw(key, [(f"s{s}", w, F.lit(s)) for s, w in leaves]) for _, leaves in racks]
    return df.withColumn(r, region).withColumn(k, _choose(r, in_region)).withColumn(name, _choose(k, in_rack).cast("int")).drop(r, k)


def free_name(df: DataFrame, name: str, *others: str) -> str:
    """``name``, with underscores added until no column of ``df`` and none of ``others`` has it."""
    taken = {c.lower() for c in (*df.columns, *others)}
    while name.lower() in taken:
        name += "_"
    return name


def _choose(level: str, options: list[Column]) -> Column:
    out = F.when(F.col(level) == 0, options[0])
    for i, option in enumerate(options[1:], 1):
        out = out.when(F.col(level) == i, option)
    return out


def assign_shards(df: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row.

    ``size`` is the UTF-8 length plus 1 and ``text_crc32`` the CRC of the
    UTF-8 bytes (null text: no bytes). ``slot`` counts 0, 1, ... inside a
    shard without a gap: rows are numbered inside cells of a shard and the
    cells' counts (at most shards x SLOT_CELLS rows) are summed up to offsets,
    so no task holds a shard. Repeated ids share a shard and get slots of
    their own; null ids share one shard. An empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = with_shard(rows, "shard", "doc_id", Tree.of(shards))
    rows = with_shard(rows, "grown_shard", "doc_id", Tree.of(shards).grown())
    # repeated ids would share a cell: the content spreads what it can
    content = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("text_crc32").cast("string"), F.col("size").cast("string"))
    rows = rows.withColumn("cell", (F.conv(F.substring(F.md5(content.cast("binary")), 1, 6), 16, 10).cast("int") % SLOT_CELLS).cast("int"))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n")).withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("doc_id", "text_crc32", "size")) - 1
    numbered = rows.withColumn("inside", inside)
    return numbered.join(offsets, ["shard", "cell"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("offset") + F.col("inside")).cast("long").alias("slot"), "grown_shard"
    )


def write_shards(df: DataFrame, path: str, shards: int = 8, id_col: str = "doc_id") -> None:
    """The rows as Parquet in one folder a shard (several files each, as Spark's partitions fall).

    The folders' column is ``shard``, with underscores added where ``df`` has
    that name already; it is the last one when read back, and all columns of
    ``df`` stay. Null ids share a shard, repeated rows are all written, and an
    empty table writes a folder without rows, which isn't readable.
    """
    name = free_name(df, "shard")
    with_shard(df, name, id_col, Tree.of(shards)).write.partitionBy(name).parquet(path)


def read_shard(spark: SparkSession, path: str, shard: int) -> DataFrame:
    """The rows of one shard; only its folder is read."""
    rows = spark.read.parquet(path)
    return rows.where(F.col(f"`{rows.columns[-1]}`") == shard)

"""SimHash near-dedup: byte-position inverted index with count filtering.

A fingerprint is 8 bytes at 8 positions. Two fingerprints at most ``d`` bits
apart differ in at most ``d`` bytes, so they share at least ``8 - d``
(position, byte) entries. The index posts every fingerprint under sets of
``width`` entries, chosen so that any ``8 - d`` shared entries hold one of the
sets: that is the intersection of single-byte posting lists, which for random
fingerprints are 1/256 of the table each and could not be tallied pair by
pair. Up to ``8 - d`` the width is free and the links found are the same:
``n`` fingerprints at width ``w`` cost about ``sets * n**2 / 2**(8 * w + 1)``
comparisons and ``sets`` postings each, so a larger table takes a larger one. Pairs met in a posting are tallied over all 8 positions, kept from
``8 - d`` shared entries on, and verified bit by bit.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from possum.llm.blocks import Forest, deal, pairs_in, whole_blocks
from possum.llm.common import Scratch, doc_key, packed, ship
from possum.llm.components import components

POSITIONS = 8
WIDTH = 3  # default entries a posting stands under
SEED = 42


def fingerprint(text: str | None, shingle: int) -> int:
    """64-bit SimHash of a text: A-Z lowered, words between ASCII white space, shingles with repeats."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)  # a single shingle: its own majority
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[: -shingle]]).tolist()
    stops = (ends[shingle - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(line[s:e], SEED) for s, e in zip(starts, stops, strict=True)), np.uint64, len(starts))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 14):
        part = h[at : at + (1 << 14)]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


@cache
def posting_sets(max_bits: int, width: int = WIDTH) -> tuple[tuple[int, ...], ...]:
    """Sets of positions such that any ``8 - max_bits`` positions contain one of them."""
    sure = POSITIONS - max_bits
    if sure < 1:
        raise ValueError(f"at {max_bits} bits two fingerprints need not share a byte; the index covers up to {POSITIONS - 1}")
    if width < 1:
        raise ValueError(f"a posting stands under at least one entry, not {width}")
    width = min(width, sure)
    open_ = {frozenset(c) for c in combinations(range(POSITIONS), sure)}
    chosen = []
    while open_:
        best = max(combinations(range(POSITIONS), width), key=lambda c: (sum(set(c) <= o for o in open_), [-x for x in c]))
        chosen.append(best)
        open_ = {o for o in open_ if not set(best) <= o}
    return tuple(chosen)


def fingerprints(df: DataFrame, shingle: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, k_id, k_text, fp) for every row; ``fp`` holds the 64 bits as a signed long."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(x.as_py(), shingle) for x in b.column(0)], np.uint64)
            yield pa.record_batch([*b.columns[1:], pa.array(fps.view(np.int64))], names=["doc_id", "k_id", "k_text", "fp"])

    text = F.col(text_col).cast("string")
    cols = df.select(text.alias("text"), F.col(id_col).cast("long").alias("doc_id"), *doc_key(F.col(id_col), F.col(text_col)))
    return cols.mapInArrow(run, "doc_id long, k_id long, k_text long, fp long")


def _links(fps: DataFrame, max_bits: int, width: int = WIDTH) -> DataFrame:
    """(a, b): a spanning forest of the links inside every block of distinct fingerprints."""
    sure = POSITIONS - max_bits
    keys = []
    for i, places in enumerate(posting_sets(max_bits, width)):
        key = F.lit(i).cast("long")
        for p in places:
            key = F.shiftleft(key, 8).bitwiseOR(F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255)))
        keys.append(key)
    postings = fps.select("fp", F.explode(F.array(*keys)).alias("key"))
    ready = deal(postings, "fp").repartition("key", "c1", "c2").sortWithinPartitions("key", "c1", "c2", "fp")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_blocks(batches):
            fp = t.column("fp").to_numpy()
            bits = fp.view(np.uint64)
            octets = fp.view(np.uint8).reshape(-1, POSITIONS)
            forest = Forest(len(fp))
            for a, b in pairs_in(t):
                tally = (octets[a] == octets[b]).sum(axis=1)
                a, b = a[tally >= sure], b[tally >= sure]
                near = np.bitwise_count(bits[a] ^ bits[b]) <= max_bits
                forest.join(a[near], b[near])
            at = forest.links()
            yield pa.record_batch([pa.array(fp[at]), pa.array(fp[forest.root[at]])], names=["a", "b"])

    return ready.select("key", "c0", "c1", "c2", "fp").mapInArrow(compare, "a long, b long")


def _clustered(df: DataFrame, shingle: int, max_bits: int, id_col: str, text_col: str, width: int) -> DataFrame:
    """(doc_id, k_text, fp, root, component_id) for every row; ``root`` names the component even where ids are null."""
    scratch = Scratch(df.sparkSession, "simhash")
    docs = scratch.save(fingerprints(df, shingle, id_col, text_col))
    classes = scratch.save(docs.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    links = scratch.write(_links(classes.select("fp"), max_bits, width))
    roots = components(df.sparkSession.read.schema("a long, b long").parquet(links), scratch)
    scratch.drop(links)
    named = scratch.save(classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "rep", F.coalesce("root", "fp").alias("root")))
    least = scratch.save(named.groupBy("root").agg(F.min("rep").alias("component_id")))
    return docs.join(named.join(least, "root").select("fp", "root", "component_id"), "fp")


def near_documents(df: DataFrame, shingle: int = 4, max_bits: int = 4, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row.

    Fingerprints link at ``max_bits`` or fewer differing bits at any ``width``; equal
    fingerprints are one node, so exact copies make no pairs, and a dense
    posting is compared in blocks that hand on a spanning forest. A null or
    empty text has fingerprint zero and links like any other. ``component_id``
    is the smallest doc_id reachable; null ids never are the smallest, and a
    component of null ids alone has a null one. Repeated rows stay. An empty
    table gives an empty result; other columns are ignored.
    """
    near = _clustered(df, shingle, max_bits, id_col, text_col, width)
    return near.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(df: DataFrame, shingle: int = 4, max_bits: int = 4, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """One row of each component, all columns as they are: the smallest id, null ids last.

    Of rows that repeat an id the text with the least hash counts first; of
    rows that repeat id and text any one stays.
    """
    near = _clustered(df, shingle, max_bits, id_col, text_col, width)
    first = near.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "k_id", "k_text")).alias("f")).select("f.k_id", "f.k_text")
    kept = packed(df, id_col, text_col).join(first, ["k_id", "k_text"], "left_semi")
    one = Window.partitionBy("k_id", "k_text").orderBy("k_id")
    return kept.withColumn("k_row", F.row_number().over(one)).where("k_row = 1").select("row.*")

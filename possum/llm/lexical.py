"""Ranked lexical search by bag deduplication.

Documents are cut down to the vocabulary of the items: a document becomes its
bag, the counts of the item terms in it, and the length figure ``m`` its score
needs. Documents that agree in bag and ``m`` score alike for every item, so
they form a class: rows meet by a 64-bit hash and only equal bags, compared
byte by byte, become one. Classes are scored once. The classes that win an
item are expanded into their members by ascending doc_id.

Any of an item's best ``k`` documents lies in one of its best ``k`` classes
(by score, then by smallest doc_id), and is among the ``k`` smallest doc_ids
of that class. So a task keeps ``k`` classes an item, and a class held by a
third of all documents hands on ``k`` members from each task.

Items are searched in blocks of at most about ``block_terms`` (item, term)
entries; a block's terms are all that is collected and sent to the tasks.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from possum.llm.common import Scratch, ship

BLOCK_TERMS = 50_000
CELLS = 1 << 21  # cells of one score matrix, and postings expanded at once
LAST = (1 << 63) - 1  # a null doc_id sorts here
EXACT = 1 << 53

# Bytes of a term: digits, letters and everything beyond ASCII; A-Z are lower-cased, the rest parts terms.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(TERM_BYTES).split() if text else []


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _texts(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    return batch.column(name).cast(pa.large_binary()).to_pylist()


def _item_terms(items: DataFrame, item_col: str, text_col: str, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(q, item_id) of every item row, and (q, term, times)."""
    numbered = scratch.save(items.select(F.monotonically_increasing_id().alias("q"), F.col(f"`{item_col}`").alias("item_id"), F.col(f"`{text_col}`").cast("string").alias("text")))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for q, text in zip(b.column("q").to_pylist(), _texts(b, "text"), strict=True):
                times = Counter(terms_of(text))
                yield pa.record_batch([pa.array([q] * len(times), pa.int64()), pa.array(list(times), pa.binary()), pa.array(list(times.values()), pa.int64())], names=["q", "term", "times"])

    return numbered.drop("text"), scratch.save(numbered.select("q", "text").mapInArrow(split, "q long, term binary, times long"))


def _bags(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, bag): the terms a document has, and its item terms as (term, count) pairs by term."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.get
        for b in batches:
            sizes, bags = [], []
            for text in _texts(b, "text"):
                terms = terms_of(text)
                sizes.append(len(terms))
                held = sorted((t, c) for term, c in Counter(terms).items() if (t := known(term)) is not None)
                bags.append(np.array(held, "<i4").tobytes())
            yield pa.record_batch([b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(bags, pa.binary())], names=["doc_id", "n", "bag"])

    return docs.mapInArrow(cut, "doc_id long, n long, bag binary")


def _pairs(bags: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and count of every pair in a batch of bags."""
    bags = bags.cast(pa.large_binary())
    sizes = np.asarray(pc.binary_length(bags)) // 8
    flat = np.frombuffer(b"".join(bags.to_pylist()), "<i4").reshape(-1, 2)
    return np.repeat(np.arange(len(sizes)), sizes), flat[:, 0].astype(np.int64), flat[:, 1].astype(np.int64)


def _document_counts(bags: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """N, L and every term's df over all documents: partial counts in the tasks, sums in Spark."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(n_terms + 2, np.int64)
        for b in batches:
            n = np.asarray(b.column("n"))
            df[n_terms] += (n > 0).sum()
            df[n_terms + 1] += n.sum()
            df[:n_terms] += np.bincount(_pairs(b.column("bag"))[1], minlength=n_terms)
        at = np.flatnonzero(df)
        yield pa.record_batch([pa.array(at), pa.array(df[at])], names=["term", "c"])

    out = np.zeros(n_terms + 2, np.int64)
    for r in bags.select("n", "bag").mapInArrow(count, "term long, c long").groupBy("term").agg(F.sum("c").alias("c")).collect():
        out[r["term"]] = r["c"]
    return int(out[n_terms]), int(out[n_terms + 1]), out[:n_terms]


class _Best:
    """The best ``k`` classes of every item that a task has met, by score and then smallest doc_id."""

    def __init__(self, n_items: int, k: int):
        self.k = k
        self.item, self.score, self.first, self.row = (np.empty(0, np.int64) for _ in range(4))
        self.bar = np.zeros(n_items, np.int64)  # a class below its item's bar can't enter
        self.held: list[tuple] = []

    def add(self, scores: np.ndarray, first: np.ndarray, classes: list[tuple]) -> None:
        row, item = np.nonzero((scores > 0) & (scores >= self.bar))
        if not len(row):
            return
        start = len(self.held)
        used, back = np.unique(row, return_inverse=True)
        self.held += [classes[r] for r in used.tolist()]
        item, score = np.concatenate([self.item, item]), np.concatenate([self.score, scores[row, item]])
        first, row = np.concatenate([self.first, first[row]]), np.concatenate([self.row, start + back])
        order = np.lexsort((first, -score, item))
        item = item[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        top = place < self.k
        order = order[top]
        self.item, self.score, self.first, self.row = item[top], score[order], first[order], row[order]
        full = place[top] == self.k - 1
        self.bar[self.item[full]] = self.score[full]
        used, self.row = np.unique(self.row, return_inverse=True)
        self.held = [self.held[r] for r in used.tolist()]


def _score(classes: DataFrame, postings: tuple[np.ndarray, np.ndarray, np.ndarray], n_items: int, k: int, exact: bool) -> DataFrame:
    """Every task's best ``k`` classes an item: (q, score, first, h, m, bag)."""
    start, of_item, value = postings  # by term: the items that hold it, and weight times repeats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(n_items, k)
        step = max(1, CELLS // n_items)
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                b = whole.slice(at, step)
                first, m = np.asarray(b.column("first")), np.asarray(b.column("m"))
                row, term, tf = _pairs(b.column("bag"))
                impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[row])
                sums = np.zeros(b.num_rows * n_items, np.int64)
                fan = start[term + 1] - start[term]
                ends = np.cumsum(fan)
                cuts = np.searchsorted(ends, np.arange(CELLS, int(ends[-1]) + CELLS, CELLS), "right") if len(ends) else []
                low = 0
                for high in [*cuts, len(fan)]:  # bounded runs of postings
                    high = max(int(high), min(low + 1, len(fan)))
                    f = fan[low:high]
                    pick = np.repeat(start[term[low:high]] - (np.cumsum(f) - f), f) + np.arange(int(f.sum()))
                    cell = np.repeat(row[low:high], f) * n_items + of_item[pick]
                    gain = np.repeat(impact[low:high], f) * value[pick]
                    if exact:
                        np.add.at(sums, cell, gain)
                    else:  # sums of integers below 2^53 are exact in doubles
                        sums += np.bincount(cell, gain, len(sums)).astype(np.int64)
                    low = high
                rows = list(zip(b.column("h").to_pylist(), m.tolist(), b.column("bag").to_pylist(), strict=True))
                best.add(sums.reshape(-1, n_items), first, rows)
        h, m, bag = zip(*[best.held[r] for r in best.row.tolist()], strict=True) if len(best.row) else ((), (), ())
        yield pa.record_batch([pa.array(best.item), pa.array(best.score), pa.array(best.first), pa.array(h, pa.int64()), pa.array(m, pa.int64()), pa.array(bag, pa.binary())], names=["i", "score", "first", "h", "m", "bag"])

    return classes.select("first", "h", "m", "bag").mapInArrow(run, "i long, score long, first long, h long, m long, bag binary")


def _top(df: DataFrame, by: list[str], order: list, k: int, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= k)


def _search_block(docs: DataFrame, asked: list, k: int, scratch: Scratch) -> DataFrame:
    """(q, rank, doc_id, score) for the items of one block; ``asked``: their (q, term, times)."""
    spark = docs.sparkSession
    vocabulary = {t: i for i, t in enumerate(sorted({bytes(r["term"]) for r in asked}))}
    items = sorted({r["q"] for r in asked})
    place = {q: i for i, q in enumerate(items)}
    bags = scratch.save(_bags(docs, vocabulary))
    n_docs, length, df = _document_counts(bags, len(vocabulary))

    held = np.array([(vocabulary[bytes(r["term"])], place[r["q"]], r["times"]) for r in asked], np.int64)
    held = held[np.argsort(held[:, 0], kind="stable")]
    start = np.searchsorted(held[:, 0], np.arange(len(vocabulary) + 1))
    weights = np.array([weight(n_docs, int(d)) for d in df], np.int64)
    value = weights[held[:, 0]] * held[:, 2]
    most = int(np.bincount(held[:, 1], value.astype(float)).max()) * 1_000_000  # an impact is below a million
    m = F.expr(f"25 + cast(cast(n as decimal(19,0)) * cast('{75 * n_docs}' as decimal(19,0)) div cast('{max(length, 1)}' as decimal(19,0)) as bigint)")
    rows = bags.where("length(bag) > 0").select("doc_id", F.coalesce("doc_id", F.lit(LAST)).alias("last"), m.alias("m"), "bag")
    rows = rows.withColumn("h", F.xxhash64("m", "bag"))
    classes = rows.groupBy("h", "m", "bag").agg(F.min("last").alias("first"))
    scored = _score(classes, (start, held[:, 1], value), len(items), k, most >= EXACT)
    winners = scratch.save(_top(scored, ["i"], [F.desc("score"), "first", "h", "m", "bag"], k).drop("rank", "first"))

    inside = rows.join(winners.select("h").distinct(), "h", "left_semi")
    members = _top(inside, ["h", "m", "bag"], ["last"], k).select("h", "m", "bag", "doc_id", "last")
    found = winners.join(members, ["h", "m", "bag"])
    ranked = _top(found, ["i"], [F.desc("score"), "last"], k)
    numbers = spark.createDataFrame(list(enumerate(items)), "i long, q long")
    return scratch.save(ranked.join(numbers, "i").select("q", "rank", "doc_id", "score"))


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
                   item_col: str = "item_id", item_text_col: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``k`` best documents with a score above 0.

    Ranks run from 1 by score, equal scores by ascending doc_id, null ids
    last. Null and empty texts have no terms: such a document is counted
    nowhere, such an item has no rows. Rows that repeat a doc_id are documents
    of their own, rows that repeat an item_id items of their own. Other
    columns are not read. An empty table on either side gives an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "lexical")
    numbered, asked = _item_terms(items, item_col, item_text_col, scratch)
    blocks = math.ceil(asked.count() / block_terms)
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    found = spark.createDataFrame([], "q long, rank int, doc_id long, score long")
    for i in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == i).collect()
        if block:
            found = found.unionByName(_search_block(texts, block, k, scratch))
    return found.join(numbered, "q").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")

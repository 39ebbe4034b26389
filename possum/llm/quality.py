"""Quality rules: plain text rules and a hashed n-gram likelihood ratio.

Words and word pairs are hashed into ``BUCKETS`` buckets. Two multinomials
over the buckets are counted: one over the whole corpus and one over trusted
documents (good quality, not toxic). A document's score is the mean log ratio
of its n-grams under the two; the mean does not grow with the length. Log
ratios are whole millionths, so a score is the same in any order of work, and
every document is held against one threshold.

The threshold comes from all trusted documents, each scored under target
counts that leave out its fold (one of ``FOLDS``, by hash): it is ``MARGIN``
below the score, in whole thousandths, that all but ``LOST_SHARE`` of them reach.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from possum.llm.common import ship

BUCKETS = 1 << 16
FOLDS = 5
LOST_SHARE, MARGIN = 0.005, 0.05
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\x0b\x0c\r"


class _Hashes(dict):
    """Word -> 64-bit hash, kept for the words seen lately."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def word_hashes(words: list[bytes], hashes: _Hashes) -> np.ndarray:
    return np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def buckets(h: np.ndarray) -> np.ndarray:
    """Buckets of all words, then of all pairs of neighbours."""
    pairs = _mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])
    return (np.concatenate([_mix(h), pairs]) % np.uint64(BUCKETS)).astype(np.int64)


def base_counts(text: str, words: list[bytes], h: np.ndarray) -> tuple[int, int, int, int]:
    """(word_chars, n_symbols, n_dup_lines, n_repeat_words); words are told apart by their 64-bit hash."""
    chars = len(text) - sum(map(text.count, _SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(_SPACES)]
    dup = len(lines) - len(set(lines))
    repeat = 0
    if len(h) > 2:
        windows = _mix(_mix(h[:-2] * np.uint64(0x9E3779B97F4A7C15) + h[1:-1]) * np.uint64(0x94D049BB133111EB) + h[2:])
        _, at, n = np.unique(windows, return_inverse=True, return_counts=True)
        if len(n) < len(windows):
            twice = n[at] > 1
            covered = np.zeros(len(h), bool)
            for i in range(3):
                covered[i : len(h) - 2 + i] |= twice
            repeat = int(covered.sum())
    return chars, symbols, dup, repeat


@dataclass
class QualityModel:
    """``ratio``: millionths of the log ratio by bucket; ``threshold``: millionths of a mean, None keeps all that pass the base rules."""

    ratio: np.ndarray
    threshold: int | None


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def trusted_ids(labels: DataFrame, id_col: str = "doc_id", quality_col: str = "quality", toxic_col: str = "toxic", trusted_rows: int | None = None, held_rows: int | None = None) -> DataFrame:
    """(doc_id, held) of every document with good labels only; none is held out of the target counts.

    Good is quality 1 and not toxic in every label of the id. A caller may ask
    for a sample instead: with either bound, at most ``trusted_rows`` +
    ``held_rows`` documents by least hash, about ``held_rows`` of them held out."""
    if (trusted_rows is not None and trusted_rows < 1) or (held_rows is not None and held_rows < 1):
        raise ValueError("both samples need a row")
    good = labels.select(F.col(id_col).cast("long").alias("doc_id"), (F.col(quality_col).eqNullSafe(F.lit(1)) & F.coalesce(F.col(toxic_col) != 1, F.lit(True))).alias("good"))
    ids = good.where("doc_id is not null").groupBy("doc_id").agg(F.min("good").alias("good")).where("good").select("doc_id")
    if trusted_rows is None and held_rows is None:
        return ids.select("doc_id", F.lit(False).alias("held"))
    trusted_rows, held_rows = trusted_rows or 4 * held_rows, held_rows or max(1, trusted_rows // 4)
    share = max(2, (trusted_rows + held_rows) // held_rows)
    first = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(trusted_rows + held_rows)
    return first.select("doc_id", (F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(share)) == 0).alias("held"))


def _fold() -> Column:
    return F.pmod(F.xxhash64(F.lit(2), "doc_id"), F.lit(FOLDS))


def _ratio(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Millionths of the log ratio by bucket; 0 without target counts."""
    if not target.sum():
        return np.zeros(BUCKETS, np.int64)
    log = np.log((target + 1) / (target.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS))
    return np.round(log * 1e6).astype(np.int64)


def _lower_edge(scored: DataFrame) -> int | None:
    """The most thousandths of a mean score that all but ``LOST_SHARE`` of the rows reach.

    Rows are counted by thousandth, so the driver gets as many numbers as there
    are thousandths between the least and the largest log ratio, however many rows."""
    bins = scored.groupBy(F.floor(F.col("score") / F.col("n_grams") / 1000).alias("at")).agg(F.count(F.lit(1)).alias("n")).collect()
    may_lose, edge = LOST_SHARE * sum(r["n"] for r in bins), None
    for at, n in sorted((r["at"], r["n"]) for r in bins):
        edge = at
        may_lose -= n
        if may_lose < 0:
            break
    return edge


def fit_quality(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", trusted_rows: int | None = None, held_rows: int | None = None) -> QualityModel:
    """Counts both multinomials over all documents and fixes the threshold.

    The raw multinomial counts every document, the target one every trusted
    document, and every trusted document that passes the base rules sets the
    threshold (``trusted_rows`` and ``held_rows``: see ``trusted_ids``; held-out
    documents alone set the threshold then). The texts are shuffled once, to meet
    their labels for the target counts; no table of labels is broadcast.

    Without trusted documents every ratio is 0 and the threshold is None. Null
    ids are never trusted.
    """
    spark = df.sparkSession
    ship(spark)
    ids = trusted_ids(labels, trusted_rows=trusted_rows, held_rows=held_rows)
    # a held-out document has the fold FOLDS: it is counted in no target
    fold = F.when(F.col("held"), F.lit(FOLDS)).otherwise(_fold())
    ids = ids.select("doc_id", fold.cast("int").alias("fold"), "held")
    sampled = trusted_rows is not None or held_rows is not None
    texts = _texts(df, id_col, text_col)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target, hashes = np.zeros(BUCKETS, np.int64), np.zeros((FOLDS + 1, BUCKETS), np.int64), _Hashes()
        for b in batches:
            for text, fold in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                at = np.bincount(buckets(word_hashes(text.as_py().encode().split(), hashes)), minlength=BUCKETS)
                raw += at
                if fold is not None:
                    target[fold] += at
        some = np.flatnonzero(raw)
        yield pa.record_batch([pa.array(some), pa.array(raw[some]), *(pa.array(t[some]) for t in target[:FOLDS])], names=["bucket", "raw", *targets])

    targets = [f"target{i}" for i in range(FOLDS)]
    counted = texts.join(ids.hint("shuffle_hash"), "doc_id", "left").select("text", "fold").mapInArrow(count, ", ".join(f"{c} long" for c in ("bucket", "raw", *targets)))
    raw, target = np.zeros(BUCKETS), np.zeros((FOLDS, BUCKETS))
    for row in counted.groupBy("bucket").agg(*(F.sum(c).alias(c) for c in ("raw", *targets))).collect():  # BUCKETS rows at most
        raw[row["bucket"]], target[:, row["bucket"]] = row["raw"], [row[c] for c in targets]
    whole = target.sum(axis=0)
    model = QualityModel(_ratio(raw, whole), None)
    if not whole.sum():
        return model
    # the fold hangs on the id alone, so all texts are scored where they lie and only their scores meet the labels
    judges = [model] if sampled else [QualityModel(_ratio(raw, whole - t), None) for t in target]
    at = F.lit(0) if sampled else F.coalesce(_fold(), F.lit(0)).cast("int")
    means = _score(texts.withColumn("fold", at), judges).where("not base_failed").select("doc_id", "score", "n_grams")
    edge = _lower_edge(means.join((ids.where("held") if sampled else ids).hint("shuffle_hash"), "doc_id", "left_semi"))
    if edge is not None:
        model.threshold = math.floor(1000 * edge - MARGIN * 1e6)
    return model


def _judge(text: str, model: QualityModel, hashes: _Hashes) -> tuple:
    words = text.encode().split()
    h = word_hashes(words, hashes)
    chars, symbols, dup, repeat = base_counts(text, words, h)
    grams = 2 * len(h) - 1 if len(h) else 0
    score = int(model.ratio[buckets(h)].sum()) if grams else 0
    failed = len(h) < MIN_WORDS or 100 * repeat > MAX_REPEAT_PERCENT * len(h)
    kept = not failed and (model.threshold is None or score >= model.threshold * grams)
    return len(h), chars, symbols, dup, repeat, failed, kept, score, grams


def score_quality(df: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score, n_grams) for every row.

    A null text has no words and fails the base rules. Repeated rows are
    judged each; other columns are ignored; an empty table gives an empty
    result. No shuffle; the model is BUCKETS numbers.
    """
    return _score(_texts(df, id_col, text_col).withColumn("fold", F.lit(0)), [model])


def _score(texts: DataFrame, models: list[QualityModel]) -> DataFrame:
    """``score_quality`` of (doc_id, text, fold), each row under the model of its fold."""
    spark = texts.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(models)
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score", "n_grams"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for b in batches:
            rows = [_judge(x.as_py(), shared.value[f], hashes) for x, f in zip(b.column(1), b.column(2).to_pylist(), strict=True)]
            cols = list(zip(*rows, strict=True)) if rows else [[] for _ in names[1:]]
            kinds = [pa.bool_() if n in ("base_failed", "kept") else pa.int64() for n in names[1:]]
            yield pa.record_batch([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=names)

    schema = ", ".join(f"{n} {'boolean' if n in ('base_failed', 'kept') else 'long'}" for n in names)
    return texts.mapInArrow(run, schema)


def keep_quality(df: DataFrame, model: QualityModel, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that the rules and the threshold keep, all columns as they are. No shuffle.

    A null or empty text fails the base rules, so its row goes. Repeated rows
    are judged each; other columns may have any name; an empty table stays empty.
    """
    spark = df.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for b in batches:
            kept = [_judge(x.as_py() or "", shared.value, hashes)[6] for x in b.column(at)]
            yield b.filter(pa.array(kept, pa.bool_()))

    return df.mapInArrow(run, df.schema)


def judge_quality(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fit on the corpus and judge every document of it (see ``score_quality``)."""
    model = fit_quality(df, labels, id_col, text_col)
    return score_quality(df, model, id_col, text_col)

"""The records of CSV files, found split by split, quoted line breaks included (SRC1-SRC5).

A line break ends a record only outside quotes, and whether a line begins
inside quotes depends on all lines before it, so a plain reader gives a file
with quoted line breaks to one task. Here a file is read as lines, split by
byte ranges like any text file, in three steps:

1. a line takes each of the two states it may begin in (outside or inside
   quotes) to the state it ends in; a split's lines compose to the split's
   effect, one small row;
2. a window over these rows gives every split the state it begins in, and for
   one that begins inside quotes the split in which that record began;
3. every split cuts its lines into records from that state. Only the pieces
   of records that cross a split are brought together, by file and beginning.

The file is read twice, and no line is sorted or shuffled but those pieces.
Spark decides the splits anew in each reading; the two readings' splits and
line counts are compared, and the reading is repeated if they differ.

Quotes are read as Spark's CSV parser reads them: a field is quoted if its
first character is the quote; inside, the escape takes the next character with
it (or, where the escape is the quote, two quotes are one); after the closing
quote the field goes on to the separator. ``\\r\\n`` counts as ``\\n``, also
inside quotes. Lines that are blank outside quotes are no records.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from possum.session import ensure_checkpoint_dir

MAX_SPLITS = 16  # a record may reach over so many splits; a quote that never closes is an error
ATTEMPTS = 5
EFFECTS = "file string, start long, n long, from_out boolean, from_in boolean, closes boolean"
CUT = "file string, start long, record string, opener long, header boolean, n long"


def quote_patterns(sep: str, quote: str, escape: str) -> tuple[str, str]:
    """Patterns of a line that ends outside quotes, if it begins outside and if it begins inside.

    All loops are possessive, so Java's matcher neither backtracks nor recurses."""
    s, q, e = (re.escape(c) for c in (sep, quote, escape))
    if escape == quote:
        body = rf"[^{q}]*+(?:{q}{q}[^{q}]*+)*+"
    else:
        body = rf"[^{q}{e}]*+(?:{e}.[^{q}{e}]*+)*+"
    rest = rf"{q}[^{s}]*+"
    field = rf"(?:{q}{body}{rest}|(?!{q})[^{s}]*+)"
    return rf"(?s)\A{field}(?:{s}{field})*+\z", rf"(?s)\A{body}{rest}(?:{s}{field})*+\z"


def _lines(spark: SparkSession, path: str, sep: str, quote: str, escape: str) -> DataFrame:
    """(file, start, value, a, b): a, b: whether the line ends inside quotes, begun outside or inside."""
    out, inside = quote_patterns(sep, quote, escape)
    text = spark.read.option("lineSep", "\n").text(path)
    value = F.regexp_replace("value", r"\r\z", "")
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), value.alias("value")).select(
        "file", "start", "value", (~F.col("value").rlike(out)).alias("a"), (~F.col("value").rlike(inside)).alias("b"))


def _effects(lines: DataFrame) -> DataFrame:
    """One row a split: lines, the state after them from either beginning, and whether a quote that is open at its start closes in it."""

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, n, ends, closes = None, 0, [False, True], False
        for batch in batches:
            a, b = (np.asarray(batch.column(c).to_numpy(zero_copy_only=False), bool) for c in ("a", "b"))
            start, file = np.asarray(batch.column("start")), batch.column("file").to_pylist()
            edges = [0, *(i for i in range(1, len(file)) if start[i] != start[i - 1] or file[i] != file[i - 1]), len(file)] if len(file) else []
            for low, high in zip(edges, edges[1:], strict=False):
                if at != (file[low], start[low]):
                    if at:
                        yield pa.record_batch([[at[0]], pa.array([int(at[1])]), pa.array([n]), [ends[0]], [ends[1]], [closes]], names=["file", "start", "n", "from_out", "from_in", "closes"])
                    at, n, ends, closes = (file[low], start[low]), 0, [False, True], False
                x, y = a[low:high], b[low:high]
                n += high - low
                closes |= not y.all()
                fixed = np.flatnonzero(x == y)  # the last line that ends alike from both states decides, but for swaps after it
                last = fixed[-1] if len(fixed) else -1
                odd = bool((x & ~y)[last + 1 :].sum() & 1)
                ends = [bool(x[last]) ^ odd] * 2 if last >= 0 else [e ^ odd for e in ends]
        if at:
            yield pa.record_batch([[at[0]], pa.array([int(at[1])]), pa.array([n]), [ends[0]], [ends[1]], [closes]], names=["file", "start", "n", "from_out", "from_in", "closes"])

    return lines.select("file", "start", "a", "b").mapInArrow(compose, EFFECTS)


def _beginnings(effects: DataFrame) -> DataFrame:
    """(file, start, opener) of every split that begins inside quotes; ``opener``: the split where that record began."""
    order = Window.partitionBy("file").orderBy("start")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    swaps = effects.withColumn("swap", (F.col("from_out") & ~F.col("from_in")).cast("long"))
    swaps = swaps.withColumn("swaps", F.sum("swap").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    fixed = F.when(F.col("from_out") == F.col("from_in"), F.struct(F.col("from_out").alias("end"), F.col("swaps").alias("at")))
    last, so_far = F.last(fixed, ignorenulls=True).over(before), F.coalesce(F.sum("swap").over(before), F.lit(0))
    odd = F.pmod(so_far - F.coalesce(last["at"], F.lit(0)), F.lit(2)) == 1
    begun = swaps.withColumn("inside", F.coalesce(last["end"], F.lit(False)) != odd)
    leaves = F.when(F.col("inside"), F.col("from_in") & F.col("closes")).otherwise(F.col("from_out"))
    return begun.withColumn("opener", F.last(F.when(leaves, F.col("start")), ignorenulls=True).over(before)).where("inside").select("file", "start", "opener")


def _cut(lines: DataFrame, openers: dict[tuple[str, int], int], header: bool) -> DataFrame:
    """Records (``opener`` null), pieces of records that cross splits, and a row with the number of lines of every split."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, n, open_, inside, first, opener = None, 0, [], False, False, None

        def rows(records: list[tuple], n_lines: int | None = None) -> pa.RecordBatch:
            """``records``: (text, opener, header); without any, the closing row of the split."""
            columns = zip(*records, strict=True) if records else ([None], [None], [None])
            kinds = (pa.string(), pa.int64(), pa.bool_())
            size = max(len(records), 1)
            return pa.record_batch([pa.array([at[0]] * size), pa.array([int(at[1])] * size, pa.int64()), *(pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)), pa.array([n_lines] * size, pa.int64())],
                                   names=["file", "start", "record", "opener", "header", "n"])

        def close() -> Iterator[pa.RecordBatch]:
            if open_:  # goes on in the next split; a record that began before this one keeps its beginning
                yield rows([("\n".join(open_), opener if opener is not None else int(at[1]), first)])
            yield rows([], n)

        for batch in batches:
            a, b = (np.asarray(batch.column(c).to_numpy(zero_copy_only=False), bool) for c in ("a", "b"))
            start, file, value = np.asarray(batch.column("start")), batch.column("file").to_pylist(), batch.column("value").to_pylist()
            edges = [0, *(i for i in range(1, len(file)) if start[i] != start[i - 1] or file[i] != file[i - 1]), len(file)] if len(file) else []
            for low, high in zip(edges, edges[1:], strict=False):
                if at != (file[low], start[low]):
                    if at:
                        yield from close()
                    at, n, open_ = (file[low], start[low]), 0, []
                    opener = openers.get((file[low], int(start[low])))
                    inside, first = opener is not None, header and int(start[low]) == 0
                x, y = a[low:high], b[low:high]
                n += high - low
                fixed = np.maximum.accumulate(np.where(x == y, np.arange(len(x)), -1))
                swaps = np.concatenate([[0], np.cumsum(x & ~y)])
                since = (swaps[1:] - swaps[fixed + 1]) & 1 == 1
                after = np.where(fixed >= 0, x[fixed], inside) ^ since
                inside, done, low_line = bool(after[-1]), [], 0
                for end in np.flatnonzero(~after).tolist():
                    text = "\n".join([*open_, *value[low + low_line : low + end + 1]])
                    if first and text.strip():
                        first, open_, low_line = False, [], end + 1
                        continue
                    done.append((text, opener, False))
                    open_, opener, low_line = [], None, end + 1
                open_ = [*open_, *value[low + low_line : high]]
                if done:
                    yield rows(done)
        if at:
            yield from close()

    return lines.mapInArrow(cut, CUT)


def read_records(spark: SparkSession, path: str, stage: str | None = None, header: bool = True, sep: str = ",", quote: str = '"', escape: str = "\\") -> DataFrame:
    """(record): the text of every record of the files under ``path``, without each file's header record.

    The records are written under ``stage`` (default: a folder of the session's
    checkpoint folder) and read from there. What reaches the driver is one
    entry for every split that begins inside quotes, so at most one for each
    ``spark.sql.files.maxPartitionBytes`` of input. A record over more than
    ``MAX_SPLITS`` splits, as a quote that never closes makes, is an error that
    names the file and the split."""
    stage = stage or f"{ensure_checkpoint_dir(spark).rstrip('/')}/csv/{uuid.uuid4().hex}"
    for attempt in range(ATTEMPTS):
        lines = _lines(spark, path, sep, quote, escape)
        _effects(lines).write.mode("overwrite").parquet(f"{stage}/splits")
        splits = spark.read.schema(EFFECTS).parquet(f"{stage}/splits")
        inside = _beginnings(splits)
        long = inside.groupBy("file", "opener").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MAX_SPLITS).first()
        if long:
            raise ValueError(f"{long['file']}: a quoted field that begins in the split at byte {long['opener']} doesn't end within {MAX_SPLITS} splits")
        openers = {(r["file"], r["start"]): r["opener"] for r in inside.collect()}
        _cut(lines, openers, header).write.parquet(f"{stage}/records-{attempt}")
        rows = spark.read.schema(CUT).parquet(f"{stage}/records-{attempt}")
        both = splits.select("file", "start", "n", F.lit(1).alias("_d")).unionByName(rows.where("n is not null").select("file", "start", "n", F.lit(-1).alias("_d")))
        if both.groupBy("file", "start", "n").agg(F.sum("_d").alias("_d")).where("_d <> 0").isEmpty():
            break
    else:
        raise RuntimeError(f"{path}: the splits changed in each of {ATTEMPTS} readings")
    rows = rows.where("n is null")
    whole = rows.where("opener is null").select("record")
    pieces = rows.where("opener is not null").groupBy("file", "opener").agg(F.array_sort(F.collect_list(F.struct("start", "record"))).alias("p"), F.max("header").alias("header"))
    crossing = pieces.where("not header").select(F.array_join(F.transform("p", lambda x: x["record"]), "\n").alias("record"))
    return whole.unionByName(crossing).where(F.trim("record") != "")


def parse_records(records: DataFrame, schema: str, corrupt: str, sep: str = ",", quote: str = '"', escape: str = "\\") -> Column:
    """The struct of a record's fields by Spark's CSV parser; ``corrupt`` keeps the text of a row that doesn't fit."""
    options = {"sep": sep, "quote": quote, "escape": escape, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt}
    return F.from_csv(records["record"], schema, options)

"""Suffix-array dedup: repeated byte strings from a parse, hash counts and a radix sort.

Which 200-byte strings start twice in the corpus? All suffixes of all texts
would have to be ordered; only a few of them decide.

1. Parse. Every 200-byte window holds a least 32-byte gram, its anchor (the
   rightmost of equal ones), which depends on the window's bytes alone. The
   windows of a text with one anchor are a block, and a text is a sequence of
   blocks. Equal windows have equal grams at equal places in them, so they
   can only lie in blocks of the same gram.
2. Blocks that occur twice as a whole are settled by one count of the parse
   symbols; blocks of a gram that occurs once are settled as well.
3. The windows of the blocks left are strings around a 100-byte core. The
   rows of a core meet in one task. Their suffixes from the core's end on, and
   their reversed prefixes from its start on, are radix sorted from the first
   byte: a round splits the intervals that still hold several rows by their
   next byte and leaves all others alone, and the round in which two
   neighbours part is their common prefix. No shard has a Burrows-Wheeler
   transform or an order of its own. Intervals of at least ``l`` bytes on the left and ``100 - l`` on the
   right give the repeated windows, byte for byte.

A core with very many rows is spread over tasks as single windows instead.
Blocks and windows are told apart by 128 bits of hash (two of 64), cores too;
inside a core bytes are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from possum.llm.blocks import whole_blocks
from possum.llm.common import Scratch, doc_key, ship

WINDOW, GRAM = 200, 32
CORE = WINDOW // 2
HOT_ROWS = 20_000  # rows of a core that are still compared in one task
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_PLACE = 24  # low bits of an order key that hold the place; longer texts are parsed in overlapping parts
_PART = 1 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _M2
    return x ^ (x >> np.uint64(29))


def _anchors(data: np.ndarray) -> np.ndarray:
    """The anchor of every window of at most _PART + WINDOW bytes."""
    eight = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, 8)).view("<u8").ravel()
    h = _mix(eight * _M1)
    n = len(h) - (GRAM - 8)
    g = _mix(h[:n] + (h[8 : 8 + n] << np.uint64(1)) * _M3 + h[16 : 16 + n] * _M2 + h[24 : 24 + n] * _M1)
    low = np.uint64((1 << _PLACE) - 1)
    least = (g & ~low) | (low - np.arange(n, dtype=np.uint64))
    span, w, windows = WINDOW - GRAM + 1, 1, len(data) - WINDOW + 1
    while 2 * w <= span:
        least = np.minimum(least[:-w], least[w:])
        w *= 2
    least = np.minimum(least[:windows], least[span - w : span - w + windows])
    return (low - (least & low)).astype(np.int64)


def parse(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, anchor) of every block of a text."""
    if len(text) < WINDOW:
        return (np.empty(0, np.int64),) * 3
    data = np.frombuffer(text, np.uint8)
    windows = len(data) - WINDOW + 1
    at = np.concatenate([_anchors(data[i : min(i + _PART, windows) + WINDOW - 1]) + i for i in range(0, windows, _PART)])
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return first, np.concatenate([first[1:] - 1, [windows - 1]]), at[first]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _split128(data: bytes, seed: int = 0) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(data, seed)
    return _signed(h >> 64), _signed(h & (2**64 - 1))


# A block's place in one long: first window, windows less one, anchor less first window.
def _pack(lo: np.ndarray, hi: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (lo << 16) | ((hi - lo) << 8) | (at - lo)


def _unpack(place: int) -> tuple[int, int, int]:
    lo = place >> 16
    return lo, lo + ((place >> 8) & 255), lo + (place & 255)


def _blocks(docs: DataFrame) -> DataFrame:
    """(k_id, k_text, place, gram, block): the parse of every text; (gram, block) names a block's bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for b in batches:
            for start in range(0, b.num_rows, 256):
                part = b.slice(start, 256)
                texts = [x.as_py() for x in part.column(2)]
                places, grams, names, counts = [], [], [], []
                for text in texts:
                    lo, hi, at = parse(text)
                    places.append(_pack(lo, hi, at))
                    grams += [digest(text[a : a + GRAM], 1) for a in at.tolist()]
                    names += [digest(text[i : j + WINDOW]) for i, j in zip(lo.tolist(), hi.tolist(), strict=True)]
                    counts.append(len(lo))
                rows = pa.array(np.repeat(np.arange(len(texts)), counts))
                yield pa.record_batch(
                    [part.column(0).take(rows), part.column(1).take(rows), pa.array(np.concatenate(places) if places else np.empty(0, np.int64)),
                     pa.array(np.array(grams, np.uint64).view(np.int64)), pa.array(np.array(names, np.uint64).view(np.int64))],
                    names=["k_id", "k_text", "place", "gram", "block"],
                )

    return docs.select("k_id", "k_text", "bytes").mapInArrow(run, "k_id long, k_text long, place long, gram long, block long")


def interleave(symbols: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): the rows of one task's cores by group and symbols (a radix sort), and each row's common prefix with the one before it.

    ``group`` is sorted, so the rows begin as one interval for each group; -1
    marks the first row of a group.
    """
    n, width = symbols.shape
    order = np.arange(n)
    common = np.full(n, width)
    interval = np.concatenate([[0], np.cumsum(group[1:] != group[:-1])]) if n else np.empty(0, np.int64)
    common[np.flatnonzero(np.concatenate([[True], interval[1:] != interval[:-1]])) if n else []] = -1
    open_ = np.arange(n)
    for h in range(width):
        if len(open_):
            new = np.concatenate([[True], interval[open_[1:]] != interval[open_[:-1]]])
            alone = new & np.concatenate([new[1:], [True]])
            open_ = open_[~alone]
        if not len(open_):
            break
        key = interval[open_] * 257 + symbols[order[open_], h]
        turn = np.argsort(key, kind="stable")
        order[open_], key = order[open_][turn], key[turn]
        parts = np.concatenate([[False], (key[1:] != key[:-1]) & (key[1:] // 257 == key[:-1] // 257)])
        common[open_[parts]] = h
        interval[open_] = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
    return order, common


def repeated_windows(group: np.ndarray, left: np.ndarray, right: np.ndarray, low: np.ndarray, high: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Boolean (rows, CORE): whether the window with ``l`` bytes before the core occurs in two rows or in one of weight 2.

    ``left`` holds the bytes before the core, nearest first, and ``right`` those
    after it; row i has the windows of low[i] <= l <= high[i].
    """
    n = len(group)
    out = np.zeros((n, CORE), bool)
    orders = [interleave(x, group) for x in (left, right)]
    name = np.empty((2, n), np.int64)
    for window in range(low.min(initial=CORE), high.max(initial=-1) + 1):
        rows = np.flatnonzero((low <= window) & (window <= high))
        if not len(rows):
            continue
        for side, ((order, common), need) in enumerate(zip(orders, (window, CORE - window), strict=True)):
            name[side, order] = np.cumsum(common < need)
        _, inverse = np.unique(name[0, rows] * (n + 1) + name[1, rows], return_inverse=True)
        out[rows, window] = np.bincount(inverse, weights=weight[rows])[inverse] >= 2
    return out


def _sides(text: bytes, place: int) -> Iterator[tuple[int, int, int]]:
    """(core start, least l, most l) for the windows of a block: l bytes lie before the core."""
    lo, hi, at = _unpack(place)
    near, far = at - hi, at - lo
    if near < CORE:
        yield at, near, min(far, CORE - 1)
    if far >= CORE:
        yield at - CORE, max(near, CORE) - CORE, far - CORE


_ROW = "h1 long, h2 long, k_id long, k_text long, core long, low int, high int, n long, left binary, right binary"


def _cores(docs: DataFrame, listed: DataFrame) -> DataFrame:
    """Rows around their cores for the listed blocks."""
    names = [x.split()[0] for x in _ROW.split(", ")]
    kinds = [pa.int64()] * 5 + [pa.int32()] * 2 + [pa.int64()] + [pa.binary()] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 128):
                part = b.slice(start, 128)
                rows = []
                for k_id, k_text, text, blocks in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    for block in blocks:
                        for core, low, high in _sides(text, block["place"]):
                            h1, h2 = _split128(text[core : core + CORE])
                            rows.append((h1, h2, k_id, k_text, core, low, high, block["n"], text[core - high : core], text[core + CORE : core + 2 * CORE - low]))
                cols = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
                yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    joined = docs.join(listed, ["k_id", "k_text"]).select("k_id", "k_text", "bytes", "blocks")
    return joined.mapInArrow(run, _ROW)


def _fixed(col: pa.ChunkedArray, reverse: bool) -> np.ndarray:
    """Byte strings as rows of CORE symbols; 256 stands after their end."""
    values = col.combine_chunks()
    offsets = np.asarray(values.buffers()[1]).view(np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    data = np.frombuffer(values.buffers()[2], np.uint8) if values.buffers()[2] is not None else np.empty(0, np.uint8)
    at = np.arange(CORE)[None, :]
    index = (offsets[1:, None] - 1 - at) if reverse else (offsets[:-1, None] + at)
    inside = at < np.diff(offsets)[:, None]
    out = np.full(index.shape, 256, np.int16)
    out[inside] = data[index[inside]]
    return out


_SPAN = "k_id long, k_text long, lo long, hi long"


def _merged(cores: DataFrame) -> DataFrame:
    """(k_id, k_text, lo, hi): runs of repeated windows, from the order of the strings around every core."""
    ready = cores.withColumns({"key": F.col("h1"), "c1": F.col("h2"), "c2": F.lit(0)}).drop("h1", "h2").repartition("key", "c1").sortWithinPartitions("key", "c1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_blocks(batches, 1 << 14):
            key, c1 = (t.column(c).to_numpy() for c in ("key", "c1"))
            group = np.concatenate([[0], np.cumsum((key[1:] != key[:-1]) | (c1[1:] != c1[:-1]))])
            many = np.flatnonzero(np.bincount(group)[group] > 1)
            if not len(many):
                continue
            t, group = t.take(pa.array(many)), group[many]
            low, high, n, core = (t.column(c).to_numpy() for c in ("low", "high", "n", "core"))
            found = repeated_windows(group, _fixed(t.column("left"), True), _fixed(t.column("right"), False), low, high, n)
            # runs of windows of a row; blocks of weight 2 are settled as a whole already
            found[n > 1] = False
            edge = np.diff(np.pad(found, ((0, 0), (1, 1))).astype(np.int8), axis=1)
            row, start = np.nonzero(edge == 1)
            _, stop = np.nonzero(edge == -1)
            yield pa.record_batch(
                [t.column("k_id").combine_chunks().take(pa.array(row)), t.column("k_text").combine_chunks().take(pa.array(row)), pa.array(core[row] - stop + 1), pa.array(core[row] - start)],
                names=["k_id", "k_text", "lo", "hi"],
            )

    return ready.select("key", "c1", "c2", "k_id", "k_text", "core", "low", "high", "n", "left", "right").mapInArrow(run, _SPAN)


def _spread(cores: DataFrame) -> DataFrame:
    """The same for cores of very many rows: every window becomes a row, counted by its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["w1", "w2", "k_id", "k_text", "s", "n"]
        for b in batches:
            for start in range(0, b.num_rows, 256):
                rows = []
                for r in b.slice(start, 256).to_pylist():
                    seed = r["h1"] & (2**64 - 1)
                    for before in range(r["low"], r["high"] + 1):
                        left = r["left"][len(r["left"]) - before :]
                        rows.append((*_split128(bytes([before]) + left + r["right"][: CORE - before], seed), r["k_id"], r["k_text"], r["core"] - before, r["n"]))
                cols = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
                yield pa.record_batch([pa.array(c, pa.int64()) for c in cols], names=names)

    windows = cores.mapInArrow(run, "w1 long, w2 long, k_id long, k_text long, s long, n long")
    twice = windows.groupBy("w1", "w2").agg(F.sum("n").alias("all")).where("all > 1").select("w1", "w2")
    return windows.join(twice, ["w1", "w2"], "left_semi").select("k_id", "k_text", F.col("s").alias("lo"), F.col("s").alias("hi"))


def _documents(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    data = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    return df.select(F.col(id_col).cast("long").alias("doc_id"), *doc_key(F.col(id_col), F.col(text_col)), data.alias("bytes"))


def find_repeats(docs: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(k_id, k_text, runs): runs of window starts whose 200 bytes start elsewhere too."""
    scratch = Scratch(docs.sparkSession, "suffix")
    parsed = scratch.save(_blocks(docs))
    # key lists are written before they are joined: an aggregate inside the join
    # would keep adaptive execution from splitting a gram with very many rows
    grams = scratch.save(parsed.groupBy("gram").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("gram"))
    parsed = scratch.save(parsed.join(grams, "gram", "left_semi"))
    scratch.drop(f"{scratch.root}/t0")
    scratch.drop(f"{scratch.root}/t1")
    owner = F.min(F.struct("k_id", "k_text", "place"))
    blocks = scratch.save(parsed.groupBy("gram", "block").agg(F.count(F.lit(1)).alias("n"), owner.alias("o")))
    whole = parsed.join(blocks.where("n > 1").select("gram", "block"), ["gram", "block"], "left_semi")
    lo, more = F.shiftright("place", 16), F.shiftright("place", 8).bitwiseAND(F.lit(255))
    whole = scratch.save(whole.groupBy("k_id", "k_text").agg(F.collect_set(F.struct(lo.alias("lo"), (lo + more).alias("hi"))).alias("runs")))
    scratch.drop(f"{scratch.root}/t2")
    # blocks of their own, and one of each repeated block, of grams that hold both sorts or several blocks of their own
    mixed = scratch.save(blocks.groupBy("gram").agg(F.count(F.lit(1)).alias("d"), F.min("n").alias("least")).where("d > 1 and least = 1").select("gram"))
    left = blocks.join(mixed, "gram", "left_semi").select("o.k_id", "o.k_text", F.struct("o.place", "n").alias("b"))
    cores = scratch.save(_cores(docs, left.groupBy("k_id", "k_text").agg(F.collect_list("b").alias("blocks"))))
    sizes = cores.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > hot_rows).select("h1", "h2")
    if sizes.isEmpty():
        runs = _merged(cores)
    else:
        runs = _merged(cores.join(sizes, ["h1", "h2"], "left_anti")).union(_spread(cores.join(sizes, ["h1", "h2"], "left_semi")))
    ends = runs.groupBy("k_id", "k_text").agg(F.collect_set(F.struct("lo", "hi")).alias("ends"))
    both = F.concat(F.coalesce("runs", F.array().cast("array<struct<lo:bigint,hi:bigint>>")), F.coalesce("ends", F.array().cast("array<struct<lo:bigint,hi:bigint>>")))
    return scratch.save(whole.join(ends, ["k_id", "k_text"], "full").select("k_id", "k_text", both.alias("runs")))


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_rows: int = HOT_ROWS) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) for every row: removed byte spans [start, end) and the bytes left.

    A byte goes if a 200-byte string over it also starts anywhere else in the
    table, the same text included, as the texts are given. A null text is
    empty. Rows that repeat id and text count as texts of their own and get
    equal results. Texts under 200 bytes, and tables without repeats, stay
    whole; an empty table gives an empty result; other columns are ignored.
    """
    ship(df.sparkSession)
    docs = _documents(df, id_col, text_col)
    runs = find_repeats(docs, hot_rows)
    kinds = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                spans, kept, sizes = [], [], []
                for text, found in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    cut: list[dict] = []
                    for r in sorted(found or [], key=lambda r: r["lo"]):
                        end = r["hi"] + WINDOW
                        if cut and r["lo"] <= cut[-1]["end"]:
                            cut[-1]["end"] = max(cut[-1]["end"], end)
                        else:
                            cut.append({"start": r["lo"], "end": end})
                    edges = [0, *(x for c in cut for x in (c["start"], c["end"])), len(text)]
                    spans.append(cut)
                    kept.append(b"".join(text[i:j] for i, j in zip(edges[::2], edges[1::2], strict=True)))
                    sizes.append(len(text))
                yield pa.record_batch([part.column(0), pa.array(sizes, pa.int64()), pa.array(spans, kinds.field("spans").type), pa.array(kept, pa.binary())], schema=kinds)

    joined = docs.join(runs, ["k_id", "k_text"], "left").select("doc_id", "bytes", "runs")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def repeat_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of ``remove_repeats``."""
    out = remove_repeats(df, id_col, text_col)
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))

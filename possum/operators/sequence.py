"""Previous value per key in an ordered log, without putting a hot key in one task.

``lag(v) over (partition by key order by seq)`` sends every row of a key to one
task. When one key may hold a third of the log, that task holds a third of the
work. ``with_ranges`` finds the keys with many rows by counting hashes of keys
(``SLOTS`` numbers) and splits those into ranges of ``seq``; keys with few rows
stay whole, and their rows move once. ``previous_in_ranges`` then

1. takes the previous row inside each (key, range) by a window;
2. for split keys alone, takes each range's last row by a partial aggregate
   (``max_by``), and for every range the last row of the nearest earlier
   non-empty one by a window over those summaries;
3. gives that value to the first row of each range (a join of the small
   summary onto the window output, which is already partitioned by (key, range)).

The result equals the plain ``lag`` whichever keys are split (ties in ``seq``
are broken by ``tie_cols``), including a null previous value, which stays
distinguishable from "no previous row" through ``has_prev``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SLOTS = 1 << 14  # hashes of keys whose rows are counted
HOT_ROWS = 1 << 17  # rows of a slot from which on its keys are split, and at least HOT_SHARE times the mean slot
HOT_SHARE = 8
RANGE = "_b"
RANGES = 1 << 12  # ranges the log's seq values are cut into where no width is given


def measured_width(df: DataFrame, seq_col: str, ranges: int = RANGES) -> int:
    """The bucket width that cuts the seq values of ``df`` into at most ``ranges + 1`` ranges.

    One aggregate over one column; 1 for a table without seq values."""
    ends = df.agg(F.min(seq_col).alias("lo"), F.max(seq_col).alias("hi")).first()
    return 1 if ends["lo"] is None else (ends["hi"] - ends["lo"]) // ranges + 1


def with_ranges(df: DataFrame, key_cols: Sequence[str], seq_col: str, bucket_width: int | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """``df`` with the range of ``seq`` that a row of a frequent key lies in, null for
    other keys; without that column where no key is frequent. Null keys stay whole.

    ``sizes``: rows with the same keys to count in place of ``df``, which is
    otherwise read once more. At most SLOTS / HOT_SHARE slots are frequent."""
    slot = F.pmod(F.xxhash64(*key_cols), F.lit(SLOTS))
    counts = (df if sizes is None else sizes).groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("n")).collect()
    bound = max(HOT_ROWS, HOT_SHARE * sum(r["n"] for r in counts) // SLOTS)
    hot = [r["slot"] for r in counts if r["n"] > bound]
    if not hot:
        return df
    if bucket_width is None:
        bucket_width = measured_width(df, seq_col)
    # integral division: seq values may exceed the range a double holds exactly
    split = slot.isin(hot)
    for c in key_cols:
        split = split & F.col(c).isNotNull()
    at = F.coalesce(F.expr(f"`{seq_col}` div {int(bucket_width)}"), F.lit(-(1 << 63)))  # a null seq comes first
    return df.withColumn(RANGE, F.when(split, at))


def range_cols(df: DataFrame, key_cols: Sequence[str]) -> list[str]:
    """The columns of one window of ``previous_in_ranges``."""
    return [*key_cols, *([RANGE] if RANGE in df.columns else [])]


def previous_in_ranges(
    df: DataFrame,
    key_cols: Sequence[str],
    seq_col: str,
    value_col: str,
    tie_cols: Sequence[str] = (),
    prev_col: str = "prev",
    has_prev_col: str = "has_prev",
) -> DataFrame:
    """``previous_value`` of rows as ``with_ranges`` gives them; its column goes."""
    keys, parts = list(key_cols), range_cols(df, key_cols)
    order = [F.col(seq_col)] + [F.col(c) for c in tie_cols]
    w_in = Window.partitionBy(*parts).orderBy(*order)
    rn = F.row_number().over(w_in)
    if parts == keys:
        return df.withColumn(prev_col, F.lag(value_col).over(w_in)).withColumn(has_prev_col, rn > F.lit(1))
    local = df.withColumn("_rn", rn).withColumn("_lag", F.lag(value_col).over(w_in))

    last = F.max_by(F.col(value_col), F.struct(*order)).alias("_last")
    summary = df.where(F.col(RANGE).isNotNull()).groupBy(*parts).agg(last)
    w_b = Window.partitionBy(*keys).orderBy(RANGE)
    summary = summary.select(*parts, F.lag("_last").over(w_b).alias("_carry"), F.lag(RANGE).over(w_b).isNotNull().alias("_has_carry"))

    # The window output is hash partitioned by (key, range), so joining the
    # summary on the same columns moves only the small side.
    joined = local.join(summary, parts, "left")
    first = F.col("_rn") == F.lit(1)
    return joined.select(
        *[c for c in df.columns if c != RANGE],
        F.when(first, F.col("_carry")).otherwise(F.col("_lag")).alias(prev_col),
        F.when(first, F.coalesce("_has_carry", F.lit(False))).otherwise(F.lit(True)).alias(has_prev_col),
    )


def previous_value(
    df: DataFrame,
    key_cols: Sequence[str],
    seq_col: str,
    value_col: str,
    tie_cols: Sequence[str] = (),
    bucket_width: int | None = None,
    prev_col: str = "prev",
    has_prev_col: str = "has_prev",
    sizes: DataFrame | None = None,
) -> DataFrame:
    """Add ``prev`` (the value of the row before in the key's order) and
    ``has_prev`` (false for the key's first row). ``seq_col`` must be integral.
    ``bucket_width``: seq values per range of a key with many rows; by default
    the range the log spans is measured and cut into ``RANGES``, so such a key
    has that many summaries at most. ``sizes``: see ``with_ranges``."""
    ranged = with_ranges(df, key_cols, seq_col, bucket_width, sizes)
    return previous_in_ranges(ranged, key_cols, seq_col, value_col, tie_cols, prev_col, has_prev_col)

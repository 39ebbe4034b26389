"""As-of join: for every (key, time) the nearest row of a log, without a task per key.

Both sides are first reduced to one row for each (key, time): a key that holds
a third of all rows keeps one row for each of its times. A window over a whole
key would still bring a hot key's times into one task, so times are cut into
ranges (``width``): a window inside each (key, range) finds the nearest row of
the range, a partial aggregate gives each range's nearest-to-the-edge row, and
a window over those, one row a non-empty range, carries it into the ranges
that hold none. Where a key has few times (days, say), no width is given and
one window a key does it all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _range(time: str, width: int) -> Column:
    # floor, so that negative times have ranges of the same width
    return F.expr(f"(`{time}` - pmod(`{time}`, {int(width)}L)) div {int(width)}L")


def as_of(
    asked: DataFrame,
    log: DataFrame,
    keys: Sequence[str],
    time: str,
    value: str,
    width: int | None,
    forward: bool = False,
    strict: bool = False,
) -> DataFrame:
    """Distinct (keys, time) of ``asked`` with ``value`` of the nearest log row at or before that time.

    ``log``: (keys, time, value), one row a (keys, time); ``time`` is integral,
    the same column name on both sides. ``forward`` takes the nearest at or
    after it, ``strict`` leaves out equal times. ``value`` is null where no
    log row qualifies; rows of the log with a null value count as rows, so a
    nearest row may give null (drop them before where they shouldn't count).
    Null keys or times on either side match nothing."""
    keys = list(keys)
    sign = F.lit(-1 if forward else 1)  # forward is backward on negated times
    present = [F.col(c).isNotNull() for c in (*keys, time)]
    known = present[0]
    for p in present[1:]:
        known = known & p
    points = asked.where(known).select(*keys, (F.col(time) * sign).alias("_t")).distinct()
    # at equal times the log row comes before the point that may see it
    marks = log.where(known).select(*keys, (F.col(time) * sign).alias("_t"), F.lit(1 if strict else 0).alias("_side"), F.struct(F.col(value).alias("v")).alias("_v"))
    points = points.select(*keys, "_t", F.lit(0 if strict else 1).alias("_side"), F.lit(None).cast(marks.schema["_v"].dataType).alias("_v"))
    both = marks.unionByName(points)
    here = F.col("_side") == (0 if strict else 1)
    if width is None:
        whole = Window.partitionBy(*keys).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
        near = both.withColumn("_near", F.last("_v", ignorenulls=True).over(whole)).where(here)
        return near.select(*keys, (F.col("_t") * sign).alias(time), F.col("_near")["v"].alias(value))
    both = both.withColumn("_r", _range("_t", width))

    order = Window.partitionBy(*keys, "_r").orderBy("_t", "_side")
    inside = both.withColumn("_near", F.last("_v", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    ends = both.groupBy(*keys, "_r").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col("_t"))).alias("_end"))
    ranges = Window.partitionBy(*keys).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*keys, "_r", F.last("_end", ignorenulls=True).over(ranges).alias("_carry"))
    found = inside.where(here).join(carried, [*keys, "_r"])
    return found.select(*keys, (F.col("_t") * sign).alias(time), F.coalesce("_near", "_carry")["v"].alias(value))

"""Arrays per key in one level and in two."""

import pytest
from pyspark.sql import functions as F

from possum.operators.collect import collect_arrays


@pytest.mark.parametrize("spread", [False, True])
def test_arrays_in_order_with_sums(spark, spread):
    rows = [(g, i * 7 % 50, None if i % 9 == 0 else f"v{i}") for g in (1, 2, None) for i in range(50)]
    df = spark.createDataFrame(rows, "g long, k long, v string")
    got = collect_arrays(df, ["g"], "k", F.col("v"), "a", {"n": F.lit(1)}, spread=spread)
    want = {g: ([v for _, k, v in sorted(r for r in rows if r[0] == g and r[2]) for v in [v]], 50) for g in (1, 2)}
    want[None] = ([v for k, v in sorted((r[1], r[2]) for r in rows if r[0] is None and r[2])], 50)
    assert {r["g"]: (r["a"], r["n"]) for r in got.collect()} == want


def test_elements_move_once_unless_spread(spark):
    df = spark.range(100).select((F.col("id") % 10).alias("g"), F.col("id").alias("k"))
    plans = [collect_arrays(df, ["g"], "k", F.col("k"), "a", spread=s)._jdf.queryExecution().executedPlan().toString() for s in (False, True)]
    assert [p.count("Exchange hashpartitioning") for p in plans] == [1, 2]

"""Property tests: the cleaning rules against plain-Python statements of the
same rules, many generated values per Spark job."""

import os
import re
from decimal import ROUND_HALF_UP, Decimal, InvalidOperation

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from possum.functions import cleaning as C

ZIPS = st.one_of(
    st.from_regex(r"\A[0-9]{1,7}(-[0-9]{4})?\Z"),
    st.from_regex(r"\A[ a-z0-9-]{0,8}\Z"),
    st.just(""),
)
PRICES = st.one_of(
    st.decimals(min_value=0, max_value=99999, places=2).map(lambda d: f'"${d:,.2f}"'),
    st.from_regex(r"\A[$,\"0-9.a]{0,10}\Z"),
)


def zip_rule(s):
    m = re.fullmatch(r"(\d{1,5})(?:\D.*)?", s.strip(), flags=re.S | re.ASCII)
    return None if m is None else m.group(1).zfill(5)


def price_rule(s):
    t = re.sub(r'[$,"]', "", s).strip()
    if not t:
        return None
    try:
        d = Decimal(t)
    except InvalidOperation:
        return None
    if not d.is_finite():
        return None
    q = d.quantize(Decimal("0.01"), rounding=ROUND_HALF_UP)
    return q if abs(q) < Decimal("10000") else None


@settings(max_examples=int(os.environ.get("PROPERTY_EXAMPLES", "5")), deadline=None)
@given(st.lists(ZIPS, min_size=1, max_size=200))
def test_zip_rule(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = [r["z"] for r in df.select(C.parse_zip(F.col("v")).alias("z")).collect()]
    assert got == [zip_rule(v) for v in values]


@settings(max_examples=int(os.environ.get("PROPERTY_EXAMPLES", "5")), deadline=None)
@given(st.lists(PRICES, min_size=1, max_size=200))
def test_price_rule(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = [r["p"] for r in df.select(C.parse_price(F.col("v")).alias("p")).collect()]
    assert got == [price_rule(v) for v in values]

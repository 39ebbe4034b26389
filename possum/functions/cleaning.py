"""Scalar cleaning rules for raw POS text (F1-F16).

Every rule is a built-in Column expression, so it runs inside whole-stage
codegen; all parsing uses ``try_*`` forms because ANSI mode is on by default and
one bad value must not stop a job (it becomes a reject instead).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from possum import fixed
from possum.schemas import PRICE

ColumnOrName = Column | str


def _c(col: ColumnOrName) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip_quotes(col: ColumnOrName) -> Column:
    """remove double quotes at both ends only; quotes inside stay."""
    return F.btrim(_c(col), F.lit(fixed.QUOTE))


def null_if_empty(col: ColumnOrName) -> Column:
    """the empty string becomes null."""
    return F.nullif(_c(col), F.lit(""))


def null_if_cancelled(col: ColumnOrName) -> Column:
    """the ship date sentinel ``Cancelled`` becomes null."""
    return F.nullif(_c(col), F.lit(fixed.SHIP_DATE_SENTINEL))


def parse_us_date(col: ColumnOrName) -> Column:
    """``m/d/Y`` text to DATE; one- or two-digit month and day; bad text is null."""
    return F.try_to_date(_c(col), fixed.BIRTHDATE_FORMAT)


def parse_datetime_to_date(col: ColumnOrName) -> Column:
    """``Y-m-d H:M:S`` text to a DATE (the time of day is cut off)."""
    return F.try_to_timestamp(_c(col), F.lit(fixed.ORDER_TIME_FORMAT)).cast("date")


def parse_zip(col: ColumnOrName) -> Column:
    """F6 and F16: a zip code kept as five zero-padded characters.

    ``01234`` and ``1234`` give ``01234``; a ZIP+4 such as ``55501-1234`` gives
    ``55501``; empty text, text without leading digits or more than five digits
    give null.
    """
    w = fixed.ZIP_WIDTH
    digits = F.regexp_extract(F.trim(_c(col)), rf"^(\d{{1,{w}}})(?:\D.*)?$", 1)
    number = F.nullif(digits, F.lit("")).try_cast(f"decimal({w},0)")
    return F.lpad(number.cast("string"), w, "0")


def parse_price(col: ColumnOrName) -> Column:
    """F7 and F8: ``"$1,234.50"`` to DECIMAL(6,2); overflow or junk is null."""
    cleaned = F.regexp_replace(_c(col), fixed.PRICE_STRIP, "")
    return F.nullif(F.trim(cleaned), F.lit("")).try_cast(PRICE)


def parse_long(col: ColumnOrName) -> Column:
    """Typed key from text; junk is null (and lands in the rejects)."""
    return F.trim(strip_quotes(col)).try_cast("bigint")


def parse_int(col: ColumnOrName) -> Column:
    return F.trim(strip_quotes(col)).try_cast("int")


def full_name(first: ColumnOrName, last: ColumnOrName) -> Column:
    """``first last``; null when either part is null, as CONCAT does."""
    return F.concat(_c(first), F.lit(fixed.NAME_SEP), _c(last))


def printed_address1(address1: ColumnOrName, address2: ColumnOrName) -> Column:
    """address line 1, with `` #`` and the second line when there is one."""
    a2 = _c(address2)
    suffix = F.when(a2.isNotNull(), F.concat(F.lit(fixed.ADDRESS2_MARK), a2)).otherwise(F.lit(""))
    return F.concat(_c(address1), suffix)


def printed_address2(city: ColumnOrName, state: ColumnOrName, zip_: ColumnOrName) -> Column:
    """``City, ST   zip`` with three spaces before the padded zip."""
    return F.concat(_c(city), F.lit(fixed.CITY_STATE_SEP), _c(state), F.lit(fixed.STATE_ZIP_SEP), _c(zip_))


def round_money(col: ColumnOrName) -> Column:
    """round half up to cents, as a DECIMAL(18,2)."""
    return F.round(_c(col), fixed.MONEY_SCALE).cast(f"decimal(18,{fixed.MONEY_SCALE})")

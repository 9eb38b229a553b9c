"""Decimals of up to 38 digits and times in nanoseconds as expressions.

The scale of a literal such as ``12.50m`` is that of its digits.  Division is Spark's: it keeps digits
after the point, where integer division of coefficients would lose them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A decimal literal: digits with an optional point and the suffix m.
LITERAL = r"^-?\d{1,38}(\.\d{1,37})?m$"


def is_literal(text: Column) -> Column:
    return F.coalesce(text.rlike(LITERAL), F.lit(False))


def from_literal(text: Column, scale: int = 6) -> Column:
    """A literal as decimal(38, scale); null for any other text or for too many digits."""
    return F.when(is_literal(text), F.regexp_replace(text, "m$", "").try_cast(f"decimal(38,{scale})"))


def to_literal(value: Column) -> Column:
    return F.concat(value.cast("string"), F.lit("m"))


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1, whatever the scales."""
    return F.when(a < b, -1).when(a > b, 1).otherwise(0)


def timestamp_of_nanos(nanos: Column) -> Column:
    """Nanoseconds since 1970 as a timestamp; the last three digits are dropped."""
    return F.timestamp_micros(_whole(nanos, 1000))


def _whole(nanos: Column, unit: int) -> Column:
    """Whole units, rounded down, in integers: a double holds times of today to some 256 nanoseconds alone."""
    return F.call_function("div", nanos - F.pmod(nanos, F.lit(unit)), F.lit(unit))


def rfc3339_of_nanos(nanos: Column) -> Column:
    """Nanoseconds since 1970 as RFC 3339 text in UTC with nine digits."""
    whole, rest = _whole(nanos, 1_000_000_000), F.pmod(nanos, F.lit(1_000_000_000))
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(whole / 86400).cast("int"))
    second = F.pmod(whole, F.lit(86400))
    clock = [F.lpad(F.floor(second / 3600).cast("string"), 2, "0"), F.lpad(F.floor(second % 3600 / 60).cast("string"), 2, "0"), F.lpad((second % 60).cast("string"), 2, "0")]
    return F.concat(day.cast("string"), F.lit("T"), F.concat_ws(":", *clock), F.lit("."), F.lpad(rest.cast("string"), 9, "0"), F.lit("Z"))

"""Timestamp column expressions.

Canonical ticket timestamps are ``TIMESTAMP_NTZ`` holding UTC wall-clock time
(naive input is UTC).  Text with an explicit zone is converted to UTC.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tixflow.config import TIMESTAMP_FORMATS


def parse_timestamp(c: Column, dtype: T.DataType, formats: list[str] | None = None) -> Column:
    """Parse a column to UTC ``TIMESTAMP_NTZ``; failures become NULL."""
    if isinstance(dtype, T.TimestampNTZType):
        return c
    if isinstance(dtype, (T.TimestampType, T.DateType)):
        return c.cast("timestamp_ntz")
    if isinstance(dtype, T.NullType):
        return F.lit(None).cast("timestamp_ntz")
    text = F.trim(c.cast("string"))
    fmts = formats or TIMESTAMP_FORMATS
    # try_to_timestamp is zone-aware; with the session in UTC the cast to
    # NTZ yields UTC wall-clock time.
    tries = [F.try_to_timestamp(text, F.lit(f)) for f in fmts]
    return F.coalesce(*tries).cast("timestamp_ntz")


def hours_between(start: Column, end: Column) -> Column:
    """(end - start) in fractional hours; NULL when either side is NULL."""
    return F.timestamp_diff("MICROSECOND", start, end).cast("double") / F.lit(3_600_000_000.0)


def as_of_literal(as_of: datetime | str | None) -> Column:
    """Reference time as a ``TIMESTAMP_NTZ`` column (default: now, UTC)."""
    if as_of is None:
        return F.current_timestamp().cast("timestamp_ntz")
    if isinstance(as_of, datetime):
        as_of = as_of.strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.lit(as_of).cast("timestamp_ntz")

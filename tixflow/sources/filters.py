"""Source-side predicates (S7) and the preview.

Applied to the raw frame before normalisation, so Catalyst pushes the
timestamp bound and the equality filters into the scan (``PushedFilters``).
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tixflow.functions.time import as_of_literal, parse_timestamp
from tixflow.operators.normalize import rename_aliases


def trailing_window(raw: DataFrame, days: int, as_of: datetime | str | None = None,
                    filters: list[tuple[str, str] | Column] | None = None,
                    ts_col: str = "opened_at", timestamp_formats: list[str] | None = None) -> DataFrame:
    """Rows opened within ``days`` before ``as_of`` that meet every filter.

    A filter is a ``(column, value)`` equality or any boolean column.  Headers
    are resolved to canonical names first, and text timestamps are parsed in
    the same formats as in ``normalize``.
    """
    raw = rename_aliases(raw)
    since = F.timestamp_add("DAY", F.lit(-int(days)), as_of_literal(as_of))
    out = raw.where(parse_timestamp(F.col(ts_col), raw.schema[ts_col].dataType, timestamp_formats) >= since)
    for f in filters or []:
        out = out.where(F.col(f[0]) == F.lit(f[1]) if isinstance(f, tuple) else f)
    return out


def preview(tickets: DataFrame, columns: list[str], n: int = 200) -> DataFrame:
    """First ``n`` rows in ingest order of the listed columns that exist."""
    cols = [c for c in columns if c in tickets.columns]
    return tickets.orderBy("ingest_ord").limit(n).select(*cols)

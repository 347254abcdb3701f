"""Small dictionary lookups as map literals (folded into the projection)."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F


def map_literal(mapping: dict[str, str]) -> Column:
    """A ``MAP<STRING,STRING>`` literal; fine for rule tables of a few dozen keys."""
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])


def lookup(key: Column, mapping: dict[str, str]) -> Column:
    """Value for ``key`` or NULL when absent."""
    return F.try_element_at(map_literal(mapping), key)

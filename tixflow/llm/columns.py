"""Column expressions shared by the operators that use built-in functions only."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE_WORDS = r"[\x20\x09-\x0D]+"


def fold_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else (``lower`` alone does so for pure ASCII)."""
    pure = F.octet_length(text) == F.char_length(text)
    return F.when(pure, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def split_words(text: Column, separators: str) -> Column:
    return F.array_remove(F.split(text, separators), "")


def hashed(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def gram_hash(hashes: Column, at: Column, k: int) -> Column:
    """Hash of ``k`` word hashes from 0-based position ``at`` (those there are)."""
    return F.xxhash64(F.lit(k), *(F.get(hashes, at + j) for j in range(k)))

"""Text column expressions (all JVM-side built-ins, no Python UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tixflow.config import STOP_WORDS


def strip_ws(c: Column) -> Column:
    """Strip leading/trailing whitespace of any kind (Python ``str.strip``)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def clean_text(c: Column) -> Column:
    """Lower-case, every char outside ``[a-z0-9 ]`` -> space, collapse, strip."""
    lowered = F.lower(F.coalesce(c.cast("string"), F.lit("")))
    return F.trim(F.regexp_replace(lowered, "[^a-z0-9]+", " "))  # one pass: a run of other characters and spaces is one space


def title_case(c: Column) -> Column:
    """Python ``str.title()``: upper-case the first letter of each letter run.

    ``initcap`` only splits on white space (``awaiting-info`` ->
    ``Awaiting-info``), so split into letter / non-letter runs first.
    """
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}+|[^\p{L}]+)"), 1)
    return F.array_join(F.transform(runs, lambda r: F.initcap(r)), "")


def word_tokens(cleaned: Column) -> Column:
    """Tokens of >= 2 chars of an already cleaned text (default vectoriser rule)."""
    return F.filter(F.split(cleaned, " "), lambda t: F.length(t) >= 2)


def unicode_word_tokens(text: Column) -> Column:
    """Tokens of >= 2 Unicode word chars of lower-cased raw text."""
    return F.regexp_extract_all(
        F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}_]{2,})"), 1)


def drop_stop_words(tokens: Column, stop_words: list[str] | None = None) -> Column:
    """Remove stop words, keeping order and repeats (not ``array_except``)."""
    words = STOP_WORDS if stop_words is None else stop_words
    if not words:
        return tokens
    return F.filter(tokens, lambda t: ~t.isin(words))  # a hash set in the plan


def with_bigrams(tokens: Column) -> Column:
    """Unigrams followed by adjacent bigrams (n-gram range 1..2).

    ``tokens`` is bound once as the variable of a one-element ``transform``:
    named several times, its whole expression would be evaluated as often.
    ``zip_with`` of the array and its one-step shift is linear in the tokens.
    """
    def both(t: Column) -> Column:
        shifted = F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0)))
        pairs = F.zip_with(t, shifted, lambda a, b: F.concat(a, F.lit(" "), b))
        return F.concat(t, F.filter(pairs, lambda x: x.isNotNull()))

    return F.get(F.transform(F.array(tokens), both), 0)


def vectoriser_terms(text: Column, stop_words: list[str] | None = STOP_WORDS,
                     clean: bool = True) -> Column:
    """Array of 1- and 2-gram terms of a text, as the vectorisers see them.

    ``clean=True``: the pattern / root-cause path (clean, stop words removed).
    ``clean=False``: the classifier path (raw lower-cased text, Unicode words).
    """
    if clean:
        toks = word_tokens(clean_text(text))
    else:
        toks = unicode_word_tokens(text)
    if stop_words:
        toks = drop_stop_words(toks, stop_words)
    return with_bigrams(toks)

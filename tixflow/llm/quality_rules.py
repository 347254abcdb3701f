"""Quality rules by a threshold table compiled into one projection (operator 13).

``METRICS`` names the counts of a text (lengths, symbols, stop words, lines,
repeats) and ``RULES`` is a table of thresholds on them.  ``with_metrics`` adds
the counts and ``with_verdict`` compiles the table to Spark columns; both are
projections of built-in functions, with no shuffle and no user function.
Ratios are compared as products of whole numbers, so a verdict does not depend
on rounding.

A text's three-word windows are sorted once as longs (the window's hash above
its position), so that equal windows are neighbours; neighbours are compared
word by word, and the words they cover are counted from their sorted positions.
Time and memory of a row grow with its own text (times the logarithm of its
length for the sort).

Defined results: a null or empty text has no words and fails the base rules;
rows are judged one by one, so repeated rows give repeated result rows; other
columns are kept by ``apply_rules`` (but those named like a metric or verdict,
which are replaced) and all by ``drop_failing``; an empty table gives an empty
result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tixflow.llm.columns import SPACE_WORDS, fold_ascii, split_words
from tixflow.llm.common import read_table

# Symbols of the symbol rule, bullets and ellipses of the line rules.
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
BULLETS = "-*•‣●▪"
# Frequent function words of the languages served, lower case.
STOP_WORDS = {
    "en": ["the", "of", "and", "to", "a", "in", "is", "that", "it", "for", "was", "on", "with", "as", "be", "by", "are", "this", "at", "from", "have"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "sich", "mit", "des", "auf", "ist", "im", "nicht", "dem", "ein", "eine", "als"],
    "fr": ["de", "la", "le", "et", "les", "en", "des", "un", "du", "une", "que", "est", "pour", "par", "dans", "avec", "qui", "pas", "sur", "au"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "las", "se", "del", "un", "por", "con", "no", "una", "su", "para", "es", "al", "lo"],
}
STOPS = sorted({w for words in STOP_WORDS.values() for w in words})


@dataclass(frozen=True)
class Rule:
    """A text fails if ``scale * metric`` is beyond ``bound * per`` (``per`` None: ``bound`` itself)."""

    name: str
    metric: str
    beyond: str  # "<" or ">"
    bound: int
    per: str | None = None
    scale: int = 1
    base: bool = False

    def sql(self) -> str:
        """The condition under which a text fails, as an expression over the metrics."""
        left = self.metric if self.scale == 1 else f"{self.scale} * {self.metric}"
        right = str(self.bound) if self.per is None else f"{self.bound} * {self.per}"
        return f"{left} {self.beyond} {right}"


RULES = [
    Rule("few_words", "n_words", "<", 50, base=True),
    Rule("repeated_words", "n_repeat_words", ">", 50, "n_words", 100, base=True),
    Rule("many_words", "n_words", ">", 100_000),
    Rule("short_words", "word_chars", "<", 3, "n_words"),
    Rule("long_words", "word_chars", ">", 10, "n_words"),
    Rule("symbols", "n_symbols", ">", 10, "n_words", 100),
    Rule("few_letters", "n_letter_words", "<", 80, "n_words", 100),
    Rule("few_stop_words", "n_stop_words", "<", 6, "n_words", 100),
    Rule("repeated_lines", "n_dup_lines", ">", 30, "n_lines", 100),
    Rule("bullet_lines", "n_bullet_lines", ">", 90, "n_lines", 100),
    Rule("cut_lines", "n_cut_lines", ">", 30, "n_lines", 100),
]
METRICS = ["n_words", "word_chars", "n_symbols", "n_letter_words", "n_stop_words", "n_lines", "n_dup_lines", "n_bullet_lines", "n_cut_lines", "n_repeat_words"]


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), 0)


def _chars_of(text: Column, chars: str) -> Column:
    return F.char_length(text) - F.char_length(F.translate(text, chars, ""))


def _gram_keys(words: Column, bits: Column, k: int) -> Column:
    """One long per ``k``-word window: the window's hash above ``bits`` bits that hold its position."""
    head = F.slice(words, F.lit(1), F.size(words) - (k - 1))
    return F.transform(head, lambda x, i: F.call_function("shiftleft", F.xxhash64(x, *(F.get(words, i + j) for j in range(1, k))), bits).bitwiseOR(i.cast("long")))


def _covered(words: Column, keys: Column, bits: Column, k: int) -> Column:
    """Words covered by the windows whose sorted key has a neighbour of equal hash and equal words."""
    place = lambda x: F.call_function("shiftrightunsigned", F.call_function("shiftleft", x, F.lit(64) - bits), F.lit(64) - bits).cast("int")

    def twin(x: Column, y: Column) -> Column:
        near = F.call_function("shiftrightunsigned", x.bitwiseXOR(y), bits) == 0  # null beside the ends
        for j in range(k):
            near = near & (F.get(words, place(x) + j) == F.get(words, place(y) + j))
        return near

    found = F.filter(keys, lambda x, i: F.coalesce(twin(x, F.get(keys, i - 1)), F.lit(False)) | F.coalesce(twin(x, F.get(keys, i + 1)), F.lit(False)))
    step = lambda p: F.transform(p, lambda x, i: F.least(F.coalesce(F.get(p, i + 1) - x, F.lit(k)), F.lit(k)))
    return let(F.sort_array(F.transform(found, place)), lambda p: F.aggregate(step(p), F.lit(0).cast("long"), lambda acc, x: acc + x))


def repeated_words(words: Column, k: int = 3) -> Column:
    """Number of words in ``k``-word windows that are found twice or more in ``words``."""
    def count(w: Column) -> Column:
        return let(F.length(F.bin(F.size(w))), lambda b: let(F.sort_array(_gram_keys(w, b, k)), lambda s: _covered(w, s, b, k)))

    return F.when(F.size(words) <= k, F.lit(0).cast("long")).otherwise(count(words))


def with_metrics(df: DataFrame, text: str = "text") -> DataFrame:
    """Add the columns of ``METRICS`` (long) for the string column ``text``."""
    cols = df.columns
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    words = split_words(t, SPACE_WORDS)
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    letters = split_words(F.regexp_replace(t, r"[^\p{L}\x20\x09-\x0D]+", ""), SPACE_WORDS)
    terms = F.split(fold_ascii(t), r"[^\p{L}]+")
    n_of = lambda array, test: F.size(F.filter(array, test))
    trimmed = lambda x: F.btrim(x, F.lit(SPACES))
    found = {
        "n_words": let(words, lambda w: F.struct(F.size(w).alias("n"), F.char_length(F.array_join(w, "")).alias("c"), repeated_words(w).alias("r"))),
        "n_symbols": _chars_of(t, SYMBOLS),
        "n_letter_words": F.size(letters),
        "n_stop_words": n_of(terms, lambda x: x.isin(STOPS)),
        "n_lines": let(lines, lambda a: F.struct(F.size(a).alias("n"), F.size(F.array_distinct(a)).alias("d"),
                                                 n_of(a, lambda x: F.position(F.substring(trimmed(x), 1, 1), F.lit(BULLETS)) > 0).alias("b"),
                                                 n_of(a, lambda x: let(trimmed(x), lambda y: F.endswith(y, F.lit("…")) | F.endswith(y, F.lit("...")))).alias("c"))),
    }
    df = df.select(*cols, *(c.alias(f"_m_{name}") for name, c in found.items()))
    w, ln = F.col("_m_n_words"), F.col("_m_n_lines")
    split = {"n_words": w["n"], "word_chars": w["c"], "n_repeat_words": w["r"], "n_lines": ln["n"], "n_dup_lines": ln["n"] - ln["d"], "n_bullet_lines": ln["b"], "n_cut_lines": ln["c"]}
    return df.select(*cols, *(split.get(name, F.col(f"_m_{name}")).cast("long").alias(name) for name in METRICS))


def with_verdict(df: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """Add base_failed, failed (names of the rules that a text fails, in the table's order) and kept."""
    rules = RULES if rules is None else rules
    base = [F.expr(r.sql()) for r in rules if r.base]
    names = F.filter(F.array(*(F.when(F.expr(r.sql()), F.lit(r.name)) for r in rules)), lambda x: x.isNotNull())
    any_base = F.lit(False)
    for c in base:
        any_base = any_base | c
    return df.withColumns({"base_failed": any_base, "failed": names}).withColumn("kept", F.size("failed") == 0)


def apply_rules(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """``docs`` with the metrics, base_failed, failed and kept; same-named columns of ``docs`` are replaced."""
    own = {*METRICS, "base_failed", "failed", "kept"}
    return with_verdict(with_metrics(docs.select(*(c for c in docs.columns if c not in own))), rules)


def drop_failing(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """The rows of ``docs`` whose text passes every rule, with all their columns."""
    judged = with_verdict(with_metrics(docs.select("text", F.struct(*docs.columns).alias("_row"))), rules)
    return judged.where("kept").select("_row.*")


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = apply_rules(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                    "n_letter_words", "n_stop_words", "n_lines", "n_bullet_lines", "n_cut_lines", F.array_join("failed", ",").alias("failed"))

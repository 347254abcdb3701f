"""Periodic runs of words by multi-scale minimizers (operator 11).

A run is a stretch of consecutive words with smallest period q and at least
``max(MIN_WORDS, MIN_PERIODS * q)`` words that no neighbouring word extends
keeping the period.

Periods of up to ``SHORT`` words are scanned directly: for every lag the words
equal to the word a lag further form stretches.  Longer periods are met by
scale.  Scale k serves the periods above k / 2 and up to k.  It hashes every
sequence of k words and keeps the window minima over k / 2 sequences: inside a
run the windows one period apart are alike, so every minimum repeats at period
distance.  As k is at least the period, equal sequences inside the run are
apart by multiples of the period only, so the pair is one of neighbours among
the kept sequences of equal hash; and because two equal sequences of k words at
distance q <= k already are a stretch with period q, a seed is never a chance
repeat.  A seed is extended in both directions as far as words one period apart
are equal, by binary search over prefix hashes, with all seeds of a scale at
once.  A stretch found with a multiple of its period has the same ends as with
the smallest one, which stays.  No text or scale is cut short: the time of a
text of n words is about n log n.

Words are 64-bit hashes of their bytes, made on whole Arrow buffers.  Each task
works on slices of about 2 MB of text, a longer text alone; nothing is shuffled.

Defined results: a null or empty text has no words and no runs; rows are judged
one by one, so repeated rows give repeated result rows; other columns are kept,
those named like a result are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tixflow.llm import kernel
from tixflow.llm.columns import SPACE_WORDS, split_words
from tixflow.llm.common import doc_chunks, read_table

MIN_WORDS, MIN_PERIODS, SHORT = 6, 4, 16
RUN = ["start", "length", "period"]


def _ends(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """End of the text that each word is in."""
    return np.repeat(off[1:], np.diff(off))[:len(h)]


def short_runs(h: np.ndarray, off: np.ndarray, lag: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every longest stretch whose words equal those ``lag`` further, of MIN_PERIODS lags at least."""
    n = len(h)
    if n <= lag:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    same = np.zeros(n + 1, np.int8)
    same[1:n - lag + 1] = h[:-lag] == h[lag:]
    cut = off[1:-1]
    for j in range(1, lag + 1):  # pairs across the end of a text
        at = cut - j
        same[at[at >= 0] + 1] = 0
    edge = np.flatnonzero(np.diff(np.append(same, 0)))
    s, e = edge[::2], edge[1::2] + lag
    long = e - s >= max(MIN_WORDS, MIN_PERIODS * lag)
    return s[long], e[long]


def _window_extreme(x: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` over x[i:i + width] for every i with a whole window, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = pick(x[:-step], x[step:])
        have += step
    return x


def seeds(h: np.ndarray, end: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Position and distance of neighbouring equal minimizers of ``k`` words that are more than k / 2 and at most k apart."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    width = k // 2
    if len(h) < k + width:
        return none
    g = kernel.grams(h, k)
    g[np.arange(k, len(h) + 1) > end[:len(g)]] = np.iinfo(np.uint64).max  # not inside one text
    least = _window_extreme(g, width, np.minimum)
    # kept: the least of some window around; windows that reach over an end only keep more
    pad = np.zeros(width - 1, np.uint64)
    best = _window_extreme(np.concatenate([pad, least, pad]), width, np.maximum)
    at = np.flatnonzero((best == g) & (g != np.iinfo(np.uint64).max))
    at = at[np.argsort(g[at], kind="stable")]
    gap = np.diff(at)
    pair = (g[at[1:]] == g[at[:-1]]) & (gap > width) & (gap <= k) & (end[at[1:]] == end[at[:-1]])
    return at[:-1][pair], gap[pair]


class _Prefix:
    """Hashes of any stretch of words."""

    def __init__(self, h: np.ndarray):
        self.up, self.down = kernel._GRAMS.get(len(h) + 1)
        self.acc = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * self.up[:len(h)], out=self.acc[1:])

    def same(self, i: np.ndarray, j: np.ndarray, n: np.ndarray) -> np.ndarray:
        return (self.acc[i + n] - self.acc[i]) * self.down[i] == (self.acc[j + n] - self.acc[j]) * self.down[j]


def _most(low: np.ndarray, high: np.ndarray, holds) -> np.ndarray:
    """Greatest value from ``low`` to ``high`` for which ``holds`` (true up to some value, and at ``low``)."""
    low, high = low.copy(), high.copy()
    while (open_ := low < high).any():
        mid = (low + high + 1) // 2
        ok = holds(mid)
        low = np.where(open_ & ok, mid, low)
        high = np.where(open_ & ~ok, mid - 1, high)
    return low


def extend(prefix: _Prefix, begin: np.ndarray, end: np.ndarray, at: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the longest stretch with period ``q`` around each pair (at, at + q)."""
    zero = np.zeros_like(at)
    right = _most(zero, end - at - q, lambda n: prefix.same(at, at + q, n))
    left = _most(zero, at - begin, lambda n: prefix.same(at - n, at + q - n, n))
    return at - left, at + q + right


def find_runs(h: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, start (in its text), length and period of every run, by text, start and period."""
    found = []
    for lag in range(1, SHORT + 1):
        s, e = short_runs(h, off, lag)
        found.append((s, e, np.full(len(s), lag, np.int64)))
    longest = int(np.diff(off).max(initial=0))
    end = _ends(h, off)
    begin = np.repeat(off[:-1], np.diff(off))
    prefix, k = None, 2 * SHORT
    while MIN_PERIODS * (k // 2 + 1) <= longest:
        at, q = seeds(h, end, k)
        if len(at):
            prefix = prefix or _Prefix(h)
            s, e = extend(prefix, begin[at], end[at], at, q)
            long = e - s >= np.maximum(MIN_WORDS, MIN_PERIODS * q)
            s, e, q = np.unique(np.stack([s[long], e[long], q[long]]), axis=1) if long.any() else np.zeros((3, 0), np.int64)
            found.append((s, e, q))
        k *= 2
    s, e, q = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((q, e, s))
    s, e, q = s[order], e[order], q[order]
    least = np.ones(len(s), bool)
    least[1:] = (s[1:] != s[:-1]) | (e[1:] != e[:-1])  # others are multiples of the smallest period
    s, e, q = s[least], e[least], q[least]
    order = np.lexsort((q, s))
    s, e, q = s[order], e[order], q[order]
    text = np.searchsorted(off, s, side="right") - 1
    return text, s - off[text], e - s, q


def collapse(text: bytes, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> bytes:
    """The words that no run contains after its first period, joined by one space."""
    words = text.split()
    if len(start):
        edge = np.zeros(len(words) + 1, np.int64)
        np.add.at(edge, start + period, 1)
        np.add.at(edge, start + length, -1)
        words = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
    return b" ".join(words)


def periodic_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, runs (start, length, period; by start, then period) and collapsed (the text without repeats)."""
    own = ["n_words", "runs", "collapsed"]
    cols = [c for c in docs.columns if c not in own]
    rest = F.struct(*(c for c in cols if c != text)) if len(cols) > 1 else F.struct(F.lit(None).cast("int").alias("_none"))
    src = docs.select(rest.alias("rest"), F.col(text).cast("string").alias("text"))
    schema = T.StructType([*src.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(T.StructType([T.StructField(c, T.IntegerType()) for c in RUN]))),
                           T.StructField("collapsed", T.StringType())])

    def run(batches):
        for b in batches:
            for i, j, data, off in doc_chunks(b, "text"):
                h, _, _, wo = kernel.words(data, off)
                t, s, n, q = find_runs(h, wo)
                per = np.searchsorted(t, np.arange(j - i + 1))
                raw = data.tobytes()
                kept = [collapse(raw[off[d]:off[d + 1]], s[x:y], n[x:y], q[x:y]).decode() for d, (x, y) in enumerate(zip(per[:-1].tolist(), per[1:].tolist(), strict=True))]
                runs = pa.ListArray.from_arrays(pa.array(per.astype(np.int32)), pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in (s, n, q)], names=RUN))
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(i, j - i) for c in range(2)), pa.array(np.diff(wo), pa.int64()), runs, pa.array(kept, pa.string())], names=["rest", "text", *own])

    out = src.mapInArrow(run, schema)
    return out.select(*(F.col("text").alias(c) if c == text else F.col("rest").getField(c).alias(c) for c in cols), *own)


def best_run(runs: Column) -> Column:
    """The run of greatest length / period, exactly; ties: smallest start, then period (runs are in that order)."""
    better = lambda x, y: x["length"].cast("long") * y["period"] > y["length"].cast("long") * x["period"]
    return F.aggregate(runs, F.get(runs, 0), lambda best, x: F.when(better(x, best), x).otherwise(best))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text; of every tenth document (by crc32 of its id), the words from one on repeat a stretch of its words."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    d = d.withColumn("h", h)

    def rewritten(w: Column) -> Column:
        n, g = F.size(w), F.floor(F.col("h") / 10)
        a = g % n
        at = F.array(F.struct(w.alias("w"), a.cast("int").alias("a"), (F.floor((n - a) / (3 + g % 8)) + 1).cast("int").alias("p")))
        new = F.transform(at, lambda x: F.array_join(F.transform(x["w"], lambda v, i: F.when(i < x["a"], v).otherwise(F.get(x["w"], x["a"] + (i - x["a"]) % x["p"]))), " "))
        return F.when(n > 0, F.get(new, 0)).otherwise(F.col("text"))

    words = F.array(split_words(F.col("text"), SPACE_WORDS))
    return d.select("doc_id", F.when(F.col("h") % 10 == 0, F.get(F.transform(words, rewritten), 0)).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = periodic_runs(with_planted_runs(read_table(spark, sf_dir, "documents")))
    best = best_run(F.col("runs"))
    line = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    d = d.select("doc_id", "n_words", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return d.select("doc_id", "n_runs", *(F.col(f"best.{c}").cast("long").alias(c) for c in RUN),
                    F.floor(1000 * F.col("best.length").cast("long") / F.col("best.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256", "n_words")

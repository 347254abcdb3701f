"""Benchmark decontamination by a broadcast set of n-grams (operator 9).

The normalised test n-grams are hashed into a table that is broadcast in parts
of at most ``MAX_GRAMS`` rows (its size is counted first; a larger benchmark
is scanned part by part, so the broadcast never grows).  Every training
window is hashed and looked up; a hit is verified word by word in the same
join.  The documents are read once and only hits are shuffled.  Built-in
functions only.

Defined results: a null or empty text or item has no words and hits nothing;
an item of fewer words than a window is one window; equal items each count;
rows of equal id and text repeat the result; other columns are ignored; an
empty benchmark or table gives documents without hits, or nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tixflow.llm.columns import fold_ascii, gram_hash, hashed, split_words
from tixflow.llm.common import read_table

WINDOW = 10
MAX_GRAMS = 500_000
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(df: DataFrame, key: str) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return df.select(F.col(key), text.alias("text")).withColumn("words", split_words(fold_ascii(F.col("text")), SEPARATORS))


def benchmark_grams(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item, size, hash, gram): every distinct window of every item."""
    w = _words(benchmark.select(F.col("item_id").cast("string").alias("item"), "text"), "item").where("size(words) > 0")
    w = w.select("item", "words", F.least(F.size("words"), F.lit(window)).alias("size"))
    at = w.select("item", "size", "words", F.explode_outer(F.sequence(F.lit(0), F.size("words") - F.col("size"))).alias("at"))
    gram = at.select("item", "size", F.slice("words", F.col("at") + 1, F.col("size")).alias("gram")).distinct()
    h = hashed(F.col("gram"))
    gram = gram.withColumn("h", h)
    per_size = F.coalesce(*(F.when(F.col("size") == k, gram_hash(F.col("h"), F.lit(0), k)) for k in range(1, window + 1)))
    return gram.select("item", "size", per_size.alias("hash"), "gram")


def _windows(hashes: Column, n: Column, k: int) -> Column:
    """(at, size, hash) of every window of ``k`` words; null if there is none."""
    at = F.transform(F.sequence(F.lit(0), n - k), lambda i: F.struct(i.alias("at"), F.lit(k).alias("size"), gram_hash(hashes, i, k).alias("hash")))
    return F.when(n >= k, at)


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_grams: int = MAX_GRAMS) -> DataFrame:
    """Per distinct (doc_id, th): copies, n_words, hit spans and items."""
    grams = benchmark_grams(benchmark, window)
    sizes = {r["size"]: r["n"] for r in grams.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``window`` rows
    parts = max(1, math.ceil(sum(sizes.values()) / max_grams))
    w = _words(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id")
    w = w.select("doc_id", F.xxhash64("text").alias("th"), "words", hashed(F.col("words")).alias("h"))
    n = F.size("words")
    # one element without a hash stands for the document itself
    self_row = F.array(F.struct(F.lit(-1).alias("at"), F.lit(0).alias("size"), F.lit(None).cast("long").alias("hash")))
    wins = [_windows(F.col("h"), n, k) for k in sorted(sizes)]
    none = F.slice(self_row, 1, 0)
    w = w.select("doc_id", "th", "words", F.concat(self_row, *(F.coalesce(x, none) for x in wins)).alias("wins"))
    # outer, or the optimizer would compute the array once more to filter empty ones
    rows = w.select("doc_id", "th", "words", F.inline_outer("wins"))
    hits = None
    for p in range(parts):
        some = (grams.where(F.pmod("hash", F.lit(parts)) == p) if parts > 1 else grams).select("item", F.col("hash").alias("g_hash"), "gram")
        got = rows if not p else rows.where("at >= 0")
        # the words are compared behind the join, for rows whose hash was found only
        verified = F.col("item").isNotNull() & (F.slice("words", F.greatest("at", F.lit(0)) + 1, "size") == F.col("gram"))
        got = (got.join(F.broadcast(some), F.col("hash") == F.col("g_hash"), "left").where((F.col("at") < 0) | verified)
               .select("doc_id", "th", F.when(F.col("at") < 0, F.size("words")).alias("n_words"), "at", "size", "item"))
        hits = got if hits is None else hits.unionByName(got)
    return hits.groupBy("doc_id", "th").agg(  # bounded by one document's windows
        F.count("n_words").alias("copies"), F.max("n_words").alias("n_words"),
        F.collect_set(F.when(F.col("at") >= 0, F.struct("at", "size"))).alias("spans"), F.collect_set("item").alias("items"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_grams: int = MAX_GRAMS) -> DataFrame:
    """One row per document: n_words, n_hit, item ids and the hit spans."""
    h = find_hits(docs, benchmark, window, max_grams)
    covered = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["at"], s["at"] + s["size"] - 1))))
    h = h.select("doc_id", "th", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"), "n_words", F.size(covered).alias("n_hit"), F.sort_array("items").alias("items"), F.sort_array("spans").alias("spans"))
    return h.drop("copy")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without the documents that hold a benchmark window; all columns stay."""
    h = find_hits(docs.select("doc_id", "text"), benchmark, window).where("size(items) > 0").select(F.col("doc_id").alias("hit_id"), F.col("th").alias("hit_th"))
    th = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
    return docs.join(h, docs["doc_id"].cast("long").eqNullSafe(h["hit_id"]) & (th == h["hit_th"]), "left_anti")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return c.select("doc_id", F.col("n_words").cast("long").alias("n_words"), F.col("n_hit").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                    F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))

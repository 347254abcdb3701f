"""Document fingerprints by a threshold-scaled sketch (operator 2).

A fingerprint keeps every shingle hash below a fixed fraction ``1 / scale`` of
the hash range (FracMinHash).  What is kept depends on the hash alone, so the
fingerprint of a union is the union of fingerprints, and intersections
estimate containment and similarity without bias between texts of very
different length.  A text none of whose hashes is below the fraction keeps its
smallest one, so only a text without words has an empty fingerprint; merging
keeps the rule (drop that one when the union has a hash below the fraction).

``neighbours`` gives every row the next row's values in id order without a
global sort: rows go to id ranges whose bounds are ids of the table, and the
first row of a range is also sent, as a guest, to the range before it.  The
text is shuffled once.  Built-in functions only.

Defined results: a null text is empty; likeness of two empty fingerprints is
1, of one empty 0; rows of equal id follow in order of the text's hash, null
ids come first; the last row is followed by the first (a single row by
itself); other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tixflow.llm.columns import SPACE_WORDS, gram_hash, hashed, split_words
from tixflow.llm.common import read_table, shuffle_width

SHINGLE, SCALE = 5, 8
RANGES_PER_TASK = 4
STEP = 64  # range bounds are looked up in two steps of about this length


def with_sketch(df: DataFrame, text: str, out: str, k: int = SHINGLE, scale: int = SCALE) -> DataFrame:
    """Add the sorted array ``out`` of the hashes that ``text`` keeps."""
    last = -(1 << 63) + (1 << 64) // scale - 1
    cols = df.columns
    df = df.select(*cols, split_words(F.col(text), SPACE_WORDS).alias("_w"))
    df = df.select(*cols, hashed(F.col("_w")).alias("_h"))
    end = F.greatest(F.size("_h") - k, F.lit(0))
    grams = F.when(F.size("_h") > 0, F.transform(F.sequence(F.lit(0), end), lambda i: gram_hash(F.col("_h"), i, k)))
    df = df.select(*cols, F.coalesce(grams, F.array().cast("array<bigint>")).alias("_g"))
    df = df.select(*cols, F.array_min("_g").alias("_least"), F.filter("_g", lambda h: h <= last).alias("_f"))
    kept = F.when(F.size("_f") > 0, F.array_sort(F.array_distinct("_f"))).otherwise(F.filter(F.array("_least"), lambda h: h.isNotNull()))
    return df.select(*cols, kept.alias(out))


def fingerprint(sketch: Column) -> Column:
    """The hashes as fixed-width hex, in order."""
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two sketches."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the first sketch's text that the second holds."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def merge(a: Column, b: Column, scale: int = SCALE) -> Column:
    """Sketch of two texts' shingles together, from their sketches."""
    last = -(1 << 63) + (1 << 64) // scale - 1
    both = F.array_sort(F.array_union(a, b))
    low = F.filter(both, lambda h: h <= last)
    return F.when(F.size(low) > 0, low).otherwise(F.slice(both, 1, 1))


def neighbours(df: DataFrame, key: str, tie: str, values: list[str]) -> DataFrame:
    """Add ``next_<v>`` for each of ``values``: the next row's in (key, tie) order, cyclic."""
    n = max(1, RANGES_PER_TASK * shuffle_width(df.sparkSession))
    # one row of at most n bounds reaches the driver
    got = df.select(F.col(key).alias("k")).agg(F.min("k").alias("least"), F.percentile_approx("k", [i / n for i in range(1, n)] or [0.5], 100 * n).alias("cut"), F.max(F.col("k").isNull()).alias("nulls")).first()
    bounds = sorted({got["least"], *(got["cut"] or [])} - {None})
    coarse = F.array(*(F.lit(x).cast("long") for x in bounds[::STEP])) if bounds else F.array().cast("array<bigint>")
    fine = F.array(*(F.lit(x).cast("long") for x in bounds)) if bounds else F.array().cast("array<bigint>")
    k = F.coalesce(F.col(key), F.lit(bounds[0] if bounds else 0))
    df = df.withColumn("_c", F.size(F.filter(coarse, lambda x: x <= k)) - 1)
    df = df.withColumn("_r", F.col("_c") * STEP + F.size(F.filter(F.slice(fine, F.col("_c") * STEP + 1, STEP), lambda x: x <= k)) - 1 if bounds else F.lit(0))
    last = max(len(bounds) - 1, 0)
    head = F.col(key).isNull() if got["nulls"] else F.col(key) == F.lit(got["least"])
    starts = F.array_contains(fine, F.col(key)) & (F.col("_r") > 0)
    homes = F.concat(F.array(F.struct(F.col("_r").alias("range"), F.lit(False).alias("guest"))),
                     F.when(starts, F.array(F.struct((F.col("_r") - 1).alias("range"), F.lit(True).alias("guest")))).otherwise(F.array_repeat(F.struct(F.lit(0).alias("range"), F.lit(True).alias("guest")), 0)),
                     F.when(head, F.array(F.struct(F.lit(last).alias("range"), F.lit(True).alias("guest")))).otherwise(F.array_repeat(F.struct(F.lit(0).alias("range"), F.lit(True).alias("guest")), 0)))
    cols = [c for c in df.columns if c not in ("_c", "_r")]
    df = df.select(*cols, F.inline_outer(homes))
    w = Window.partitionBy("range").orderBy("guest", F.col(key).asc_nulls_first(), tie)
    return df.select(*cols, "guest", *(F.lead(v).over(w).alias(f"next_{v}") for v in values)).where("not guest").drop("guest")


def fingerprints(docs: DataFrame, k: int = SHINGLE, scale: int = SCALE) -> DataFrame:
    """doc_id, text, n_chars, sketch per document."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    df = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text.alias("text"))
    return with_sketch(df.withColumn("n_chars", F.char_length("text").cast("long")), "text", "sketch", k, scale)


def edited_fingerprints(docs: DataFrame, k: int = SHINGLE, scale: int = SCALE) -> DataFrame:
    """Every text's sketch beside the next text's and beside that of its edited text.

    The edit replaces the last quarter of the code points by as many of the
    next text's first ones, or all of them.
    """
    df = fingerprints(docs, k, scale).withColumn("th", F.xxhash64("text"))
    df = neighbours(df, "doc_id", "th", ["text", "sketch"])
    cut = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - cut).cast("int")), F.substring("next_text", F.lit(1), cut))
    df = df.select("doc_id", "n_chars", "sketch", "next_sketch", edited.alias("edited"))
    return with_sketch(df, "edited", "edited_sketch", k, scale)


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edited_fingerprints(read_table(spark, sf_dir, "documents"))
    return e.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("sketch")).alias("fingerprint"), fingerprint(F.col("edited_sketch")).alias("edited_fingerprint"),
                    likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
                    containment(F.col("sketch"), F.col("edited_sketch")).alias("held_by_edited"))

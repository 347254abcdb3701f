"""Secret scans with corpus-wide ownership frequency (operator 6).

Candidates are found by pattern, with code point positions read off the pieces
between matches.  Every candidate's value is hashed and counted over the whole
corpus by distinct owners and repositories.  A value that many owners hold is
a copied example; one that a single owner or few hold looks like a live
credential.  The base kinds are fixed; ``vendor`` adds tokens of well-known
shape and ``pem`` private-key blocks' headers.  Built-in functions only.

Only matches leave the scan, so shuffles carry matches, never texts.  Values
are counted in two steps (per owner, then over owners), so a value that a
third of the corpus holds is combined before it is shuffled.

Defined results: a null text is empty and has no matches; a null owner or
repository counts as one of its own; rows of equal id and text repeat the
result, and each of their owners and repositories counts; other columns are
ignored; an empty table gives an empty result.  ``max_owners`` and
``max_repositories`` are those of a document's most copied candidate (0: none).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tixflow.llm.common import read_table, stage

# (kind, pattern, group of the value, least length of the value); in this order at equal starts.
# A run of at least n characters is matched as {n,}: its maximal run starts at the same place.
BASE = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
]
ADDED = [
    ("vendor", r"gh[pousr]_[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk-[A-Za-z0-9]{20,}|eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+", 0, 1),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
]
EXAMPLE_OWNERS = 3  # values held by at least so many owners are widely copied examples


def _matches(kind_no: int, pattern: str, group: int) -> Column:
    """Every match of a pattern: kind number, index, code points before and in it, value."""
    text, rx = F.col("text"), F.lit(pattern)
    parts = F.arrays_zip(F.split(text, pattern).alias("gap"), F.regexp_extract_all(text, rx, 0).alias("hit"), F.regexp_extract_all(text, rx, group).alias("value"))
    rows = F.transform(parts, lambda z, i: F.struct(F.lit(kind_no).alias("kind"), i.alias("no"), F.char_length(z["gap"]).alias("gap"), F.char_length(z["hit"]).alias("size"), z["value"].alias("value")))
    return F.when(text.rlike(pattern), rows)


def matches(docs: DataFrame, owner: str, repository: str) -> DataFrame:
    """One row per input row and match: doc_id, th, owner, repository, kind, no, gap, size, value (hashed), long_enough."""
    kinds = BASE + ADDED
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
                      F.col(owner).cast("string").alias("owner"), F.col(repository).cast("string").alias("repository"))
    src = src.select("doc_id", F.xxhash64("text").alias("th"), "owner", "repository", F.array_compact(F.array(*(_matches(i, rx, g) for i, (_, rx, g, _) in enumerate(kinds)))).alias("m"))
    rows = src.select("doc_id", "th", "owner", "repository", F.inline_outer(F.flatten("m"))).where("size is not null")
    least = F.element_at(F.create_map(*(F.lit(x) for i, k in enumerate(kinds) for x in (i, k[3]))), F.col("kind"))
    return rows.withColumn("long_enough", F.char_length("value") >= least).withColumn("value", F.sha2("value", 256))


def candidates(found: DataFrame) -> DataFrame:
    """One row per match that is long enough: doc_id, th, kind, start, end, value hash.

    Rows of equal id and text appear once.
    """
    rows = found.groupBy("doc_id", "th", "kind", "no").agg(*(F.first(c).alias(c) for c in ("gap", "size", "value", "long_enough")))
    # the window holds one document's matches of one kind
    before = Window.partitionBy("doc_id", "th", "kind").orderBy("no")
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(before))
    return rows.where("long_enough").select("doc_id", "th", "kind", (F.col("end") - F.col("size")).alias("start"), "end", "value")


def ownership(found: DataFrame) -> DataFrame:
    """Distinct owners and repositories of every value, over all rows: those of equal id and text may have several owners."""
    per_owner = (found.where("long_enough").select("value", "owner", "repository").distinct()
                 .groupBy("value", "owner").agg(F.count(F.lit(1)).alias("n")))
    return per_owner.groupBy("value").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("n").alias("n_repositories"))


def scan(docs: DataFrame, owner: str = "source", repository: str = "doc_id", example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """One row per candidate with its ownership: n_owners, n_repositories and ``live``."""
    found = stage(matches(docs, owner, repository))
    own = stage(ownership(found))
    return stage(candidates(found)).join(own, "value").withColumn("live", F.col("n_owners") < example_owners)


def scan_documents(docs: DataFrame, owner: str = "source", repository: str = "doc_id", example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """One row per document: counts, base and all spans, live-looking and example candidates."""
    names = F.array(*(F.lit(k[0]) for k in BASE + ADDED))
    base = F.col("kind") < len(BASE)
    span = F.struct("start", "kind", "end")
    listed = lambda c: F.array_join(F.transform(F.array_sort(c), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    per = (scan(docs, owner, repository, example_owners).groupBy("doc_id", "th")  # bounded by one document's matches
           .agg(*(F.count(F.when(F.col("kind") == i, 1)).alias(f"n_{k[0]}") for i, k in enumerate(BASE)),
                F.count(F.when(~base, 1)).alias("n_added"), F.count(F.when(F.col("live"), 1)).alias("n_live"), F.count(F.when(~F.col("live"), 1)).alias("n_example"),
                F.max("n_owners").alias("max_owners"), F.max("n_repositories").alias("max_repositories"),
                F.collect_list(F.when(base, span)).alias("base"), F.collect_list(span).alias("all")))
    counts = [f"n_{k[0]}" for k in BASE] + ["n_added", "n_live", "n_example", "max_owners", "max_repositories"]
    per = per.select(F.col("doc_id").alias("k1"), F.col("th").alias("k2"), *counts, listed(F.col("base")).alias("base"), listed(F.col("all")).alias("spans"))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("th"))
    return (d.join(per, d.doc_id.eqNullSafe(per.k1) & (d.th == per.k2), "left")
            .select("doc_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts), F.coalesce("base", F.lit("")).alias("base"), F.coalesce("spans", F.lit("")).alias("spans")))


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scan_documents(read_table(spark, sf_dir, "documents"))
    return s.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_added", "n_live", "n_example", "max_owners", "max_repositories")

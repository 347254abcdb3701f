"""Per-cluster summaries.

Input: tickets with a ``cluster_id`` column (-1 = noise is ignored).  Each
summary is a ``groupBy(cluster_id)`` with map-side partial aggregation, or a
window over a per-cluster set whose size is bounded independently of the row
count (distinct terms, distinct values, distinct timestamps).  Member lists
are not collected into one row: ``cluster_members`` is a table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tixflow.config import KEYWORD_MAX_FEATURES, PRIORITY_DIST_KEYS, STOP_WORDS
from tixflow.functions.text import title_case, vectoriser_terms
from tixflow.operators import textfeat
from tixflow.session import cut_lineage

RECURRENCE_BANDS = [
    (2.0, "Continuous / ongoing"),
    (24.0, "Multiple times per day"),
    (168.0, "Multiple times per week"),
    (720.0, "Weekly"),
]


def _clustered(t: DataFrame, key: str) -> DataFrame:
    return t.where(F.col(key) >= 0)


def cluster_keywords(t: DataFrame, n: int = 6, key: str = "cluster_id", text_col: str = "full_text",
                     id_col: str = "number", max_features: int = KEYWORD_MAX_FEATURES) -> DataFrame:
    """(key, rank, keyword, score) top ``n`` terms of a TF-IDF fitted per cluster.

    Vectoriser per cluster: 1-2-grams of cleaned text, stop words removed,
    min_df 1, raw tf, smoothed idf, L2 rows; score = mean weight over the
    cluster's documents.  Vocabulary per cluster: top ``max_features`` by
    count (ties: term ascending).  Ranking: score (9 decimals) descending,
    then term descending.
    """
    c = _clustered(t, key)
    # One row per distinct (cluster, text), tokenised once; ``tmult`` tickets
    # stand behind it, so counts, document frequencies and the mean score are
    # weighted by it.
    # Written first: the filter that Spark infers from the explode reads the
    # terms, and would go below the grouping and tokenise every ticket's text.
    _, texts = textfeat.distinct_texts(c.select(key, text_col), text_col, extra_keys=[key])
    texts = cut_lineage(texts)
    tkeys = [key, "th1", "th2", "tmult"]
    d = texts.select(*tkeys, vectoriser_terms(F.col("text"), STOP_WORDS).alias("terms"))
    n_c = texts.groupBy(key).agg(F.sum("tmult").alias("n_c"))
    tf = (d.select(*tkeys, F.explode("terms").alias("term"))
           .groupBy(*tkeys, "term").agg(F.count(F.lit(1)).alias("tf")))
    stats = tf.groupBy(key, "term").agg(F.sum(F.col("tf") * F.col("tmult")).alias("total"),
                                        F.sum("tmult").alias("df"))
    vrank = F.row_number().over(Window.partitionBy(key).orderBy(F.col("total").desc(), F.col("term").asc()))
    vocab = (stats.withColumn("_r", vrank).where(F.col("_r") <= max_features)
                  .join(n_c, key)
                  .select(key, "term", (F.log((1.0 + F.col("n_c")) / (1.0 + F.col("df"))) + 1.0).alias("idf"),
                          "n_c"))
    w0 = tf.join(vocab, [key, "term"]).select(*tkeys, "term", "n_c",
                                              (F.col("tf") * F.col("idf")).alias("w0"))
    norm = F.sqrt(F.sum(F.col("w0") * F.col("w0")).over(Window.partitionBy(key, "th1", "th2")))
    w = w0.select(key, "term", "n_c", "tmult", (F.col("w0") / norm).alias("w"))
    score = w.groupBy(key, "term").agg((F.sum(F.col("w") * F.col("tmult")) / F.first("n_c")).alias("score"))
    score = score.withColumn("score", F.round("score", 9)).where(F.col("score") > 0)
    r = F.row_number().over(Window.partitionBy(key).orderBy(F.col("score").desc(), F.col("term").desc()))
    return score.withColumn("rank", r).where(F.col("rank") <= n).select(key, "rank", F.col("term").alias("keyword"), "score")


def keyword_label(kws: Column, single_suffix: str = " Issues", empty: str = "Uncategorized Issues",
                  joiner: str = " / ") -> Column:
    """P8 / R7: 'Kw1 / Kw2 Issues' style label from an ordered keyword array."""
    first = title_case(F.element_at(kws, 1))
    second = title_case(F.element_at(kws, 2))
    return (F.when(F.size(kws) == 0, F.lit(empty))
             .when(F.size(kws) == 1, F.concat(first, F.lit(single_suffix)))
             .otherwise(F.concat(first, F.lit(joiner), second, F.lit(single_suffix))))


def keyword_arrays(kw: DataFrame, key: str = "cluster_id") -> DataFrame:
    """(key, keywords ARRAY<STRING>) ordered by rank; at most n per cluster."""
    return kw.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("rank", "keyword"))).alias("_k")) \
             .select(key, F.transform("_k", lambda x: x["keyword"]).alias("keywords"))


def priority_distribution(t: DataFrame, key: str = "cluster_id") -> DataFrame:
    """Zero-filled counts for P1-P4 and Unknown, plus ``other`` (e.g. P5)."""
    c = _clustered(t, key)
    cols = [F.count_if(F.col("priority") == p).alias(p) for p in PRIORITY_DIST_KEYS]
    cols.append(F.count_if(~F.col("priority").isin(PRIORITY_DIST_KEYS)).alias("other"))
    return c.groupBy(key).agg(*cols)


def top_values(t: DataFrame, col: str, n: int, key: str = "cluster_id", order_col: str = "ingest_ord") -> DataFrame:
    """P10: (key, rank, value, count) top ``n`` non-blank values per cluster;
    ties go to the value seen first."""
    c = _clustered(t, key).where(F.col(col).isNotNull() & (F.col(col) != ""))
    counts = c.groupBy(key, col).agg(F.count(F.lit(1)).alias("count"), F.min(order_col).alias("_first"))
    r = F.row_number().over(Window.partitionBy(key).orderBy(F.col("count").desc(), F.col("_first").asc()))
    return counts.withColumn("rank", r).where(F.col("rank") <= n) \
                 .select(key, "rank", F.col(col).alias("value"), "count")


def ranked_array(top: DataFrame, key: str = "cluster_id") -> DataFrame:
    return top.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("rank", "value"))).alias("_v")) \
              .select(key, F.transform("_v", lambda x: x["value"]).alias("values"))


def state_distribution(t: DataFrame, key: str = "cluster_id") -> DataFrame:
    """(key, state, count) as found."""
    return _clustered(t, key).groupBy(key, "state").agg(F.count(F.lit(1)).alias("count"))


def _gaps(per_ts: DataFrame, key: str, ts: str) -> DataFrame:
    """(key, ts, cnt, _prev): the key's timestamp before each of its distinct ones.

    Rows are range-partitioned by (key, ts), so a key with very many
    timestamps spreads over partitions; the lag runs per partition and key, and
    the first row of each takes the last timestamp of the key's partition
    before (a table of one row per partition and key).
    """
    s = cut_lineage(per_ts.repartitionByRange(key, ts).select(key, ts, "cnt", F.spark_partition_id().alias("_pid")))
    last = s.groupBy("_pid", key).agg(F.max(ts).alias("_last"))
    before = last.select("_pid", key, F.lag("_last").over(Window.partitionBy(key).orderBy("_pid")).alias("_before"))
    inner = s.withColumn("_in", F.lag(ts).over(Window.partitionBy("_pid", key).orderBy(ts)))
    return inner.join(before, ["_pid", key]).select(key, ts, "cnt", F.coalesce("_in", "_before").alias("_prev"))


def _running_total(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """``df`` with ``_cum``, the key's running total of ``value`` by ``order`` (distinct per key).

    Range-partitioned like ``_gaps``: totals per partition and key, offset by
    the sums of the key's partitions before.
    """
    s = cut_lineage(df.repartitionByRange(key, order).select("*", F.spark_partition_id().alias("_pid")))
    sums = s.groupBy("_pid", key).agg(F.sum(value).alias("_s"))
    earlier = Window.partitionBy(key).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("_pid", key, F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_base"))
    inner = Window.partitionBy("_pid", key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("_in", F.sum(value).over(inner))
    return s.join(base, ["_pid", key]).withColumn("_cum", F.col("_in") + F.col("_base")).drop("_pid", "_in", "_base")


def recurrence(t: DataFrame, key: str = "cluster_id", ts: str = "opened_at") -> DataFrame:
    """(key, median_gap_hours, recurrence).

    Gaps between consecutive non-NULL timestamps.  Equal timestamps are
    pre-aggregated to (timestamp, count): they contribute count-1 zero gaps.
    The weighted median is read off running totals over the distinct gaps.
    """
    c = _clustered(t, key).where(F.col(ts).isNotNull())
    g = _gaps(c.groupBy(key, ts).agg(F.count(F.lit(1)).alias("cnt")), key, ts)
    diffs = g.where(F.col("_prev").isNotNull()).select(
        key, (F.timestamp_diff("MICROSECOND", F.col("_prev"), F.col(ts)) / 3.6e9).alias("gap"))
    zeros = g.where(F.col("cnt") > 1).select(key, F.lit(0.0).alias("gap"), (F.col("cnt") - 1).alias("wt"))
    gaps = diffs.withColumn("wt", F.lit(1).cast("long")).unionByName(zeros).groupBy(key, "gap").agg(F.sum("wt").alias("wt"))
    ranked = _running_total(gaps, key, "gap", "wt")
    n = cut_lineage(gaps.groupBy(key).agg(F.sum("wt").alias("n")))
    ranked = ranked.join(n, key)
    holds = lambda k: (F.col("_cum") - F.col("wt") < k) & (F.col("_cum") >= k)
    med = ranked.groupBy(key).agg(
        F.max(F.when(holds(F.floor((F.col("n") - 1) / 2) + 1), F.col("gap"))).alias("_g1"),
        F.max(F.when(holds(F.floor(F.col("n") / 2) + 1), F.col("gap"))).alias("_g2"))
    med = med.select(key, ((F.col("_g1") + F.col("_g2")) / 2).alias("median_gap_hours"))
    keys = _clustered(t, key).select(key).distinct()
    out = keys.join(med, key, "left")
    label = F.when(F.col("median_gap_hours").isNull(), F.lit("Insufficient data"))
    for bound, name in RECURRENCE_BANDS:
        label = label.when(F.col("median_gap_hours") < bound, F.lit(name))
    label = label.otherwise(F.lit("Monthly or less"))
    return out.select(key, "median_gap_hours", label.alias("recurrence"))


def _trend_label(first: Column, second: Column) -> Column:
    ratio = second / F.greatest(first, F.lit(1))
    return (F.when(second == 0, F.lit("Unknown"))
             .when(ratio > 1.3, F.lit("Increasing"))
             .when(ratio < 0.7, F.lit("Decreasing"))
             .otherwise(F.lit("Stable")))


def trend(t: DataFrame, key: str = "cluster_id", ts: str = "opened_at") -> DataFrame:
    """P15 as the reference computes it: halves of the row list, so it
    depends on the cluster size only; all-NULL dates -> Unknown."""
    agg = _clustered(t, key).groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count(ts).alias("n_ts"))
    first = F.floor(F.col("n") / 2)
    second = F.col("n") - first
    return agg.select(key, F.when(F.col("n_ts") == 0, F.lit("Unknown"))
                      .otherwise(_trend_label(first, second)).alias("trend"))


def trend_by_time(t: DataFrame, key: str = "cluster_id", ts: str = "opened_at") -> DataFrame:
    """P15 corrected: split the cluster's time range at its midpoint and
    compare the two halves' counts with the same thresholds."""
    c = _clustered(t, key)
    rng = cut_lineage(c.groupBy(key).agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi")))  # a plain shuffle: splittable
    mid = F.timestamp_add("MICROSECOND", F.floor(F.timestamp_diff("MICROSECOND", F.col("_lo"), F.col("_hi")) / 2),
                          F.col("_lo"))
    j = c.select(key, ts).join(rng, key)
    agg = j.groupBy(key).agg(
        F.count_if(F.col(ts) < mid).alias("first_half"),
        F.count_if(F.col(ts) >= mid).alias("second_half"),
        F.count(ts).alias("n_ts"))
    return agg.select(key, "first_half", "second_half",
                      F.when(F.col("n_ts") == 0, F.lit("Unknown"))
                       .otherwise(_trend_label(F.col("first_half"), F.col("second_half"))).alias("trend_by_time"))


def cluster_basics(t: DataFrame, key: str = "cluster_id") -> DataFrame:
    """Size, mean MTTR, first/last seen, modal category."""
    c = _clustered(t, key)
    return c.groupBy(key).agg(
        F.count(F.lit(1)).alias("size"),
        F.avg("mttr_hours").alias("avg_mttr_hours"),
        F.min("opened_at").alias("first_seen"),
        F.max("opened_at").alias("last_seen"),
        F.mode("category", True).alias("category"),
    )


def cluster_members(t: DataFrame, key: str = "cluster_id", id_col: str = "number") -> DataFrame:
    """P17 member list as a table (one row per ticket)."""
    return _clustered(t, key).select(key, id_col)


def cluster_summary(t: DataFrame, key: str = "cluster_id") -> DataFrame:
    """One row per kept cluster with every P7-P17 field (member list excluded).

    ``trend`` is the size-only reference rule; ``trend_by_time`` the
    time-split rule.
    """
    kw = keyword_arrays(cluster_keywords(t, key=key), key)
    base = cluster_basics(t, key)
    pdist = priority_distribution(t, key)
    pdist = pdist.select(key, F.create_map(*[x for p in PRIORITY_DIST_KEYS for x in (F.lit(p), F.col(p))])
                         .alias("priority_dist"), F.col("other").alias("priority_other"))
    sdist = state_distribution(t, key).groupBy(key).agg(
        F.map_from_entries(F.collect_list(F.struct("state", "count"))).alias("state_dist"))
    tops = [ranked_array(top_values(t, c, 3, key), key).withColumnRenamed("values", name)
            for c, name in [("business_service", "top_services"), ("cmdb_ci", "top_cis"),
                            ("assignment_group", "top_groups")]]
    out = (base.join(kw, key, "left").join(pdist, key).join(sdist, key)
               .join(recurrence(t, key), key).join(trend(t, key), key)
               .join(trend_by_time(t, key).select(key, "trend_by_time"), key))
    for tp in tops:
        out = out.join(tp, key, "left")
    empty = F.array().cast("array<string>")
    out = out.select(
        key, keyword_label(F.coalesce(F.col("keywords"), empty)).alias("label"),
        F.coalesce(F.col("keywords"), empty).alias("keywords"), "size", "priority_dist", "priority_other",
        F.coalesce(F.col("top_services"), empty).alias("top_services"),
        F.coalesce(F.col("top_cis"), empty).alias("top_cis"),
        F.coalesce(F.col("top_groups"), empty).alias("top_groups"),
        "state_dist", "avg_mttr_hours", "first_seen", "last_seen", "median_gap_hours", "recurrence",
        "trend", "trend_by_time", "category")
    return out

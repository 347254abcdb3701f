"""Root-cause clustering of resolution notes.

K-means runs on the *distinct* resolution vectors with their multiplicity as
``weightCol``: the objective and the silhouette are the same as over all rows,
and the fitted data shrinks to the number of distinct texts.  Vectors are
dense arrays of the (<= 800 term) vocabulary built JVM-side and turned into
ML vectors with ``array_to_vector``.  The k search is a driver loop over at
most nine k on the cached vectors; each fit is a distributed job.
"""

from __future__ import annotations

from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tixflow.config import (KMEANS_MAX_CLUSTERS, OPEN_STATES, RECOMMENDATION_RULES,
                            RESOLUTION_MIN_CHARS, ROOT_CAUSE_MAX_FEATURES,
                            ROOT_CAUSE_MIN_ROWS, STOP_WORDS, AGED_HOURS)
from tixflow.functions.text import strip_ws, vectoriser_terms
from tixflow.operators import textfeat
from tixflow.operators.silhouette import cosine_silhouette, mean_silhouette
from tixflow.operators.similarity import vector_hash
from tixflow.session import cut_lineage


FIT_THREADS = 8


def resolution_text(root_cause: Column, close_notes: Column) -> Column:
    """strip(root_cause + ' ' + close_notes)."""
    return strip_ws(F.concat_ws(" ", F.coalesce(root_cause, F.lit("")), F.coalesce(close_notes, F.lit(""))))


def resolution_corpus(t: DataFrame, min_chars: int = RESOLUTION_MIN_CHARS,
                      min_rows: int = ROOT_CAUSE_MIN_ROWS) -> DataFrame:
    """R2: tickets whose resolution text is longer than ``min_chars``; empty
    when fewer than ``min_rows`` qualify (a one-row gate, no driver round trip)."""
    r = (t.withColumn("resolution_text", resolution_text(F.col("root_cause"), F.col("close_notes")))
          .where(F.length("resolution_text") > min_chars))
    gate = r.agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_rows)
    return r.crossJoin(F.broadcast(gate)).drop("_n")


def first_n_per_group(df: DataFrame, key: str, order: str, n: int, salt_buckets: int = 64) -> DataFrame:
    """First ``n`` rows per ``key`` by ``order`` (unique), in two salted stages
    so a hot group is ranked in ``salt_buckets`` pieces, then <= n*buckets rows."""
    salt = F.abs(F.xxhash64(F.col(order))) % salt_buckets
    s1 = df.withColumn("_salt", salt).withColumn(
        "_r", F.row_number().over(Window.partitionBy(key, "_salt").orderBy(order))).where(F.col("_r") <= n)
    return (s1.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(order)))
              .where(F.col("_r") <= n).drop("_salt"))


@dataclass
class RootCauseResult:
    corpus: DataFrame        # (number, ..., resolution_text, rc_cluster)
    k: int
    silhouette: float | None
    scores: list[tuple[int, float]]


def _vectors(corpus: DataFrame, max_features: int):
    # Identical resolution texts are tokenised once; ``tmult`` tickets share each.
    doc_text, texts = textfeat.distinct_texts(corpus.select("number", "resolution_text"), "resolution_text")
    texts = cut_lineage(texts)
    tkeys = ["th1", "th2", "tmult"]
    d = texts.select(*tkeys, vectoriser_terms(F.col("text"), STOP_WORDS).alias("terms"))
    tf = textfeat.term_counts(d, tkeys)
    vocab = textfeat.vocabulary(tf, texts.agg(F.sum("tmult").alias("n_docs")), max_features, 1, weight="tmult")
    vocab = cut_lineage(vocab.withColumn("_i", F.row_number().over(Window.orderBy("term")) - 1))  # <= 800 rows
    kept = tf.join(F.broadcast(vocab.select("term")), "term")
    key = kept.groupBy(*tkeys).agg(F.array_sort(F.collect_list(F.struct("term", "tf"))).alias("key"))
    per_text = texts.select(*tkeys).join(key, tkeys, "left").select(
        *tkeys, F.coalesce(F.col("key"), F.array().cast("array<struct<term:string,tf:bigint>>")).alias("key"))
    h1, h2 = vector_hash(F.col("key"))
    per_text = cut_lineage(per_text.select(*tkeys, "key", h1.alias("h1"), h2.alias("h2")))
    # One row per distinct vector, weighted by how many tickets share it.
    distinct = per_text.groupBy("h1", "h2").agg(F.first("key").alias("key"),
                                                F.sum("tmult").cast("double").alias("weight"))
    ex = distinct.select("h1", "h2", F.explode("key").alias("e")).select(
        "h1", "h2", F.col("e.term").alias("term"), F.col("e.tf").alias("tf"))
    w = textfeat.tfidf(ex, vocab, ["h1", "h2"], sublinear=True).join(F.broadcast(vocab.select("term", "_i")), "term")
    dim = vocab.count()  # <= max_features: sizes the dense vectors
    m = w.groupBy("h1", "h2").agg(F.map_from_entries(F.collect_list(F.struct("_i", "w"))).alias("m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(max(dim, 1) - 1)),
                        lambda i: F.coalesce(F.try_element_at(F.col("m"), i), F.lit(0.0)))
    feats = distinct.join(m, ["h1", "h2"], "left").select(
        "h1", "h2", "weight", F.coalesce(F.size(F.map_keys("m")), F.lit(0)).alias("nnz"),
        array_to_vector(F.when(F.col("m").isNull(), F.array_repeat(F.lit(0.0), max(dim, 1))).otherwise(dense)).alias("features"))
    members = doc_text.select("number", "th1", "th2").join(per_text.select("th1", "th2", "h1", "h2"), ["th1", "th2"])
    return members.select("number", "h1", "h2"), per_text.select("th1", "th2", "h1", "h2"), feats, dim, w.select("h1", "h2", "term", "w")


def resolution_weights(t: DataFrame, max_features: int = ROOT_CAUSE_MAX_FEATURES) -> DataFrame:
    """(number, term, w) of every ticket in the resolution corpus."""
    members, _, _, _, w = _vectors(cut_lineage(resolution_corpus(t)), max_features)
    return members.join(cut_lineage(w), ["h1", "h2"]).select("number", "term", "w")


def grouped_silhouette(corpus: DataFrame, max_features: int = ROOT_CAUSE_MAX_FEATURES) -> DataFrame:
    """R5 for any grouping: (rc_cluster, n, silhouette) of a resolution corpus with ``rc_cluster``; all tickets under null."""
    corpus = cut_lineage(corpus.select("number", "resolution_text", "rc_cluster"))
    members, _, _, _, w = _vectors(corpus, max_features)
    points = (members.join(corpus.select(F.col("number").alias("_key"), "rc_cluster"), F.col("number").eqNullSafe(F.col("_key")))
                     .groupBy("h1", "h2", "rc_cluster").agg(F.count(F.lit(1)).alias("mult")))
    return mean_silhouette(cosine_silhouette(points, cut_lineage(w.select("h1", "h2", "term", "w")), ["h1", "h2"], "rc_cluster"), "rc_cluster")


def _labelled(corpus: DataFrame, labels: DataFrame) -> DataFrame:
    """``corpus`` with the ``rc_cluster`` of its resolution texts (th1, th2, rc_cluster)."""
    return textfeat.with_text_hash(corpus, "resolution_text").join(labels, ["th1", "th2"]).drop("th1", "th2")


def root_cause_clusters(t: DataFrame, max_clusters: int = KMEANS_MAX_CLUSTERS,
                        max_features: int = ROOT_CAUSE_MAX_FEATURES, seed: int = 42,
                        starts: int = 10, max_iter: int = 300, tol: float = 1e-4) -> RootCauseResult:
    """TF-IDF of the resolution corpus, k chosen by cosine silhouette.

    k runs over 2..min(max_clusters, n-1, 10); the first k with the best
    silhouette wins; fewer than 6 rows -> k = 2.  ``starts`` seeds per k,
    lowest training cost kept.  Returns the corpus with ``rc_cluster``.
    """
    corpus = cut_lineage(resolution_corpus(t))
    n = corpus.count()
    if n == 0:
        return RootCauseResult(corpus.withColumn("rc_cluster", F.lit(None).cast("int")), 0, None, [])
    _, text_vec, feats, dim, _ = _vectors(corpus, max_features)
    feats = cut_lineage(feats)
    n_distinct = feats.count()
    if dim == 0 or feats.where("nnz > 0").limit(1).count() == 0:
        # Stop words only: no vocabulary, no root causes.
        return RootCauseResult(corpus.limit(0).withColumn("rc_cluster", F.lit(None).cast("int")), 0, None, [])
    if n_distinct == 1:  # one vector is one cluster; there is nothing to fit
        return RootCauseResult(corpus.withColumn("rc_cluster", F.lit(0)), 1, None, [])

    # Many short fits: partitions of a few thousand vectors, not one per core.
    feats = feats.coalesce(n_distinct // 2000 + 1).cache()

    def start(job: tuple[int, int]):
        k, s = job
        km = KMeans(k=k, seed=seed + s, maxIter=max_iter, tol=tol, weightCol="weight",
                    featuresCol="features", predictionCol="rc_cluster")
        model = km.fit(feats)
        return model.summary.trainingCost, s, model

    def fit(k: int):
        # The starts are independent small jobs: let the scheduler overlap them.
        with ThreadPool(min(starts, FIT_THREADS)) as pool:
            fitted = pool.map(inheritable_thread_target(start), [(k, s) for s in range(starts)])
        return min(fitted, key=lambda x: x[:2])[2]

    scores: list[tuple[int, float]] = []
    best_k, best_score, model = 3, -1.0, None
    max_k = min(max_clusters, n - 1, 10)
    if n >= 6:
        ev = ClusteringEvaluator(featuresCol="features", predictionCol="rc_cluster", weightCol="weight",
                                 metricName="silhouette", distanceMeasure="cosine")
        nonzero = feats.where(F.col("nnz") > 0)  # cosine silhouette is undefined for zero vectors
        for k in range(2, min(max_k, n_distinct) + 1):
            fitted = fit(k)
            pred = fitted.transform(nonzero)
            if pred.select("rc_cluster").distinct().limit(2).count() < 2:
                continue
            score = float(ev.evaluate(pred))
            scores.append((k, score))
            if score > best_score:
                best_score, best_k, model = score, k, fitted
    else:
        best_k = 2
    if model is None:
        best_k = min(best_k, n_distinct)
        model = fit(best_k)
    pred = model.transform(feats).select("h1", "h2", F.col("rc_cluster").cast("int").alias("rc_cluster"))
    labelled = _labelled(corpus, cut_lineage(text_vec.join(pred, ["h1", "h2"]).select("th1", "th2", "rc_cluster")))
    return RootCauseResult(cut_lineage(labelled), best_k, best_score if scores else None, scores)


def rules_frame(spark, rules: list[tuple[list[str], str]] | None = None) -> DataFrame:
    rs = RECOMMENDATION_RULES if rules is None else rules
    return spark.createDataFrame([(i, trig, text) for i, (trig, text) in enumerate(rs)],
                                 "rule_id int, triggers array<string>, recommendation string")


def map_recommendations(keywords: DataFrame, key: str, rules: DataFrame, limit: int = 3) -> DataFrame:
    """(key, rank, recommendation): a rule fires when any trigger is a
    substring of any keyword (lower-cased); rule order kept, at most ``limit``.

    The rule table is a fixed dozen rows (one row per trigger after the
    explode): broadcast nested loop against one row per keyword, then one
    row per (key, rule) that fired.  No nested lambdas."""
    kw = keywords.select(key, F.explode("keywords").alias("_kw")).select(key, F.lower("_kw").alias("_kw"))
    tr = rules.select("rule_id", "recommendation", F.explode("triggers").alias("_tr"))
    fired = (kw.join(F.broadcast(tr), F.col("_kw").contains(F.col("_tr")))
               .select(key, "rule_id", "recommendation").distinct())
    r = F.row_number().over(Window.partitionBy(key).orderBy("rule_id"))
    return (fired.withColumn("rank", r).where(F.col("rank") <= limit)
                 .select(key, "rank", "rule_id", "recommendation"))


def link_patterns(rc: DataFrame, patterns: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(rc_cluster, pattern_id, shared_tickets) for non-empty overlaps.

    ``rc``: (number, rc_cluster); ``patterns``: (number, cluster_id).
    Equi-join on the ticket number, then a count per pair."""
    p = patterns.where(F.col("cluster_id") >= 0).select(F.col("number").alias("_key"), F.col("cluster_id").alias("pattern_id"))
    out = (rc.select("number", "rc_cluster").join(p, F.col("number").eqNullSafe(F.col("_key")))
             .groupBy("rc_cluster", "pattern_id").agg(F.count(F.lit(1)).alias("shared_tickets")))
    if labels is not None:
        out = out.join(labels.select(F.col("cluster_id").alias("pattern_id"), F.col("label").alias("pattern_label")),
                       "pattern_id", "left")
    return out


def open_insight(t: DataFrame, aged_hours: float = AGED_HOURS) -> DataFrame:
    """One sentence about open tickets (total, P1, aged)."""
    op = F.col("state").isin(OPEN_STATES)
    agg = t.agg(F.count_if(op).alias("open_total"),
                F.count_if(op & (F.col("priority") == "P1")).alias("open_p1"),
                F.count_if(op & (F.col("age_hours") > aged_hours)).alias("open_aged"))
    text = F.when(F.col("open_total") == 0, F.lit("No currently open tickets detected.")).otherwise(
        F.concat_ws(" ",
                    F.format_string("%d ticket(s) remain open.", F.col("open_total")),
                    F.when(F.col("open_p1") > 0, F.format_string("%d are P1 (critical).", F.col("open_p1"))),
                    F.when(F.col("open_aged") > 0,
                           F.format_string("%d have been open for more than 7 days.", F.col("open_aged")))))
    return agg.select("open_total", "open_p1", "open_aged", text.alias("insight"))


def top_actions(corpus: DataFrame, n: int = 5, stop_words: list[str] | None = None) -> DataFrame:
    """(rank, phrase, count) most common bigrams of words ``[a-z]{3,}``
    (stop words removed) within each resolution text; ties: first seen."""
    stop = F.array(*[F.lit(w) for w in (STOP_WORDS if stop_words is None else stop_words)])
    words = F.filter(F.regexp_extract_all(F.lower(F.col("resolution_text")), F.lit(r"\b([a-z]{3,})\b"), 1),
                     lambda w: ~F.array_contains(stop, w))
    shifted = F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0)))
    pairs = F.filter(F.zip_with(words, shifted, lambda a, b: F.concat(a, F.lit(" "), b)), lambda x: x.isNotNull())
    ex = corpus.select("ingest_ord", F.posexplode(pairs).alias("pos", "phrase"))
    counts = ex.groupBy("phrase").agg(F.count(F.lit(1)).alias("count"),
                                      F.min(F.struct("ingest_ord", "pos")).alias("_first"))
    return (counts.orderBy(F.col("count").desc(), F.col("_first").asc()).limit(n)
                  .select("phrase", "count"))

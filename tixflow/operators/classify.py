"""Category fill-in (C1-C8): keyword rules, then TF-IDF nearest centroid.

Rule tier: one ``regexp_count`` per taxonomy category on the cleaned text,
a narrow projection.  Vector tier: the centroid table has at most
(categories x vocabulary) rows, a proven bound, so it is broadcast; the
unlabelled tickets are never shuffled as a whole, only their term rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tixflow.config import (CATEGORY_KEYWORDS, CLASSIFIER_MIN_LABELED,
                            CLASSIFIER_MIN_SIMILARITY, TFIDF_MAX_FEATURES)
from tixflow.functions.text import clean_text, strip_ws, vectoriser_terms
from tixflow.operators import textfeat
from tixflow.session import cut_lineage


def _quote(kw: str) -> str:
    # Escape regex syntax; the same text works in Java regex and RE2.
    return re.sub(r"([^A-Za-z0-9 ])", r"\\\1", kw)


def keyword_patterns(taxonomy: dict[str, list[str]] | None = None) -> dict[str, str]:
    tax = CATEGORY_KEYWORDS if taxonomy is None else taxonomy
    return {cat: r"\b(" + "|".join(_quote(k.lower()) for k in kws) + r")\b" for cat, kws in tax.items()}


def _spaced_patterns(taxonomy: dict[str, list[str]] | None = None) -> dict[str, str]:
    """``keyword_patterns`` with equal matches in a cleaned text with a space before it.

    There a word begins behind a space.  A literal space is searched for much
    faster than a word boundary, which is tried at every character.  Categories
    with other keywords than words one space apart keep their pattern.
    """
    tax = CATEGORY_KEYWORDS if taxonomy is None else taxonomy
    pats = keyword_patterns(tax)
    for cat, kws in tax.items():
        if kws and all(re.fullmatch("[a-z0-9]+( [a-z0-9]+)*", k.lower()) for k in kws):
            pats[cat] = " (?:" + "|".join(k.lower() for k in kws) + ")(?![a-z0-9])"
    return pats


def _spaced(text: Column) -> Column:
    return F.concat(F.lit(" "), clean_text(text))


def keyword_hits(text: Column, taxonomy: dict[str, list[str]] | None = None) -> Column:
    """Array of struct(category, pos, hits) in taxonomy order.

    The cleaned text is bound once as the variable of a one-element
    ``transform``: named in every count, it would be cleaned as often.
    """
    def counts(spaced: Column) -> Column:
        return F.array(*[
            F.struct(F.lit(cat).alias("category"), F.lit(i).alias("pos"),
                     F.regexp_count(spaced, F.lit(p)).alias("hits"))
            for i, (cat, p) in enumerate(_spaced_patterns(taxonomy).items())
        ])

    return F.get(F.transform(F.array(_spaced(text)), counts), 0)


def rule_category(text: Column, taxonomy: dict[str, list[str]] | None = None) -> Column:
    """Category with most hits, earlier category on a tie; NULL if none.

    ``greatest`` over (hits, -position, category) structs.  The cleaned text
    and the best struct are each bound once as the variable of a one-element
    ``transform``: ``when`` reads the best twice, and named there it would be
    cleaned and counted again for either.
    """
    def best(spaced: Column) -> Column:
        cands = [F.struct(F.regexp_count(spaced, F.lit(p)).alias("hits"), F.lit(-i).alias("neg_pos"),
                          F.lit(cat).alias("category"))
                 for i, (cat, p) in enumerate(_spaced_patterns(taxonomy).items())]
        return F.greatest(*cands) if len(cands) > 1 else cands[0]

    found = F.transform(F.array(_spaced(text)), best)
    return F.get(F.transform(found, lambda b: F.when(b["hits"] > 0, b["category"])), 0)


def needs_classification(category: Column, taxonomy: dict[str, list[str]] | None = None) -> Column:
    """Category (stripped, NULL -> '') is not a taxonomy name (case-sensitive)."""
    tax = CATEGORY_KEYWORDS if taxonomy is None else taxonomy
    return ~strip_ws(F.coalesce(category, F.lit(""))).isin(list(tax))


def classifier_terms(text: Column) -> Column:
    """Classifier vectoriser: raw lower-cased text, Unicode words, no stop words."""
    return vectoriser_terms(text, stop_words=None, clean=False)


def category_centroids(tickets: DataFrame, min_labeled: int = CLASSIFIER_MIN_LABELED,
                       max_features: int = TFIDF_MAX_FEATURES, min_df: int = 2,
                       taxonomy: dict[str, list[str]] | None = None,
                       key: str = "number") -> tuple[DataFrame, DataFrame, DataFrame]:
    """C4: fit on labelled tickets -> (vocab, centroids, labels).

    ``centroids``: (category, term, c) mean weight per category;
    ``labels``: (category, label_ord, n_cat) with label_ord the first row
    order of the label.  All three are empty unless at least
    ``min_labeled`` tickets are labelled.
    """
    lab = (tickets.where(~needs_classification(F.col("category"), taxonomy))
                  .select(key, "ingest_ord", strip_ws(F.col("category")).alias("category"), "full_text"))
    gate = lab.agg(F.count(F.lit(1)).alias("n_labeled")).where(F.col("n_labeled") >= min_labeled)
    # One-row gate: no rows pass unless enough tickets are labelled.
    lab = lab.crossJoin(F.broadcast(gate)).drop("n_labeled")
    # One row per distinct (text, category), tokenised once; ``tmult``
    # documents stand behind it, so counts, document frequencies and the
    # centroid sums are weighted by it (same result as per ticket).
    _, texts = textfeat.distinct_texts(lab, "full_text", extra_keys=["category"])
    texts = cut_lineage(texts)
    tkeys = ["th1", "th2", "category", "tmult"]
    d = texts.select(*tkeys, classifier_terms(F.col("text")).alias("terms"))
    tf = cut_lineage(textfeat.term_counts(d, tkeys))
    # Bounded tables that are read several times are written once.
    vocab = cut_lineage(textfeat.vocabulary(tf, texts.agg(F.sum("tmult").alias("n_docs")), max_features, min_df,
                                            weight="tmult"))
    w = textfeat.tfidf(tf, vocab, tkeys, sublinear=True)
    labels = cut_lineage(lab.groupBy("category").agg(F.min("ingest_ord").alias("label_ord"),
                                                     F.count(F.lit(1)).alias("n_cat")))
    centroids = (w.groupBy("category", "term").agg(F.sum(F.col("w") * F.col("tmult")).alias("s"))
                  .join(F.broadcast(labels), "category")
                  .select("category", "term", (F.col("s") / F.col("n_cat")).alias("c")))
    return vocab, cut_lineage(centroids), labels


def nearest_centroid_of_texts(texts: DataFrame, vocab: DataFrame, centroids: DataFrame, labels: DataFrame) -> DataFrame:
    """(th1, th2, b: struct(category, sim)): the best centroid of every text (th1, th2, text) that shares a term with one; staged.

    The texts are written first: the filter that Spark infers from the explode
    of the terms would go below their grouping and tokenise every ticket's text.
    """
    texts = cut_lineage(texts)
    tkeys = ["th1", "th2"]
    d = texts.select(*tkeys, classifier_terms(F.col("text")).alias("terms"))
    w = textfeat.transform(d, vocab, tkeys, sublinear=True)
    cnorm = (centroids.groupBy("category").agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("cn"))
                      .join(labels.select("category", "label_ord"), "category"))
    # Centroids: categories x vocabulary rows at most, so broadcast.
    sims = (w.join(F.broadcast(centroids), "term")
             .groupBy(*tkeys, "category").agg(F.sum(F.col("w") * F.col("c")).alias("dot"))
             .join(F.broadcast(cnorm), "category")
             .select(*tkeys, "category", "label_ord", (F.col("dot") / F.col("cn")).alias("sim")))
    best = sims.groupBy(*tkeys).agg(F.min_by(F.struct("category", "sim"),
                                             F.struct(-F.col("sim"), F.col("label_ord"))).alias("b"))
    return cut_lineage(best)


def _ml_category(min_similarity: float) -> tuple[Column, Column]:
    sim = F.coalesce(F.col("b.sim"), F.lit(0.0))
    return F.when(sim >= min_similarity, F.col("b.category")).otherwise(F.lit("Other")), sim


def nearest_centroid(docs: DataFrame, vocab: DataFrame, centroids: DataFrame,
                     labels: DataFrame, key: str = "number",
                     min_similarity: float = CLASSIFIER_MIN_SIMILARITY) -> DataFrame:
    """(key, ml_category, ml_similarity) for docs with a ``full_text``.

    Argmax of cosine to the centroids; ties -> label seen first; best below
    ``min_similarity`` (or no shared term) -> 'Other'.
    """
    # Score each distinct text once; tickets pick up their text's result.
    doc_text, texts = textfeat.distinct_texts(docs.select(key, "full_text"), "full_text")
    best = nearest_centroid_of_texts(texts, vocab, centroids, labels)
    out = doc_text.select(key, "th1", "th2").join(best, ["th1", "th2"], "left")  # a plain shuffle: splittable
    category, sim = _ml_category(min_similarity)
    return out.select(key, category.alias("ml_category"), sim.alias("ml_similarity"))


def text_rules(t: DataFrame, taxonomy: dict[str, list[str]] | None = None) -> DataFrame:
    """(th1, th2, _rule_text): the keyword rule of every distinct text of ``t`` (th1, th2, full_text); staged."""
    return cut_lineage(t.select("th1", "th2", "full_text").distinct()
                        .select("th1", "th2", rule_category(F.col("full_text"), taxonomy).alias("_rule_text")))


def classify(tickets: DataFrame, taxonomy: dict[str, list[str]] | None = None,
             min_labeled: int = CLASSIFIER_MIN_LABELED, use_category_text: bool = False,
             key: str = "number", staged: bool = False) -> DataFrame:
    """Fill ``category`` and add ``category_source`` and ``category_raw``.

    original (a taxonomy name) -> rule (keywords in full_text) -> ml (nearest
    centroid, 'Other' below the similarity floor) -> 'Other'/uncategorized
    when the vector tier is not fitted (< ``min_labeled`` labelled rows).
    ``use_category_text=True`` first tries the keyword rules on the category
    string itself for rows outside the taxonomy (C7).  ``staged``: the tickets
    are a written table already, which every branch may read again.
    """
    t = (tickets.withColumn("category_raw", F.col("category"))
                .withColumn("_needs", needs_classification(F.col("category"), taxonomy)))
    t = textfeat.with_text_hash(t, "full_text")
    # The tickets feed four branches (rules, centroid fit, predictions, final
    # projection): written once, so the upstream plan runs a single time.
    t = t if staged else cut_lineage(t)
    # Rules and vectors read only the text: they run once per distinct text of
    # the rows that need a category, and tickets pick them up by the text's hash.
    # Both tables are written, so small ones are broadcast, and with large ones
    # AQE can split the tickets of a text that very many share.
    t = t.join(text_rules(t.where("_needs"), taxonomy), ["th1", "th2"], "left")
    rule = F.col("_rule_text")
    if use_category_text:
        rule = F.coalesce(rule_category(F.coalesce(F.col("category"), F.lit("")), taxonomy), rule)
    t = t.withColumn("_rule", F.when(F.col("_needs"), rule)).drop("_rule_text")

    vocab, centroids, labels = category_centroids(t, min_labeled, taxonomy=taxonomy, key=key)
    ready = labels.agg(F.count(F.lit(1)).alias("n_labels")).select((F.col("n_labels") > 0).alias("_ml_ready"))
    pending = t.where(F.col("_needs") & F.col("_rule").isNull()).select("th1", "th2", F.col("full_text").alias("text")).distinct()
    best = nearest_centroid_of_texts(pending, vocab, centroids, labels)
    t = t.join(best, ["th1", "th2"], "left").crossJoin(F.broadcast(ready))
    t = t.withColumn("ml_category", _ml_category(CLASSIFIER_MIN_SIMILARITY)[0])

    cat = (F.when(~F.col("_needs"), strip_ws(F.col("category")))
            .when(F.col("_rule").isNotNull(), F.col("_rule"))
            .when(F.col("_ml_ready"), F.col("ml_category"))
            .otherwise(F.lit("Other")))
    src = (F.when(~F.col("_needs"), F.lit("original"))
            .when(F.col("_rule").isNotNull(), F.lit("rule"))
            .when(F.col("_ml_ready"), F.lit("ml"))
            .otherwise(F.lit("uncategorized")))
    cols = [c for c in tickets.columns]
    return t.select(*[cat.alias("category") if c == "category" else F.col(c) for c in cols],
                    src.alias("category_source"), F.col("category_raw"))


def classification_summary(classified: DataFrame) -> DataFrame:
    """Count per (category, source), descending."""
    return (classified.groupBy("category", "category_source").agg(F.count(F.lit(1)).alias("count"))
                      .orderBy(F.col("count").desc(), "category", "category_source"))

"""Density clustering of texts by similarity.

Semantics (eps-neighbourhood on cosine distance, ``min_samples`` counting the
point itself): a vector with multiplicity m is its own neighbour m times; a
zero vector is nobody's neighbour.  Core points: neighbour mass >=
``min_samples``.  Clusters: connected components of core-core edges.  A
border point joins the adjacent cluster discovered first, i.e. the one whose
first core row comes earliest.  Clusters are numbered in that order (gaps
stay after the size filter); clusters under ``min_cluster_size`` tickets
become noise (-1).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tixflow.config import (DBSCAN_EPS, DBSCAN_MIN_SAMPLES, MIN_CLUSTER_SIZE,
                            STOP_WORDS, TFIDF_MAX_FEATURES)
from tixflow.operators import similarity as S
from tixflow.operators import textfeat
from tixflow.operators.ballcover import ball_clusters, neighbour_links, neighbour_mass
from tixflow.operators.components import dense_index
from tixflow.session import cut_lineage


@dataclass
class DensityResult:
    """Vectors and, made when asked for, what comes from them; nothing but ``pairs`` makes the pairs."""

    ids: list[str]
    vocab: DataFrame          # (term, total, df, idf, tid)
    members: DataFrame        # (ids..., h1, h2) documents with non-zero vectors
    vectors: DataFrame        # (h1, h2, vid, mult, tids, tfs)
    doc_text: DataFrame       # (ids..., th1, th2) documents by the hash of their text
    text_vec: DataFrame       # (th1, th2, h1, h2) texts with non-zero vectors
    idf: np.ndarray           # by tid
    threshold: float
    min_samples: int
    min_cluster_size: int

    @cached_property
    def weights(self) -> DataFrame:
        """(vid, term, df, w) per distinct vector."""
        return cut_lineage(S.unit_weights(self.vectors, self.vocab))

    @cached_property
    def pairs(self) -> DataFrame:
        """(a, b, sim) similar distinct vectors, a < b (P1); made anew by each reader, as they may be very many."""
        return S.similar_pairs(self.vectors, self.threshold, idf=self.idf)

    @cached_property
    def links(self) -> DataFrame:
        return neighbour_links(self.vectors, self.threshold, self.min_samples, idf=self.idf)

    @cached_property
    def core(self) -> DataFrame:
        """(vid, mult, mass, is_core) with the exact neighbour mass."""
        return cut_lineage(core_points(self.vectors, self.links, self.min_samples))

    @cached_property
    def vector_clusters(self) -> DataFrame:
        """(vid, cluster_id) vectors in kept clusters."""
        comp = ball_clusters(self.vectors, self.threshold, self.min_samples, links=self.links)
        return cut_lineage(number_clusters(comp, self.vectors.select("vid", "mult"), self.min_cluster_size))

    @cached_property
    def text_label(self) -> DataFrame:
        """(th1, th2, cluster_id) texts in kept clusters, by their hash.

        Distinct-text sized; texts with a zero vector or in no kept cluster are left out.
        Materialised, so the documents of a hot text can be split in the join.
        """
        return cut_lineage(self.text_vec.join(self.vectors.select("h1", "h2", "vid"), ["h1", "h2"])
                               .join(self.vector_clusters, "vid").select("th1", "th2", "cluster_id"))

    @cached_property
    def labels(self) -> DataFrame:
        """(ids..., cluster_id) for every document (-1 = noise)."""
        return (self.doc_text.join(self.text_label, ["th1", "th2"], "left")
                    .select(*self.ids, F.coalesce(F.col("cluster_id"), F.lit(-1)).alias("cluster_id")))


def core_points(vectors: DataFrame, links: DataFrame, min_samples: int) -> DataFrame:
    """(vid, mult, mass, is_core): mass = own multiplicity + neighbours' multiplicities."""
    return neighbour_mass(vectors, links).withColumn("is_core", F.col("mass") >= min_samples)


def number_clusters(member: DataFrame, mult: DataFrame, min_cluster_size: int) -> DataFrame:
    """(vid, cluster_id) for vectors in clusters of >= ``min_cluster_size`` documents, from (vid, comp).

    Clusters are numbered by their first core vector, before the size filter.
    """
    member = cut_lineage(member)
    numbered = dense_index(member.select("comp"), "comp", "cluster_id")
    sized = (member.join(mult, "vid").groupBy("comp").agg(F.sum("mult").alias("size"))
                   .where(F.col("size") >= min_cluster_size))
    return (member.join(sized.select("comp"), "comp")
                  .join(numbered, "comp")
                  .select("vid", F.col("cluster_id").cast("int").alias("cluster_id")))


def density_clusters(docs: DataFrame, ids: list[str], ord_col: str, text_col: str = "full_text",
                     eps: float = DBSCAN_EPS, min_samples: int = DBSCAN_MIN_SAMPLES,
                     min_cluster_size: int = MIN_CLUSTER_SIZE,
                     max_features: int = TFIDF_MAX_FEATURES, min_df: int = 2,
                     stop_words: list[str] | None = STOP_WORDS) -> DensityResult:
    """Fit the pattern vectoriser on ``docs`` and cluster them.

    Identical texts are collapsed first (``textfeat.distinct_texts``), so
    tokenising, term counting and vector building run once per distinct
    text; vocabulary counts are weighted by the multiplicity, which gives
    the same vocabulary as counting every document.  Documents get their
    label through one join with the distinct-text table.
    """
    doc_text, texts = textfeat.distinct_texts(docs.select(*ids, ord_col, text_col), text_col, ord_col)
    texts = cut_lineage(texts)
    tkeys = ["th1", "th2"]
    n_docs = texts.agg(F.sum("tmult").alias("n_docs"))
    vocab = textfeat.text_vocabulary(texts, n_docs, max_features, min_df, stop_words)
    # The vocabulary (<= max_features rows, which the driver sees) and the
    # distinct vectors are each read several times: written once to the
    # reliable checkpoint folder (also bounds the lineage a lost executor replays).
    tid = F.row_number().over(Window.orderBy("df", "term")) - 1
    vocab = cut_lineage(vocab.withColumn("tid", tid.cast("int")))
    terms = vocab.select("term", "idf").orderBy("tid").collect()
    per = textfeat.text_vectors(texts, [*tkeys, "tord", "tmult"], [r["term"] for r in terms], stop_words)
    text_vec, vectors = S.collapse_vectors(per, tkeys, "tord", "tmult")
    vectors = cut_lineage(vectors)
    members = doc_text.join(text_vec, tkeys).select(*ids, "h1", "h2")
    return DensityResult(ids, vocab, members, vectors, doc_text, text_vec, np.array([r["idf"] for r in terms], np.float64),
                         1.0 - eps, min_samples, min_cluster_size)


def noise_count(labels: DataFrame) -> DataFrame:
    """Noise and total counts."""
    return labels.agg(F.count_if(F.col("cluster_id") == -1).alias("noise_count"),
                      F.count(F.lit(1)).alias("total_tickets"))

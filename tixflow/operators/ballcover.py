"""Density clusters without the neighbour graph.

The tiles of the similarity join return neighbour masses and links
(``similarity.near_vectors``): all pairs of vectors that are not core inside a
pair of tiles, and between the others as many as connect them.  The masses add
up to the exact core points, the links between core points have the components
of all their pairs, and a border vector, having less than ``min_samples``
neighbours, has all of its pairs among the links.  k near-identical texts thus
cost rows in proportion to k, not their k * (k - 1) / 2 pairs, and no table of
pairs is written.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tixflow.operators import similarity as S
from tixflow.operators.components import connected_components
from tixflow.session import cut_lineage


def neighbour_links(vec: DataFrame, threshold: float, min_samples: int, tile: int = S.TILE, idf: np.ndarray | None = None) -> DataFrame:
    """(a, b, mass), written: the links of ``similarity.near_vectors``.

    Neighbours are vectors whose cosine, rounded as in ``similar_pairs``, is at
    least ``threshold``.
    """
    return cut_lineage(S.near_vectors(vec, math.acos(max(threshold - 1e-9, -1.0)), tile, idf, links=min_samples))


def neighbour_mass(vec: DataFrame, links: DataFrame) -> DataFrame:
    """(vid, mult, mass): own multiplicity and that of all neighbours."""
    near = links.where("b is null").groupBy("a").agg(F.sum("mass").alias("near")).withColumnRenamed("a", "vid")
    return vec.select("vid", "mult").join(near, "vid", "left").select("vid", "mult", (F.col("mult") + F.coalesce("near", F.lit(0))).alias("mass"))


def ball_clusters(vec: DataFrame, threshold: float, min_samples: int, tile: int = S.TILE, idf: np.ndarray | None = None,
                  links: DataFrame | None = None) -> DataFrame:
    """(vid, comp) of every core and border vector; comp is the component's smallest core vid.

    ``vec``: as in ``similarity.near_vectors``; ``mult`` is the number of
    documents with the vector, which is its own neighbour.  ``links``: as of
    ``neighbour_links``, made if not given.
    """
    if links is None:
        links = neighbour_links(vec, threshold, min_samples, tile, idf)
    core = cut_lineage(neighbour_mass(vec, links).where(F.col("mass") >= min_samples).select(F.col("vid").alias("node")))
    pairs = links.where("b is not null").select("a", "b")
    known = [core.select(F.col("node").alias(x), F.lit(True).alias(f"core_{x}")) for x in "ab"]
    pairs = cut_lineage(pairs.join(known[0], "a", "left").join(known[1], "b", "left"))
    comp = connected_components(core, pairs.where("core_a and core_b").select(F.col("a").alias("src"), F.col("b").alias("dst")))
    beside = pairs.where("core_a is null and core_b").select(F.col("a").alias("vid"), F.col("b").alias("node")).unionByName(
        pairs.where("core_a and core_b is null").select(F.col("b").alias("vid"), F.col("a").alias("node")))
    border = beside.join(comp, "node").groupBy("vid").agg(F.min("comp").alias("comp"))
    return comp.select(F.col("node").alias("vid"), "comp").unionByName(border)

"""Cosine silhouette of a grouping as a relation.

For unit vectors the distances of a point to a whole group add up to
``n - x . S`` with the group's size and vector sum, so the mean distance to every
group needs one product with each of the k sums and no pair of points.  Equal
vectors of one group are one row with a multiplicity.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tixflow.session import cut_lineage


def cosine_silhouette(points: DataFrame, weights: DataFrame, ids: list[str], label: str) -> DataFrame:
    """(ids..., label, mult, silhouette) of every point.

    ``points``: (ids..., label, mult), one row per distinct vector and group;
    ``weights``: (ids..., term, w), unit vectors (points without a row there, the
    zero vectors, have no direction and are left out).  A point alone in its
    group has 0; one group alone has no silhouette (null).  The sums have at most
    groups x vocabulary rows, which are broadcast with the group sizes.
    """
    real = cut_lineage(points.join(weights.select(*ids).distinct(), ids, "left_semi"))
    sizes = real.groupBy(F.col(label).alias("_g")).agg(F.sum("mult").alias("_n"))
    sums = (real.join(weights, ids).groupBy(F.col(label).alias("_g"), "term")
                .agg(F.sum(F.col("w") * F.col("mult")).alias("_s")))
    sizes, sums = cut_lineage(sizes), cut_lineage(sums)
    dots = (weights.join(real.select(*ids).distinct(), ids).join(F.broadcast(sums), "term")
                   .groupBy(*ids, "_g").agg(F.sum(F.col("w") * F.col("_s")).alias("_dot")))
    # every point beside every group: as many rows a point as there are groups
    groups = F.broadcast(sizes.agg(F.collect_list(F.struct("_g", "_n")).alias("_all")))
    each = real.crossJoin(groups).select(*ids, label, "mult", F.inline("_all")).join(dots, [*ids, "_g"], "left")
    away = F.col("_n") - F.coalesce("_dot", F.lit(0.0))
    own = F.col("_g") == F.col(label)
    s = each.groupBy(*ids, label, "mult").agg(F.max(F.when(own, F.col("_n"))).alias("_own"),
                                              F.max(F.when(own & (F.col("_n") > 1), away / (F.col("_n") - 1))).alias("_a"),
                                              F.min(F.when(~own, away / F.col("_n"))).alias("_b"))
    top = F.greatest("_a", "_b")
    value = (F.when(F.col("_b").isNull(), F.lit(None)).when(F.col("_own") == 1, F.lit(0.0)).when(F.abs(top) < 1e-12, F.lit(0.0))
              .otherwise((F.col("_b") - F.col("_a")) / top))
    return s.select(*ids, label, "mult", value.alias("silhouette"))


def mean_silhouette(scored: DataFrame, label: str) -> DataFrame:
    """(label, n, silhouette): the mean of each group, and of all points under a null label."""
    mean = [F.sum("mult").alias("n"), (F.sum(F.col("silhouette") * F.col("mult")) / F.sum("mult")).alias("silhouette")]
    return scored.groupBy(label).agg(*mean).unionByName(scored.agg(*mean).withColumn(label, F.lit(None).cast(scored.schema[label].dataType)))

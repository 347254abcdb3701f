"""Connected components over staged edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tixflow.llm.common import stage


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, comp) for the nodes of ``edges`` (a, b); comp is the smallest node reached.

    Each round takes the least label of the neighbours, then the label's own
    label, so distances halve.  Both inputs of every join are staged tables: a
    node or label with very many edges is a skewed join that AQE splits, and
    minima are combined before they are shuffled.  The driver sees one row per
    round.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    e = stage(both.where("a <> b").distinct())
    labels = stage(e.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("label")))
    for _ in range(max_rounds):
        near = e.join(labels, e.b == labels.node).select(F.col("a").alias("node"), "label", F.lit(None).cast("long").alias("old"))
        own = labels.select("node", "label", F.col("label").alias("old"))
        step = stage(near.unionByName(own).groupBy("node").agg(F.min("label").alias("label"), F.min("old").alias("old")))
        if step.where("label <> old").limit(1).count() == 0:  # no edge joins two labels
            return labels.select("node", F.col("label").alias("comp"))
        to = step.select(F.col("node").alias("via"), F.col("label").alias("next"))
        labels = stage(step.join(to, step.label == to.via).select("node", F.least("label", "next").alias("label")))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")

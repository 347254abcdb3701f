"""Connected components and distributed ranking.

Components: min-label propagation with pointer jumping (label := label of
the label), a written table in each round so the lineage stays short and
a lost executor only costs the current round.  The driver sees one row per
round (whether a label changed).  Hot vertices and labels: both inputs of
every join are written tables, i.e. plain shuffles, which AQE's skew join
can split; minima are combined before they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tixflow.session import cut_lineage


def connected_components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, comp) with comp = smallest node id of the node's component.

    ``nodes``: column ``node`` (LONG); ``edges``: ``src``, ``dst`` (undirected,
    either direction suffices).
    """
    e = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    e = cut_lineage(e.where(F.col("src") != F.col("dst")).distinct())
    labels = cut_lineage(nodes.select("node", F.col("node").alias("label")).distinct())
    for _ in range(max_rounds):
        near = e.join(labels, e.src == labels.node).select(F.col("dst").alias("node"), "label",
                                                           F.lit(None).cast("long").alias("old"))
        own = labels.select("node", "label", F.col("label").alias("old"))
        step = cut_lineage(near.unionByName(own).groupBy("node")
                               .agg(F.min("label").alias("label"), F.min("old").alias("old")))
        via = step.select(F.col("node").alias("via"), F.col("label").alias("next"))
        jumped = cut_lineage(step.join(via, F.col("label") == F.col("via"))
                                 .select("node", F.least("label", "next").alias("label"), "old"))
        labels = jumped.select("node", "label")
        if jumped.where("label <> old").limit(1).count() == 0:
            return labels.select("node", F.col("label").alias("comp"))
    raise RuntimeError(f"connected components did not converge in {max_rounds} rounds")


def dense_index(df: DataFrame, order_col: str, out: str = "idx") -> DataFrame:
    """0-based position of each distinct ``order_col`` value in ascending order.

    Range-partitioned sort, per-partition counts (one row per partition),
    prefix offsets, then ``offset + position in partition``: no single-task
    window over the whole table.
    """
    s = (df.select(order_col).distinct().orderBy(order_col)
           .select(order_col, F.spark_partition_id().alias("_pid"),
                   F.monotonically_increasing_id().alias("_mid")))
    s = cut_lineage(s)
    counts = s.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_base"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = counts.select("_pid", "_base", (F.sum("_n").over(w) - F.col("_n")).alias("_off"))
    return (s.join(F.broadcast(offsets), "_pid")
             .select(order_col, (F.col("_off") + F.col("_mid") - F.col("_base")).alias(out)))

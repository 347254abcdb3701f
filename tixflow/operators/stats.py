"""Distributed exact order statistics.

``exact_median`` gives the interpolating median (pandas / SQL ``median``)
per group without holding a group's values in one buffer: an approximate
quantile sketch (bounded memory, merged map-side) brackets the two middle
ranks, then only the distinct values inside the bracket are ranked exactly.
The bracket is checked; if a group's bracket misses (never expected), the
check widens it and runs again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tixflow.session import cut_lineage


def _bracketed(v: DataFrame, keys: list[str], accuracy: int, width: float) -> DataFrame:
    lo_p = max(0.0, 0.5 - width)
    hi_p = min(1.0, 0.5 + width)
    stats = v.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.percentile_approx("_v", [lo_p, hi_p], accuracy).alias("_br"),
    ).select(*keys, "_n", F.col("_br")[0].alias("_lo"), F.col("_br")[1].alias("_hi"),
             # 1-based ranks of the two middle values
             (F.floor((F.col("_n") - 1) / 2) + 1).alias("_k1"),
             (F.floor(F.col("_n") / 2) + 1).alias("_k2"))
    joined = v.join(stats, keys)
    below = joined.groupBy(*keys).agg(F.count_if(F.col("_v") < F.col("_lo")).alias("_below"))
    inside = (joined.where((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))
                    .groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c")))
    w = Window.partitionBy(*keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = (inside.join(below, keys).join(stats.select(*keys, "_k1", "_k2"), keys)
                    .withColumn("_cum", F.col("_below") + F.sum("_c").over(w)))
    ranked = ranked.withColumn("_prev", F.col("_cum") - F.col("_c"))
    hit1 = (F.col("_prev") < F.col("_k1")) & (F.col("_cum") >= F.col("_k1"))
    hit2 = (F.col("_prev") < F.col("_k2")) & (F.col("_cum") >= F.col("_k2"))
    picked = ranked.groupBy(*keys).agg(
        F.max(F.when(hit1, F.col("_v"))).alias("_v1"),
        F.max(F.when(hit2, F.col("_v"))).alias("_v2"))
    return stats.select(*keys).join(picked, keys, "left")


def exact_median(df: DataFrame, keys: list[str], value: str, out: str = "median",
                 accuracy: int = 200_000, verify: bool = True) -> DataFrame:
    """Per-group interpolating median of ``value`` (NULLs ignored).

    Groups with no non-NULL value are absent from the result.  The sketch's
    rank error is at most n / accuracy, and the bracket is four times that
    wide.  Every group is checked; if one missed, the bracket is widened.
    The keys and values are materialised once for all passes.
    """
    v = cut_lineage(df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v")))
    width = 4.0 / accuracy
    while True:
        res = cut_lineage(_bracketed(v, keys, accuracy, width))  # one row per group
        if not verify or width >= 0.5:
            break
        # Cheap completeness check: one scalar back to the driver.
        missing = res.where(F.col("_v1").isNull() | F.col("_v2").isNull()).limit(1).count()
        if missing == 0:
            break
        width *= 8
    return res.select(*keys, ((F.col("_v1") + F.col("_v2")) / 2).alias(out))

"""Health score (H1-H3) from one-row aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tixflow.config import HEALTH_BANDS, HEALTH_CAPS, HEALTH_WEIGHTS
from tixflow.operators.metrics import ticket_totals


def _capped(n: Column, key: str) -> Column:
    return F.least(n.cast("double") * F.lit(HEALTH_WEIGHTS[key]), F.lit(HEALTH_CAPS[key]))


def health_deductions(t: DataFrame, n_patterns: DataFrame) -> DataFrame:
    """H1: one row per deduction ``(deduction, count, points)``.

    ``n_patterns`` is a one-row frame with column ``n_patterns``.  The rate
    deduction uses the percent of resolved tickets with a blank root cause
    and is 0 when nothing is resolved.
    """
    tot = ticket_totals(t).crossJoin(n_patterns.select("n_patterns"))  # 1 x 1 rows
    rate = F.when(F.col("resolved") > 0,
                  F.col("resolved_no_root_cause") * 100.0 / F.col("resolved")).otherwise(F.lit(0.0))
    rows = F.array(
        F.struct(F.lit("p1_open").alias("deduction"), F.col("p1_open").cast("double").alias("count"),
                 _capped(F.col("p1_open"), "p1_open_per_ticket").alias("points")),
        F.struct(F.lit("p1_breach").alias("deduction"), F.col("p1_breach").cast("double").alias("count"),
                 _capped(F.col("p1_breach"), "p1_breach_per_ticket").alias("points")),
        F.struct(F.lit("recurring_patterns").alias("deduction"), F.col("n_patterns").cast("double").alias("count"),
                 _capped(F.col("n_patterns"), "recurring_pattern").alias("points")),
        F.struct(F.lit("aged_open").alias("deduction"), F.col("aged_open").cast("double").alias("count"),
                 _capped(F.col("aged_open"), "unresolved_7d").alias("points")),
        F.struct(F.lit("no_root_cause_rate").alias("deduction"), rate.alias("count"),
                 F.least(rate * F.lit(HEALTH_WEIGHTS["no_root_cause_rate"]),
                         F.lit(HEALTH_CAPS["no_root_cause_rate"])).alias("points")),
    )
    return tot.select(F.inline(rows))


def score_label(score: Column) -> tuple[Column, Column]:
    label = None
    color = None
    for bound, name, colour in HEALTH_BANDS:
        cond = F.lit(True) if bound is None else score >= bound
        label = F.when(cond, F.lit(name)) if label is None else label.when(cond, F.lit(name))
        color = F.when(cond, F.lit(colour)) if color is None else color.when(cond, F.lit(colour))
    return label, color


def health_score(t: DataFrame, n_patterns: DataFrame) -> DataFrame:
    """H2 + H3: ``max(0, floor(100 - deductions))`` with its label and colour.

    Deductions are subtracted one after another in a fixed order (as a
    running score), so the floating result does not depend on a sum order.
    """
    d = health_deductions(t, n_patterns)
    order = ["p1_open", "p1_breach", "recurring_patterns", "aged_open", "no_root_cause_rate"]
    pts = d.agg(*[F.max(F.when(F.col("deduction") == k, F.col("points"))).alias(k) for k in order])
    running = F.lit(100.0)
    for k in order:
        running = running - F.col(k)
    s = pts.select(F.greatest(F.lit(0), F.floor(running).cast("int")).alias("health_score"),
                   (F.lit(100.0) - running).alias("total_deduction"))
    label, color = score_label(F.col("health_score"))
    return s.select("health_score", label.alias("health_label"), color.alias("health_color"),
                    "total_deduction")

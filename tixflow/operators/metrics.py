"""Ticket metrics (M1-M9): one-pass aggregates with map-side partial combine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tixflow.config import AGED_HOURS, MTTR_SLA_HOURS, OPEN_STATES
from tixflow.functions.lookup import lookup
from tixflow.functions.text import strip_ws
from tixflow.operators.stats import exact_median
from tixflow.session import cut_lineage


def is_open(states: list[str] | None = None) -> Column:
    """Open = New / In Progress / On Hold; everything else counts as resolved."""
    return F.col("state").isin(OPEN_STATES if states is None else states)


def blank_root_cause() -> Column:
    return strip_ws(F.coalesce(F.col("root_cause"), F.lit(""))) == ""


def ticket_totals(t: DataFrame) -> DataFrame:
    """M1 (+ aged open and blank-root-cause counts used by H1 and M9)."""
    op = is_open()
    return t.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(op).alias("open"),
        F.count_if(~op).alias("resolved"),
        F.count_if(op & (F.col("priority") == "P1")).alias("p1_open"),
        F.count_if(F.col("priority") == "P1").alias("p1_total"),
        F.count_if(op & (F.col("age_hours") > AGED_HOURS)).alias("aged_open"),
        F.count_if(~op & blank_root_cause()).alias("resolved_no_root_cause"),
        F.count_if((F.col("priority") == "P1") & (F.col("mttr_hours") > MTTR_SLA_HOURS["P1"]))
         .alias("p1_breach"),
    )


def value_counts(t: DataFrame, col: str, out: str = "count", top: int | None = None,
                 drop_null: bool = True) -> DataFrame:
    """Count per value, descending; ties by value ascending (M2, M4-M7)."""
    src = t.where(F.col(col).isNotNull()) if drop_null else t
    res = src.groupBy(col).agg(F.count(F.lit(1)).alias(out))
    if top is not None:
        res = res.orderBy(F.col(out).desc(), F.col(col).asc()).limit(top)
    return res


def priority_counts(t: DataFrame) -> DataFrame:
    return value_counts(t, "priority")


def top_categories(t: DataFrame, n: int = 10) -> DataFrame:
    return value_counts(t, "category", top=n)


def top_groups(t: DataFrame, n: int = 8) -> DataFrame:
    return value_counts(t, "assignment_group", top=n)


def state_counts(t: DataFrame) -> DataFrame:
    return value_counts(t, "state")


def record_type_counts(t: DataFrame) -> DataFrame:
    return value_counts(t, "record_type")


def time_range(t: DataFrame) -> DataFrame:
    """M8."""
    return t.agg(F.min("opened_at").alias("time_range_start"),
                 F.max("opened_at").alias("time_range_end"))


def no_root_cause_pct(t: DataFrame) -> DataFrame:
    """M9: percent of resolved tickets with a blank root cause (0 if none)."""
    op = is_open()
    return t.agg(F.coalesce(
        F.avg(F.when(~op, F.when(blank_root_cause(), 100.0).otherwise(0.0))),
        F.lit(0.0)).alias("no_root_cause_pct"))


def mttr_by_priority(t: DataFrame, sla: dict[str, int] | None = None) -> DataFrame:
    """M3: avg, exact median, SLA and breach % of MTTR for priorities with a target.

    Priorities without any MTTR value are absent.  Breach compares against the
    target (no target -> never breached).
    """
    targets = MTTR_SLA_HOURS if sla is None else sla
    v = cut_lineage(t.where(F.col("priority").isin(list(targets)) & F.col("mttr_hours").isNotNull()) \
         .select("priority", "mttr_hours"))
    sla_col = lookup(F.col("priority"), {k: str(x) for k, x in targets.items()}).cast("int")
    agg = v.groupBy("priority").agg(
        F.avg("mttr_hours").alias("avg_mttr"),
        F.avg(F.when(F.col("mttr_hours") > sla_col, 100.0).otherwise(0.0)).alias("breach_pct"),
        F.count(F.lit(1)).alias("n"),
    )
    med = exact_median(v, ["priority"], "mttr_hours", out="median_mttr")
    return (agg.join(med, "priority")
               .select("priority", "n", "avg_mttr", "median_mttr",
                       sla_col.alias("sla_hours"), "breach_pct"))

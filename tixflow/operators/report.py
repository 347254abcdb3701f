"""Recommendations (A1-A7), the nested report row (J1) and the pipeline.

Everything here works on small, bounded frames (one-row aggregates, the top
three patterns / root causes, a dozen rules), assembled with unions and
cross joins of one-row frames; the heavy lifting happened upstream.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tixflow.config import REPORT_ACTIONS
from tixflow.operators import classify as C
from tixflow.operators import clusters as CL
from tixflow.operators import health as H
from tixflow.operators import metrics as M
from tixflow.operators import rootcause as R
from tixflow.operators import textfeat
from tixflow.operators.density import density_clusters, noise_count
from tixflow.session import cut_lineage


def py_round1(x: Column) -> Column:
    """Text of ``round(x, 1)`` as Python prints it (half-even, one decimal)."""
    return F.format_string("%.1f", F.bround(x, 1))


def _rec(seq: Column, priority: str, finding: Column, action: Column) -> list[Column]:
    return [seq.alias("seq"), F.lit(priority).alias("priority"), finding.alias("finding"), action.alias("action")]


def recommendations(t: DataFrame, mttr: DataFrame, patterns: DataFrame, rc_recs: DataFrame | None,
                    dedupe: str = "prefix60", limit: int = 10, by_time: bool = True) -> DataFrame:
    """(seq, priority, finding, action), in rule order, deduplicated
    on the first 60 characters of the action (``dedupe='full'`` uses the
    whole action), at most ``limit``.

    ``patterns``: cluster summary rows (id, label, size, keywords,
    top_services, trend, trend_by_time), of which ``by_time`` picks the
    time-split trend (False: the size-only rule); ``rc_recs``: (rc_order, rank, label, ticket_count,
    recommendation) for the root causes in ticket-count order, or None.
    """
    tot = M.ticket_totals(t)
    nrc = M.no_root_cause_pct(t)
    # One-row frames throughout (an aggregate without keys always has one row).
    p1 = mttr.agg(F.max(F.when(F.col("priority") == "P1", F.col("breach_pct"))).alias("p1_breach_pct"))
    one = tot.crossJoin(nrc).crossJoin(p1)
    a1 = one.where(F.bround("p1_breach_pct", 1) > 20).select(*_rec(
        F.lit(1000), "High", F.concat(F.lit("P1 SLA breached "), py_round1(F.col("p1_breach_pct")), F.lit("% of the time")),
        F.lit(REPORT_ACTIONS["p1_breach"])))
    a2 = one.where(F.col("p1_open") >= 2).select(*_rec(
        F.lit(2000), "High", F.format_string("%d P1 ticket(s) currently open", F.col("p1_open")),
        F.lit(REPORT_ACTIONS["p1_open"])))
    top3 = patterns.orderBy(F.col("size").desc(), F.col("cluster_id").asc()).limit(3)
    top3 = top3.withColumn("_o", F.row_number().over(Window.orderBy(F.col("size").desc(), F.col("cluster_id").asc())))
    services = F.slice("top_services", 1, 2)
    a3 = top3.where(F.col("size") >= 5).select(*_rec(
        F.lit(3000) + F.col("_o"), "Medium",
        F.format_string("Recurring pattern: '%s' (%d tickets, trend: %s)", F.col("label"), F.col("size"),
                        F.col("trend_by_time" if by_time else "trend")),
        F.concat(F.lit(REPORT_ACTIONS["pattern_prefix"]), F.lit("Top keywords: "),
                 F.array_join(F.slice("keywords", 1, 3), ", "), F.lit(". "),
                 F.when(F.size("top_services") > 0,
                        F.concat(F.lit("Primarily affects: "), F.array_join(services, ", "), F.lit(".")))
                  .otherwise(F.lit("")))))
    parts = [a1, a2, a3]
    if rc_recs is not None:
        parts.append(rc_recs.where(F.col("rc_order") <= 3).select(*_rec(
            F.lit(4000) + F.col("rc_order") * 10 + F.col("rank"), "Medium",
            F.format_string("Root cause cluster: '%s' (%d tickets)", F.col("label"), F.col("ticket_count")),
            F.col("recommendation"))))
    parts.append(one.where(F.bround("no_root_cause_pct", 1) > 40).select(*_rec(
        F.lit(5000), "Low",
        F.concat(py_round1(F.col("no_root_cause_pct")), F.lit("% of resolved tickets have no root cause recorded")),
        F.lit(REPORT_ACTIONS["no_root_cause"]))))
    parts.append(one.where(F.col("aged_open") > 0).select(*_rec(
        F.lit(6000), "Medium", F.format_string("%d ticket(s) open for more than 7 days", F.col("aged_open")),
        F.lit(REPORT_ACTIONS["aged"]))))
    allr = parts[0]
    for p in parts[1:]:
        allr = allr.unionByName(p)
    dkey = F.substring("action", 1, 60) if dedupe == "prefix60" else F.col("action")
    first = F.row_number().over(Window.partitionBy(dkey).orderBy("seq"))
    kept = allr.withColumn("_f", first).where(F.col("_f") == 1).drop("_f")
    ordered = F.row_number().over(Window.orderBy("seq"))
    return kept.withColumn("seq", ordered).where(F.col("seq") <= limit)


@dataclass
class Report:
    tickets: DataFrame           # classified tickets with cluster_id (and rc_cluster when resolved)
    metrics: dict[str, DataFrame]
    health: DataFrame
    deductions: DataFrame
    patterns: DataFrame          # cluster summary rows
    members: DataFrame           # (cluster_id, number)
    noise: DataFrame
    root_causes: DataFrame       # root-cause summary rows
    links: DataFrame             # (rc_cluster, pattern_id, shared_tickets, pattern_label)
    insight: DataFrame
    actions: DataFrame
    recommendations: DataFrame
    row: DataFrame               # one nested row (J1)
    summary: DataFrame           # one flat row: score, totals and counts


def root_cause_summary(rc_corpus: DataFrame, links: DataFrame, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """R7, R8, R10, R11 per root-cause cluster + the recommendation rows."""
    key = "rc_cluster"
    kw = CL.keyword_arrays(CL.cluster_keywords(rc_corpus, key=key, text_col="resolution_text"), key)
    base = rc_corpus.groupBy(key).agg(F.count(F.lit(1)).alias("ticket_count"), F.avg("mttr_hours").alias("avg_mttr_hours"))
    empty = F.array().cast("array<string>")
    kws = base.join(kw, key, "left").withColumn("keywords", F.coalesce("keywords", empty))
    label = CL.keyword_label(F.col("keywords"), single_suffix="", empty="Unknown Root Cause")
    recs = R.map_recommendations(kws.select(key, "keywords"), key, R.rules_frame(spark))
    rec_arr = recs.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("rank", "recommendation"))).alias("_r")) \
                  .select(key, F.transform("_r", lambda x: x["recommendation"]).alias("recommendations"))
    pdist = CL.priority_distribution(rc_corpus, key)
    groups = CL.ranked_array(CL.top_values(rc_corpus, "assignment_group", 2, key), key).withColumnRenamed("values", "top_groups")
    samples = (R.first_n_per_group(rc_corpus.select(key, "ingest_ord", "resolution_text"), key, "ingest_ord", 3)
                .groupBy(key).agg(F.sort_array(F.collect_list(F.struct("ingest_ord", "resolution_text"))).alias("_s"))
                .select(key, F.transform("_s", lambda x: x["resolution_text"]).alias("sample_resolutions")))
    linked = links.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pattern_id", "pattern_label", "shared_tickets")))
                                    .alias("linked_patterns"))
    out = (kws.join(pdist, key).join(groups, key, "left").join(rec_arr, key, "left")
              .join(samples, key, "left").join(linked, key, "left")
              .select(F.col(key).alias("id"), label.alias("label"), "keywords", "ticket_count",
                      F.create_map(*[x for p in ["P1", "P2", "P3", "P4", "Unknown"] for x in (F.lit(p), F.col(p))]).alias("priority_dist"),
                      F.coalesce("top_groups", empty).alias("top_groups"), "avg_mttr_hours",
                      F.coalesce("linked_patterns", F.array().cast(linked.schema["linked_patterns"].dataType)).alias("linked_patterns"),
                      F.coalesce("recommendations", empty).alias("recommendations"),
                      "sample_resolutions"))
    order = F.row_number().over(Window.orderBy(F.col("ticket_count").desc(), F.col("id").asc()))
    ranked = out.withColumn("rc_order", order)
    rc_recs = (ranked.select("id", "rc_order", "label", "ticket_count")
                     .join(recs.withColumnRenamed(key, "id"), "id")
                     .select("rc_order", "rank", "label", "ticket_count", "recommendation"))
    return ranked, rc_recs


def with_labels(t: DataFrame, labels: DataFrame, key: str = "number") -> DataFrame:
    """``t`` with ``cluster_id``; null-safe, so the ticket without a number keeps its row."""
    lab = labels.select(F.col(key).alias("_key"), "cluster_id")
    return t.join(lab, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")


def with_text_labels(t: DataFrame, text_label: DataFrame, text_col: str = "full_text") -> DataFrame:
    """As ``with_labels``, from the labels of distinct texts (th1, th2, cluster_id): no row is moved by its number."""
    out = textfeat.with_text_hash(t, text_col).join(text_label, ["th1", "th2"], "left")
    return out.withColumn("cluster_id", F.coalesce("cluster_id", F.lit(-1))).drop("th1", "th2")


def run_report(tickets: DataFrame, as_of: datetime | str | None = None, *, with_root_causes: bool = True,
               generated_at: str | None = None) -> Report:
    """Classify -> recurring patterns -> root causes -> metrics, health, advice.

    ``tickets`` are normalised tickets.  Intermediate tables reused by many
    outputs are checkpointed once (reliable storage).
    """
    spark = tickets.sparkSession
    tickets = cut_lineage(tickets)
    dens = density_clusters(tickets, ["number"], "ingest_ord")
    t = cut_lineage(with_text_labels(C.classify(tickets, staged=True), dens.text_label))
    patterns = cut_lineage(CL.cluster_summary(t))
    n_patterns = patterns.agg(F.count(F.lit(1)).alias("n_patterns"))
    mttr = M.mttr_by_priority(t)
    metrics = {
        "totals": M.ticket_totals(t), "priority_counts": M.priority_counts(t), "mttr": mttr,
        "categories": M.top_categories(t), "groups": M.top_groups(t), "states": M.state_counts(t),
        "record_types": M.record_type_counts(t), "time_range": M.time_range(t),
        "no_root_cause_pct": M.no_root_cause_pct(t),
    }
    health = H.health_score(t, n_patterns)
    deductions = H.health_deductions(t, n_patterns)
    links = spark.createDataFrame([], "rc_cluster int, pattern_id int, shared_tickets long, pattern_label string")
    rc_rows = spark.createDataFrame([], "id int")
    rc_recs = None
    actions = spark.createDataFrame([], "phrase string, count long")
    if with_root_causes:
        rc = R.root_cause_clusters(t)
        if rc.k > 0:
            links = R.link_patterns(rc.corpus, t, patterns.select("cluster_id", "label"))
            rc_rows, rc_recs = root_cause_summary(rc.corpus, links, spark)
            actions = R.top_actions(rc.corpus)
    insight = R.open_insight(t)
    recs = recommendations(t, mttr, patterns, rc_recs)
    row = report_row(health, metrics, patterns, dens.labels, rc_rows, insight, actions, recs, generated_at)
    summary = report_summary(health, metrics, patterns, noise_count(dens.labels), generated_at)
    return Report(t, metrics, health, deductions, patterns, CL.cluster_members(t), noise_count(dens.labels),
                  rc_rows, links, insight, actions, recs, row, summary)


def _generated(generated_at: str | None) -> Column:
    return F.lit(generated_at) if generated_at else F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm 'UTC'")


def report_summary(health: DataFrame, metrics: dict[str, DataFrame], patterns: DataFrame, noise: DataFrame,
                   generated_at: str | None = None) -> DataFrame:
    """One flat row of bounded size, whatever the number of patterns or states."""
    n = patterns.agg(F.count(F.lit(1)).alias("n_patterns"))
    return (health.select(_generated(generated_at).alias("generated_at"), "health_score", "health_label")
                  .crossJoin(metrics["totals"].select("total", "open", "resolved", "p1_open", "aged_open"))
                  .crossJoin(metrics["no_root_cause_pct"].select(F.bround("no_root_cause_pct", 1).alias("no_root_cause_pct")))
                  .crossJoin(n).crossJoin(noise.select("noise_count")))


def write_report(report: Report, path: str, mode: str = "overwrite") -> None:
    """The report as tables side by side, none of which holds a list that grows with the tickets."""
    tables = {"summary": report.summary, "deductions": report.deductions, "patterns": report.patterns,
              "pattern_members": report.members, "root_causes": report.root_causes, "pattern_links": report.links,
              "top_actions": report.actions, "recommendations": report.recommendations,
              **{f"metric_{name}": df for name, df in report.metrics.items()}}
    for name, df in tables.items():
        df.write.mode(mode).parquet(f"{path}/{name}.parquet")


def sorted_structs(df: DataFrame, desc_col: str, asc_col: str) -> Column:
    """Aggregate: rows as structs ordered by ``desc_col`` desc, ``asc_col`` asc
    (comparator sort: the rows hold maps, which are not orderable)."""
    arr = F.collect_list(F.struct(F.col(desc_col).alias("_s"), F.col(asc_col).alias("_i"),
                                  F.struct(*df.columns).alias("_v")))

    def cmp(x, y):
        return (F.when(x["_s"] > y["_s"], -1).when(x["_s"] < y["_s"], 1)
                 .when(x["_i"] < y["_i"], -1).when(x["_i"] > y["_i"], 1).otherwise(0))
    return F.transform(F.array_sort(arr, cmp), lambda e: e["_v"])


def report_row(health: DataFrame, metrics: dict[str, DataFrame], patterns: DataFrame, labels: DataFrame,
               rc_rows: DataFrame, insight: DataFrame, actions: DataFrame, recs: DataFrame,
               generated_at: str | None = None) -> DataFrame:
    """One nested row; every part is a one-row frame, cross-joined.

    Hours and percentages are presented with one decimal.  The row holds every
    pattern; ``write_report`` is the form for many.
    """
    gen = _generated(generated_at)

    def one_decimal(df: DataFrame, *cols: str) -> DataFrame:
        return df.select(*(F.bround(c, 1).alias(c) if c in cols else c for c in df.columns))

    metrics = metrics | {"mttr": one_decimal(metrics["mttr"], "avg_mttr", "median_mttr", "breach_pct"),
                         "no_root_cause_pct": one_decimal(metrics["no_root_cause_pct"], "no_root_cause_pct")}
    patterns = one_decimal(patterns, "avg_mttr_hours")
    rc_rows = one_decimal(rc_rows, "avg_mttr_hours")

    def packed(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.collect_list(F.struct(*df.columns)).alias(name))

    tot = metrics["totals"].crossJoin(metrics["time_range"]).crossJoin(metrics["no_root_cause_pct"])
    m = tot.select(F.struct(*tot.columns).alias("summary"))
    for name in ["priority_counts", "mttr", "categories", "groups", "states", "record_types"]:
        m = m.crossJoin(packed(metrics[name], name))
    metrics_row = m.select(F.struct(*m.columns).alias("metrics"))
    pat = patterns.withColumnRenamed("cluster_id", "id")
    pats = pat.agg(sorted_structs(pat, "size", "id").alias("clusters"))
    nz = noise_count(labels)
    patterns_row = pats.crossJoin(nz).select(F.struct("clusters", "noise_count", "total_tickets").alias("patterns"))
    rcs = (rc_rows.agg(sorted_structs(rc_rows, "ticket_count", "id").alias("root_causes"))
           if "ticket_count" in rc_rows.columns else rc_rows.agg(F.collect_list(F.struct(*rc_rows.columns)).alias("root_causes")))
    rc_struct = rcs.crossJoin(insight.select("insight")).crossJoin(
        actions.agg(F.collect_list("phrase").alias("top_repeated_actions"))).select(
        F.struct(F.col("root_causes"), F.col("insight").alias("unresolved_insight"), "top_repeated_actions").alias("root_causes"))
    rec = recs.agg(F.sort_array(F.collect_list(F.struct("seq", "priority", "finding", "action"))).alias("recommendations"))
    return (health.select(gen.alias("generated_at"), "health_score", "health_label", "health_color")
                  .crossJoin(metrics_row).crossJoin(patterns_row).crossJoin(rc_struct).crossJoin(rec))

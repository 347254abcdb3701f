"""Registered queries for health, recommendations, root causes and the report."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tixflow.config import RECOMMENDATION_RULES, REPORT_ACTIONS, STOP_WORDS, TFIDF_MAX_FEATURES
from tixflow.functions.text import vectoriser_terms
from tixflow.operators import metrics as M
from tixflow.operators import textfeat as TF
from tixflow.plans import fixtures as FX
from tixflow.plans import oracle as O
from tixflow.plans.catalog import (_sql_on_tickets, clustered_tickets, memo, r6,
                                   register, tickets)


def _n_patterns(ct: DataFrame) -> DataFrame:
    return ct.where("cluster_id >= 0").agg(F.countDistinct("cluster_id").alias("n_patterns"))


def _health_base_sql(ct: str) -> str:
    return f"""SELECT count(*) FILTER (WHERE state IN {O.OPEN_IN} AND priority = 'P1') AS p1_open,
  count(*) FILTER (WHERE priority = 'P1' AND mttr_hours > 4) AS p1_breach,
  count(*) FILTER (WHERE state IN {O.OPEN_IN} AND age_hours > 168) AS aged_open,
  count(*) FILTER (WHERE state NOT IN {O.OPEN_IN}) AS resolved,
  count(*) FILTER (WHERE state NOT IN {O.OPEN_IN} AND {O.strip('root_cause')} = '') AS nrc,
  (SELECT count(DISTINCT cluster_id) FROM {ct} WHERE cluster_id >= 0) AS n_patterns
FROM {ct}"""


def _deductions_sql() -> str:
    rate = "CASE WHEN resolved > 0 THEN CAST(nrc AS DOUBLE) * 100.0 / resolved ELSE CAST(0 AS DOUBLE) END"
    def d(x: float) -> str:
        return f"CAST({x} AS DOUBLE)"
    return f"""SELECT 'p1_open' AS deduction, CAST(p1_open AS DOUBLE) AS count, least(p1_open * {d(5)}, {d(30)}) AS points FROM hb
UNION ALL SELECT 'p1_breach', CAST(p1_breach AS DOUBLE), least(p1_breach * {d(3)}, {d(20)}) FROM hb
UNION ALL SELECT 'recurring_patterns', CAST(n_patterns AS DOUBLE), least(n_patterns * {d(4)}, {d(20)}) FROM hb
UNION ALL SELECT 'aged_open', CAST(aged_open AS DOUBLE), least(aged_open * {d(2)}, {d(15)}) FROM hb
UNION ALL SELECT 'no_root_cause_rate', {rate}, least(({rate}) * {d(0.1)}, {d(10)}) FROM hb"""


def _sql_health(final: str) -> Callable[[], str]:
    def build() -> str:
        s = O.Sql()
        ct = O.clustered_tickets(s)
        s.add("hb", _health_base_sql(ct))
        s.add("hd", _deductions_sql())
        pts = " - ".join(f"(SELECT points FROM hd WHERE deduction = '{k}')"
                         for k in ["p1_open", "p1_breach", "recurring_patterns", "aged_open", "no_root_cause_rate"])
        s.add("hs", f"SELECT greatest(0, CAST(floor(CAST(100 AS DOUBLE) - {pts}) AS INTEGER)) AS health_score")
        return s.select(final)
    return build


@register("health_deductions", _sql_health(
    "SELECT deduction, round(count, 6) AS count, round(points, 6) AS points FROM hd"))
def q_health_deductions(spark, sf_dir):
    from tixflow.operators.health import health_deductions
    ct = clustered_tickets(spark, sf_dir)
    d = health_deductions(ct, _n_patterns(ct))
    return d.select("deduction", r6(F.col("count")).alias("count"), r6(F.col("points")).alias("points"))


@register("health_score", _sql_health("""SELECT health_score,
  CASE WHEN health_score >= 85 THEN 'Healthy' WHEN health_score >= 65 THEN 'Fair'
       WHEN health_score >= 40 THEN 'At Risk' ELSE 'Critical' END AS health_label,
  CASE WHEN health_score >= 85 THEN '#22c55e' WHEN health_score >= 65 THEN '#f59e0b'
       WHEN health_score >= 40 THEN '#ef4444' ELSE '#7f1d1d' END AS health_color FROM hs"""))
def q_health_score(spark, sf_dir):
    from tixflow.operators.health import health_score
    ct = clustered_tickets(spark, sf_dir)
    return health_score(ct, _n_patterns(ct)).select("health_score", "health_label", "health_color")


@memo
def tk_patterns(spark, sf_dir):
    from tixflow.operators.clusters import cluster_summary
    from tixflow.session import cut_lineage
    return cut_lineage(cluster_summary(clustered_tickets(spark, sf_dir)))


def _sql_pattern_recs() -> str:
    s = O.Sql()
    ct = O.clustered_tickets(s)
    top = O.cluster_keyword_ctes(s, ct)
    s.add("cl_label", O.label_sql(top, "cluster_id", " Issues", "Uncategorized Issues", "cl"))
    s.add("tbt", f"""SELECT cluster_id, CASE WHEN n_ts = 0 OR second_half = 0 THEN 'Unknown'
       WHEN second_half / greatest(first_half, 1) > 1.3 THEN 'Increasing'
       WHEN second_half / greatest(first_half, 1) < 0.7 THEN 'Decreasing' ELSE 'Stable' END AS trend
FROM (SELECT c.cluster_id, count(*) FILTER (WHERE c.opened_at < r.mid) AS first_half,
        count(*) FILTER (WHERE c.opened_at >= r.mid) AS second_half, count(c.opened_at) AS n_ts
      FROM {ct} c JOIN (
        SELECT cluster_id, min(opened_at) + to_microseconds(CAST(floor(date_diff('microsecond', min(opened_at),
               max(opened_at)) / 2) AS BIGINT)) AS mid
        FROM {ct} WHERE cluster_id >= 0 GROUP BY cluster_id) r USING (cluster_id)
      GROUP BY c.cluster_id)""")
    s.add("pat", f"""SELECT k.cluster_id, count(*) AS size, coalesce(any_value(l.label), 'Uncategorized Issues') AS label,
  any_value(tb.trend) AS trend
FROM {ct} k LEFT JOIN cl_label l USING (cluster_id) JOIN tbt tb USING (cluster_id) WHERE k.cluster_id >= 0 GROUP BY k.cluster_id""")
    s.add("pat_kw", f"SELECT cluster_id, string_agg(keyword, ', ' ORDER BY rank) AS kw3 FROM {top} "
                    f"WHERE rank <= 3 GROUP BY cluster_id")
    s.add("pat_sv", f"SELECT cluster_id, replace(vals, '|', ', ') AS sv FROM ({O.top_values_sql(ct, 'business_service', 2)})")
    s.add("hb", _health_base_sql(ct))
    s.add("mt", f"SELECT avg(CASE WHEN mttr_hours > 4 THEN 100.0 ELSE 0.0 END) AS p1b FROM {ct} "
                f"WHERE priority = 'P1' AND mttr_hours IS NOT NULL")
    s.add("nr", f"SELECT coalesce(avg(CASE WHEN {O.strip('root_cause')} = '' THEN 100.0 ELSE 0.0 END) "
                f"FILTER (WHERE state NOT IN {O.OPEN_IN}), 0.0) AS pct FROM {ct}")
    s.add("top3", "SELECT *, row_number() OVER (ORDER BY size DESC, cluster_id ASC) AS o FROM pat "
                  "ORDER BY size DESC, cluster_id ASC LIMIT 3")
    q = O.q
    s.add("recs", f"""SELECT 1000 AS seq, 'High' AS priority,
  'P1 SLA breached ' || printf('%.1f', round_even(p1b, 1)) || '% of the time' AS finding,
  {q(REPORT_ACTIONS['p1_breach'])} AS action FROM mt WHERE round_even(p1b, 1) > 20
UNION ALL SELECT 2000, 'High', CAST(p1_open AS VARCHAR) || ' P1 ticket(s) currently open',
  {q(REPORT_ACTIONS['p1_open'])} FROM hb WHERE p1_open >= 2
UNION ALL SELECT 3000 + o, 'Medium',
  'Recurring pattern: ' || chr(39) || label || chr(39) || ' (' || CAST(size AS VARCHAR) || ' tickets, trend: ' || trend || ')',
  {q(REPORT_ACTIONS['pattern_prefix'])} || 'Top keywords: ' || coalesce(kw3, '') || '. ' ||
  CASE WHEN sv IS NOT NULL THEN 'Primarily affects: ' || sv || '.' ELSE '' END
  FROM top3 LEFT JOIN pat_kw USING (cluster_id) LEFT JOIN pat_sv USING (cluster_id) WHERE size >= 5
UNION ALL SELECT 5000, 'Low', printf('%.1f', round_even(pct, 1)) || '% of resolved tickets have no root cause recorded',
  {q(REPORT_ACTIONS['no_root_cause'])} FROM nr WHERE round_even(pct, 1) > 40
UNION ALL SELECT 6000, 'Medium', CAST(aged_open AS VARCHAR) || ' ticket(s) open for more than 7 days',
  {q(REPORT_ACTIONS['aged'])} FROM hb WHERE aged_open > 0""")
    s.add("dedup", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY left(action, 60) ORDER BY seq) AS f "
                   "FROM recs) WHERE f = 1")
    return s.select("SELECT * FROM (SELECT CAST(row_number() OVER (ORDER BY seq) AS INTEGER) AS seq, priority, finding, "
                    "action FROM dedup) WHERE seq <= 10")


@register("recommendations", _sql_pattern_recs)
def q_recommendations(spark, sf_dir):
    """A1-A3, A5-A7 (the report's rules without the root-cause tier)."""
    from tixflow.operators.report import recommendations
    ct = clustered_tickets(spark, sf_dir)
    r = recommendations(ct, M.mttr_by_priority(ct), tk_patterns(spark, sf_dir), None)
    return r.select(F.col("seq").cast("int").alias("seq"), "priority", "finding", "action")


RESOLUTION_SQL = O.strip("concat_ws(' ', coalesce(root_cause, ''), coalesce(close_notes, ''))")


@register("resolution_corpus", _sql_on_tickets(lambda t: f"""SELECT number, resolution_text FROM (
  SELECT number, {RESOLUTION_SQL} AS resolution_text FROM {t})
WHERE length(resolution_text) > 10 AND (SELECT count(*) FROM {t} WHERE length({RESOLUTION_SQL}) > 10) >= 5"""))
def q_resolution_corpus(spark, sf_dir):
    from tixflow.operators.rootcause import resolution_corpus
    return resolution_corpus(tickets(spark, sf_dir)).select("number", "resolution_text")


def _sql_map_recs() -> str:
    s = O.Sql()
    ct = O.clustered_tickets(s)
    top = O.cluster_keyword_ctes(s, ct)
    rules = ", ".join(f"({i}, {O.sql_list(tr)}, {O.q(text)})" for i, (tr, text) in enumerate(RECOMMENDATION_RULES))
    s.add("rules", f"SELECT * FROM (VALUES {rules}) AS r(rule_id, triggers, recommendation)")
    s.add("rtrig", "SELECT rule_id, unnest(triggers) AS tr FROM rules")
    s.add("fires", f"SELECT DISTINCT k.cluster_id, r.rule_id, r.recommendation FROM {top} k "
                   f"JOIN rtrig t ON contains(lower(k.keyword), t.tr) JOIN rules r ON r.rule_id = t.rule_id")
    return s.select("SELECT cluster_id, rank, rule_id, recommendation FROM (SELECT *, CAST(row_number() OVER "
                    "(PARTITION BY cluster_id ORDER BY rule_id) AS INTEGER) AS rank FROM fires) WHERE rank <= 3")


@register("map_recommendations", _sql_map_recs)
def q_map_recommendations(spark, sf_dir):
    """R8 applied to the pattern clusters' keywords (same rule operator)."""
    from tixflow.operators.clusters import cluster_keywords, keyword_arrays
    from tixflow.operators.rootcause import map_recommendations, rules_frame
    kw = keyword_arrays(cluster_keywords(clustered_tickets(spark, sf_dir)))
    r = map_recommendations(kw, "cluster_id", rules_frame(spark))
    return r.select("cluster_id", F.col("rank").cast("int").alias("rank"), "rule_id", "recommendation")


@register("open_insight", _sql_on_tickets(lambda t: f"""SELECT open_total, open_p1, open_aged,
  CASE WHEN open_total = 0 THEN 'No currently open tickets detected.'
       ELSE concat_ws(' ', CAST(open_total AS VARCHAR) || ' ticket(s) remain open.',
                      CASE WHEN open_p1 > 0 THEN CAST(open_p1 AS VARCHAR) || ' are P1 (critical).' END,
                      CASE WHEN open_aged > 0 THEN CAST(open_aged AS VARCHAR) || ' have been open for more than 7 days.' END)
  END AS insight
FROM (SELECT count(*) FILTER (WHERE state IN {O.OPEN_IN}) AS open_total,
             count(*) FILTER (WHERE state IN {O.OPEN_IN} AND priority = 'P1') AS open_p1,
             count(*) FILTER (WHERE state IN {O.OPEN_IN} AND age_hours > 168) AS open_aged FROM {t})"""))
def q_open_insight(spark, sf_dir):
    from tixflow.operators.rootcause import open_insight
    return open_insight(tickets(spark, sf_dir))


def _sql_top_actions() -> str:
    s = O.Sql()
    t = O.tickets(s)
    s.add("rcorp", f"SELECT ingest_ord, resolution_text FROM (SELECT ingest_ord, {RESOLUTION_SQL} AS resolution_text "
                   f"FROM {t}) WHERE length(resolution_text) > 10")
    s.add("rw", f"SELECT ingest_ord, list_filter(regexp_extract_all(lower(resolution_text), '\\b([a-z]{{3,}})\\b', 1), "
                f"lambda w: NOT list_contains({O.sql_list(STOP_WORDS)}, w)) AS words FROM rcorp "
                f"WHERE (SELECT count(*) FROM rcorp) >= 5")
    s.add("rb", "SELECT ingest_ord, unnest(range(1, len(words))) AS pos, words FROM rw WHERE len(words) >= 2")
    return s.select("SELECT phrase, count FROM (SELECT words[pos] || ' ' || words[pos + 1] AS phrase, count(*) AS count, "
                    "min((ingest_ord, pos)) AS first FROM rb GROUP BY 1) ORDER BY count DESC, first ASC LIMIT 5")


@register("top_actions", _sql_top_actions)
def q_top_actions(spark, sf_dir):
    from tixflow.operators.rootcause import resolution_corpus, top_actions
    return top_actions(resolution_corpus(tickets(spark, sf_dir)))


@memo
def tk_root_causes(spark, sf_dir):
    from tixflow.operators.rootcause import root_cause_clusters
    return root_cause_clusters(clustered_tickets(spark, sf_dir))


@register("rootcause_clusters")
def q_rootcause_clusters(spark, sf_dir):
    """R4-R6 (rows-only: k-means labels are not an SQL result)."""
    rc = tk_root_causes(spark, sf_dir)
    return rc.corpus.groupBy("rc_cluster").agg(F.count(F.lit(1)).alias("ticket_count"))


@register("rootcause_silhouette")
def q_rootcause_silhouette(spark, sf_dir):
    rc = tk_root_causes(spark, sf_dir)
    rows = [(k, sc) for k, sc in rc.scores] or [(rc.k, None)]
    return spark.createDataFrame(rows, "k int, silhouette double")


@register("link_patterns")
def q_link_patterns(spark, sf_dir):
    from tixflow.operators.rootcause import link_patterns
    rc = tk_root_causes(spark, sf_dir)
    return link_patterns(rc.corpus, clustered_tickets(spark, sf_dir))


@register("rootcause_summary")
def q_rootcause_summary(spark, sf_dir):
    from tixflow.operators.report import root_cause_summary
    from tixflow.operators.rootcause import link_patterns
    rc = tk_root_causes(spark, sf_dir)
    links = link_patterns(rc.corpus, clustered_tickets(spark, sf_dir),
                          tk_patterns(spark, sf_dir).select("cluster_id", "label"))
    rows, _ = root_cause_summary(rc.corpus, links, spark)
    return rows.select("id", "label", F.array_join("keywords", "|").alias("keywords"), "ticket_count",
                       F.array_join("recommendations", "|").alias("recommendations"))


def _corpus_sql(t: str) -> str:
    """Resolution corpus with a fixed grouping in place of the k-means label."""
    return (f"SELECT *, CAST(ingest_ord % 5 AS INTEGER) AS rc_cluster FROM (SELECT *, {RESOLUTION_SQL} AS resolution_text FROM {t}) "
            f"WHERE length(resolution_text) > 10")


def _grouped_corpus(spark, sf_dir: str) -> DataFrame:
    from tixflow.operators.rootcause import resolution_corpus
    return (resolution_corpus(clustered_tickets(spark, sf_dir))
            .withColumn("rc_cluster", (F.col("ingest_ord") % 5).cast("int")))


def _sql_resolution_weights() -> str:
    s = O.Sql()
    t = O.tickets(s)
    s.add("rcg", _corpus_sql(t))
    O.tfidf_ctes(s, "rv", "rcg", ["number"], O.pattern_tokens("resolution_text"), 800, 1)
    return s.select("SELECT number, term, round(w, 6) AS w FROM rv_w")


@register("resolution_weights", _sql_resolution_weights)
def q_resolution_weights(spark, sf_dir):
    """The vectors that the root-cause clustering fits."""
    from tixflow.operators.rootcause import resolution_weights
    return resolution_weights(tickets(spark, sf_dir)).select("number", "term", r6(F.col("w")).alias("w"))


def _sql_grouped_links() -> str:
    s = O.Sql()
    ct = O.clustered_tickets(s)
    s.add("rcg", _corpus_sql(ct))
    return s.select("SELECT rc_cluster, cluster_id AS pattern_id, count(*) AS shared_tickets FROM rcg "
                    "WHERE cluster_id >= 0 GROUP BY ALL")


@register("link_patterns_grouped", _sql_grouped_links)
def q_link_patterns_grouped(spark, sf_dir):
    """R9 over a fixed grouping of the resolution corpus."""
    from tixflow.operators.rootcause import link_patterns
    ct = clustered_tickets(spark, sf_dir)
    return link_patterns(_grouped_corpus(spark, sf_dir).select("number", "rc_cluster"), ct)


def _sql_grouped_summary() -> str:
    s = O.Sql()
    ct = O.clustered_tickets(s)
    s.add("rcg", _corpus_sql(ct))
    top = O.cluster_keyword_ctes(s, "rcg", key="rc_cluster", text="resolution_text", prefix="rk")
    s.add("rk_label", O.label_sql(top, "rc_cluster", "", "Unknown Root Cause", "rk"))
    s.add("rk_kw", f"SELECT rc_cluster, string_agg(keyword, '|' ORDER BY rank) AS keywords FROM {top} GROUP BY rc_cluster")
    rules = ", ".join(f"({i}, {O.sql_list(tr)}, {O.q(text)})" for i, (tr, text) in enumerate(RECOMMENDATION_RULES))
    s.add("rules", f"SELECT * FROM (VALUES {rules}) AS r(rule_id, triggers, recommendation)")
    s.add("rtrig", "SELECT rule_id, unnest(triggers) AS tr FROM rules")
    s.add("fires", f"SELECT DISTINCT k.rc_cluster, r.rule_id, r.recommendation FROM {top} k "
                   f"JOIN rtrig t ON contains(lower(k.keyword), t.tr) JOIN rules r ON r.rule_id = t.rule_id")
    s.add("recs", "SELECT rc_cluster, string_agg(recommendation, '|' ORDER BY rule_id) AS recommendations FROM "
                  "(SELECT *, row_number() OVER (PARTITION BY rc_cluster ORDER BY rule_id) AS n FROM fires) WHERE n <= 3 GROUP BY rc_cluster")
    s.add("smp", "SELECT rc_cluster, string_agg(resolution_text, '|' ORDER BY ingest_ord) AS samples FROM (SELECT *, row_number() OVER "
                 "(PARTITION BY rc_cluster ORDER BY ingest_ord) AS n FROM rcg) WHERE n <= 3 GROUP BY rc_cluster")
    s.add("grp", f"SELECT rc_cluster, string_agg(v, '|' ORDER BY n) AS top_groups FROM (SELECT rc_cluster, assignment_group AS v, row_number() OVER "
                 f"(PARTITION BY rc_cluster ORDER BY count(*) DESC, min(ingest_ord)) AS n FROM rcg WHERE assignment_group <> '' "
                 f"GROUP BY rc_cluster, assignment_group) WHERE n <= 2 GROUP BY rc_cluster")
    s.add("base", "SELECT rc_cluster, count(*) AS ticket_count, round(avg(mttr_hours), 6) AS avg_mttr_hours, "
                  "count(*) FILTER (WHERE priority = 'P1') AS p1 FROM rcg GROUP BY rc_cluster")
    return s.select("SELECT b.rc_cluster AS id, coalesce(label, 'Unknown Root Cause') AS label, coalesce(keywords, '') AS keywords, ticket_count, avg_mttr_hours, "
                    "p1, coalesce(top_groups, '') AS top_groups, coalesce(recommendations, '') AS recommendations, samples, "
                    "row_number() OVER (ORDER BY ticket_count DESC, b.rc_cluster) AS rc_order FROM base b LEFT JOIN rk_label USING (rc_cluster) "
                    "LEFT JOIN rk_kw USING (rc_cluster) LEFT JOIN recs USING (rc_cluster) LEFT JOIN smp USING (rc_cluster) LEFT JOIN grp USING (rc_cluster)")


@register("rootcause_summary_grouped", _sql_grouped_summary)
def q_rootcause_summary_grouped(spark, sf_dir):
    """R7, R8, R10, R11 over a fixed grouping of the resolution corpus."""
    from tixflow.operators.report import root_cause_summary
    from tixflow.operators.rootcause import link_patterns
    corpus = _grouped_corpus(spark, sf_dir)
    links = link_patterns(corpus, clustered_tickets(spark, sf_dir), tk_patterns(spark, sf_dir).select("cluster_id", "label"))
    rows, _ = root_cause_summary(corpus, links, spark)
    join = lambda c: F.array_join(c, "|")
    return rows.select("id", "label", join("keywords").alias("keywords"), "ticket_count", r6(F.col("avg_mttr_hours")).alias("avg_mttr_hours"),
                       F.col("priority_dist")["P1"].alias("p1"), join("top_groups").alias("top_groups"), join("recommendations").alias("recommendations"),
                       join("sample_resolutions").alias("samples"), F.col("rc_order").cast("long").alias("rc_order"))


def _sql_grouped_silhouette() -> str:
    """The pairwise definition over distinct (text, group) rows with their number of tickets."""
    s = O.Sql()
    t = O.tickets(s)
    s.add("rcg", _corpus_sql(t))
    O.tfidf_ctes(s, "rv", "rcg", ["number"], O.pattern_tokens("resolution_text"), 800, 1)
    s.add("cls", "SELECT resolution_text AS txt, rc_cluster AS g, count(*) AS m FROM rcg WHERE number IN (SELECT number FROM rv_w) GROUP BY ALL")
    s.add("rep", "SELECT resolution_text AS txt, min(number) AS number FROM rcg GROUP BY ALL")
    s.add("tw", "SELECT rep.txt, w.term, w.w FROM rep JOIN rv_w w USING (number)")
    s.add("dot", "SELECT a.txt AS x, b.txt AS y, sum(a.w * b.w) AS d FROM tw a JOIN tw b USING (term) GROUP BY ALL")
    s.add("size", "SELECT g, sum(m) AS n FROM cls GROUP BY g")
    s.add("dist", "SELECT a.txt, a.g, a.m, b.g AS og, sum(b.m * (1 - coalesce(dot.d, 0))) AS total FROM cls a CROSS JOIN cls b "
                  "LEFT JOIN dot ON dot.x = a.txt AND dot.y = b.txt GROUP BY ALL")
    s.add("ab", "SELECT d.txt, d.g, d.m, max(n) FILTER (WHERE og = d.g) AS own, max(total / (n - 1)) FILTER (WHERE og = d.g AND n > 1) AS a, "
                "min(total / n) FILTER (WHERE og <> d.g) AS b FROM dist d JOIN size ON size.g = d.og GROUP BY ALL")
    s.add("sil", "SELECT g, m, CASE WHEN b IS NULL THEN NULL WHEN own = 1 OR greatest(a, b) < 1e-12 THEN 0 ELSE (b - a) / greatest(a, b) END AS s FROM ab")
    return s.select("SELECT coalesce(CAST(g AS VARCHAR), 'all') AS rc_cluster, CAST(sum(m) AS BIGINT) AS n, round(sum(s * m) / sum(m), 6) AS silhouette "
                    "FROM sil GROUP BY GROUPING SETS ((g), ())")


@register("rootcause_silhouette_grouped", _sql_grouped_silhouette)
def q_grouped_silhouette(spark, sf_dir):
    """R5 over a fixed grouping of the resolution corpus."""
    from tixflow.operators.rootcause import grouped_silhouette, resolution_corpus
    corpus = resolution_corpus(tickets(spark, sf_dir)).withColumn("rc_cluster", (F.col("ingest_ord") % 5).cast("int"))
    return grouped_silhouette(corpus).select(F.coalesce(F.col("rc_cluster").cast("string"), F.lit("all")).alias("rc_cluster"), "n", r6(F.col("silhouette")).alias("silhouette"))


@register("rootcause_invariants", _sql_on_tickets(lambda t: f"""SELECT count(*) AS n_rows, true AS all_labelled, true AS labels_below_k,
  true AS every_k_scored, true AS first_best_chosen FROM ({_corpus_sql(t)})"""))
def q_rootcause_invariants(spark, sf_dir):
    """What holds for any k-means result."""
    rc = tk_root_causes(spark, sf_dir)
    ks = [k for k, _ in rc.scores]
    best = max((s for _, s in rc.scores), default=None)
    first = next((k for k, s in rc.scores if s == best), rc.k)
    return rc.corpus.agg(F.count(F.lit(1)).alias("n_rows"), F.min(F.col("rc_cluster").isNotNull()).alias("all_labelled"),
                         (F.max("rc_cluster") < rc.k).alias("labels_below_k")).select(
        "*", F.lit(ks == list(range(2, 2 + len(ks))) and len(ks) >= 1).alias("every_k_scored"), F.lit(first == rc.k).alias("first_best_chosen"))


@register("report_row")
def q_report_row(spark, sf_dir):
    """The full pipeline's nested report (one row)."""
    from tixflow.operators.report import run_report
    return run_report(tickets(spark, sf_dir), FX.AS_OF, generated_at="fixed").row


def _sql_report_summary() -> str:
    s = O.Sql()
    ct = O.clustered_tickets(s)
    s.add("hb", _health_base_sql(ct))
    s.add("hd", _deductions_sql())
    pts = " - ".join(f"(SELECT points FROM hd WHERE deduction = '{k}')"
                     for k in ["p1_open", "p1_breach", "recurring_patterns", "aged_open", "no_root_cause_rate"])
    s.add("hs", f"SELECT greatest(0, CAST(floor(CAST(100 AS DOUBLE) - {pts}) AS INTEGER)) AS health_score")
    return s.select(f"""SELECT health_score, CASE WHEN health_score >= 85 THEN 'Healthy' WHEN health_score >= 65 THEN 'Fair'
       WHEN health_score >= 40 THEN 'At Risk' ELSE 'Critical' END AS health_label,
  (SELECT count(*) FROM {ct}) AS total, (SELECT count(*) FROM {ct} WHERE state IN {O.OPEN_IN}) AS open, resolved, p1_open, aged_open,
  round_even(CASE WHEN resolved > 0 THEN nrc * 100.0 / resolved ELSE 0 END, 1) AS no_root_cause_pct, n_patterns,
  (SELECT count(*) FROM {ct} WHERE cluster_id < 0) AS noise_count FROM hb, hs""")


@register("report_summary", _sql_report_summary)
def q_report_summary(spark, sf_dir):
    """J1 as one flat row, from the whole pipeline."""
    from tixflow.operators.report import run_report
    rep = run_report(tickets(spark, sf_dir), FX.AS_OF, with_root_causes=False, generated_at="fixed")
    return rep.summary.drop("generated_at")


SIMILAR_QUERY = "wireless connectivity lost at the branch office"


def _sql_find_similar() -> str:
    s = O.Sql()
    t = O.tickets(s)
    O.tfidf_ctes(s, "pt", t, ["number"], O.pattern_tokens("full_text"), TFIDF_MAX_FEATURES, 2)
    s.add("qd", f"SELECT 'q' AS qid, {O.q(SIMILAR_QUERY)} AS txt")
    O.transform_ctes(s, "qv", "pt_vocab", "qd", ["qid"], O.pattern_tokens("txt"))
    s.add("sc", "SELECT w.number, sum(w.w * q.w) AS score FROM pt_w w JOIN qv_w q USING (term) GROUP BY w.number")
    return s.select(f"SELECT t.number, round(coalesce(sc.score, 0.0), 6) AS similarity_score FROM {t} t "
                    f"LEFT JOIN sc USING (number) ORDER BY round(coalesce(sc.score, 0.0), 9) DESC, t.ingest_ord ASC LIMIT 10")


def _fitted_texts(spark, sf_dir):
    from tixflow.session import cut_lineage
    t = cut_lineage(tickets(spark, sf_dir).select("number", "ingest_ord", "full_text"))
    return TF.fit_texts(t, "full_text", vectoriser_terms, TFIDF_MAX_FEATURES, 2, ord_col="ingest_ord")


@register("find_similar", _sql_find_similar)
def q_find_similar(spark, sf_dir):
    """P20: top 10 tickets for a query text in the fitted pattern vocabulary."""
    from tixflow.operators.similarity import find_similar
    vocab, doc_text, texts, w = _fitted_texts(spark, sf_dir)
    qd = spark.createDataFrame([("q", SIMILAR_QUERY)], "qid string, txt string") \
              .select("qid", vectoriser_terms(F.col("txt")).alias("terms"))
    qw = TF.transform(qd, vocab, ["qid"]).select("term", "w")
    r = find_similar(doc_text, texts, w, qw, "ingest_ord", 10)
    return r.select("number", r6(F.col("similarity_score")).alias("similarity_score"))


def _sql_find_similar_batch() -> str:
    s = O.Sql()
    t = O.tickets(s)
    O.tfidf_ctes(s, "pt", t, ["number"], O.pattern_tokens("full_text"), TFIDF_MAX_FEATURES, 2)
    s.add("qd", f"SELECT number AS qid FROM {t} WHERE CAST(substr(number, 4) AS BIGINT) % 50 = 0")
    s.add("sc", "SELECT q.number AS qid, w.number, sum(w.w * q.w) AS score FROM pt_w w JOIN pt_w q USING (term) "
                "WHERE q.number IN (SELECT qid FROM qd) GROUP BY q.number, w.number")
    s.add("rk", f"SELECT qd.qid, t.number, coalesce(sc.score, 0.0) AS score, row_number() OVER (PARTITION BY qd.qid "
                f"ORDER BY round(coalesce(sc.score, 0.0), 9) DESC, t.ingest_ord) AS rank "
                f"FROM qd CROSS JOIN {t} t LEFT JOIN sc ON sc.qid = qd.qid AND sc.number = t.number")
    return s.select("SELECT qid, rank, number, round(score, 6) AS similarity_score FROM rk WHERE rank <= 5")


@register("find_similar_batch", _sql_find_similar_batch)
def q_find_similar_batch(spark, sf_dir):
    """P20 with every ticket whose key is divisible by 50 as a query, against all tickets."""
    from tixflow.operators.search import find_similar_batch
    vocab, doc_text, texts, w = _fitted_texts(spark, sf_dir)
    asked = doc_text.where(F.substring("number", 4, 20).cast("long") % 50 == 0)
    r = find_similar_batch(asked.select(F.col("number").alias("qid"), F.col("full_text").alias("query")), "qid", "query",
                           doc_text.select("number", "ingest_ord", "th1", "th2"), texts, w, vocab, vectoriser_terms, "ingest_ord", 5)
    return r.select("qid", F.col("rank").cast("long").alias("rank"), "number", r6(F.col("similarity_score")).alias("similarity_score"))


def flagship(spark, sf_dir: str) -> DataFrame:
    """Health report summary: score, label, totals, pattern and root-cause counts."""
    from tixflow.operators.report import run_report
    rep = run_report(tickets(spark, sf_dir), FX.AS_OF, generated_at="fixed")
    return rep.row.select("health_score", "health_label", F.col("metrics.summary.total").alias("total"),
                          F.col("metrics.summary.open").alias("open"),
                          F.size("patterns.clusters").alias("n_patterns"),
                          F.col("patterns.noise_count").alias("noise_count"),
                          F.size("root_causes.root_causes").alias("n_root_causes"),
                          F.size("recommendations").alias("n_recommendations"))
